"""Alignment, clustering and packing against plain versions, and their odd inputs."""

import binascii
import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodemark.llm import alignment, centroids, packing
from lodemark.llm.wordpiece import byte_names

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string"
LONG = "lorem ipsum dolor " * 60000


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", LONG, "same text here", "same text here", "a ▁ b", "<|endoftext|> <s></s> <0x41>", "tab\tand\n\nlines  é 日本 \U0001f600\x00", " leads", "x"]
    rows = [(k if k < 8 else None, t, "en") for k, t in enumerate(texts)] + [(3, "same text here", "en")]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("row", "pairs", "times", "ids", "start", "length", "n", "best", "sequence_id")})


@functools.cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


# 11


def plain_alignment(docs):
    """{row: (doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)} token by token."""
    a, b = libraries()
    names, out, linked = byte_names(), [], []
    for doc, text in docs:
        whole = (" " + (text or "")).encode()
        tokens = []
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        tokens.append([(i, bytes(names[c] for c in a.id_to_token(i))) for i in ids_a])
        ids_b = b.encode(text or "")
        tokens.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids_b])
        if not text or any(b"".join(t for _, t in side) != whole for side in tokens):
            tokens = [[], []]
        spans = []
        for side in tokens:
            at, own = 0, []
            for i, t in side:
                own.append((i, at, at + len(t)))
                at += len(t)
            spans.append(own)
        links, first = [], 0
        for i, s, e in spans[0]:
            while first < len(spans[1]) and spans[1][first][2] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = []
        left = [list(reversed(side)) for side in spans]
        for high in cuts:
            parts = []
            for side in left:
                own = []
                while side and side[-1][2] <= high:
                    own.append(str(side.pop()[0]))
                parts.append(",".join(own))
            groups.append("|".join(parts))
        linked.append(links)
        out.append([doc, len(spans[0]), len(spans[1]), len(groups), len(links), ";".join(groups)])
    counts = Counter(p for links in linked for p in set(links))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(*o[:5], sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), o[5]) for o, links in zip(out, linked, strict=True)]


def test_alignment_is_the_plain_one(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    want = plain_alignment([tuple(r) for r in docs.collect()])
    got = alignment.with_counts(alignment.save(alignment.align_tokens(docs, A, B), "aligned")).drop("row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("shared", [0, 2_000_000])
def test_alignment_odd(spark, odd, shared):
    want = plain_alignment([(r.doc_id, r.text) for r in odd.collect()])
    got = alignment.with_counts(alignment.save(alignment.align_tokens(odd.repartition(3), A, B), "aligned"), shared)
    rows = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    key = lambda r: tuple((x is not None, x) for x in r[:7])
    assert sorted(map(key, rows)) == sorted(map(key, want))
    groups = {(r.doc_id, r.n_a): r.groups for r in rows}
    assert all(groups[w[0], w[1]] == w[7] for w in want)
    assert {r.doc_id for r in rows if not r.n_a} == {0, 1, 5}


def test_alignment_of_nothing(spark, odd):
    none = alignment.align_tokens(odd.filter("false"), A, B)
    assert alignment.with_counts(alignment.save(none, "aligned")).count() == 0


def test_alignment_query(spark, data):
    rows = alignment.op11_alignment(spark, data).collect()
    assert len(rows) == 200 and all(r.groups_sha256 == "" or len(r.groups_sha256) == 64 for r in rows)
    assert set(rows[0].asDict()) == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}


# 12


def plain_clusters(vectors, ids, k, rounds):
    """Lloyd's rounds by whole distances."""
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest(), vectors[i].tolist()))[:k]
    centers = vectors[order].copy()
    for step in range(rounds + 1):
        far = ((vectors[:, None, :].astype(object) - centers[None].astype(object)) ** 2).sum(2)
        own = np.array([min(range(len(centers)), key=lambda c: (f[c], c)) for f in far])
        if step < rounds:
            for c in range(len(centers)):
                if (own == c).any():
                    centers[c] = [int(s) // int((own == c).sum()) for s in vectors[own == c].astype(object).sum(0)]
    return own, np.array([f[c] for f, c in zip(far, own, strict=True)]), centers


@pytest.mark.parametrize(("k", "rounds", "spread"), [(16, 3, 40), (40, 8, 3), (2, 5, 40), (16, 5, 2**26), (1, 2, 5)])
def test_clusters_are_lloyds(spark, k, rounds, spread):
    rng = np.random.default_rng(k)
    vectors = np.clip(rng.integers(-spread, spread, (6, 4))[rng.integers(0, 6, 300)] + rng.integers(-3, 4, (300, 4)), -(2**26), 2**26)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>").repartition(3)
    got, centers = centroids.cluster_vectors(rows, clusters=k, rounds=rounds, size=4, scale=1)
    found = {r.vec_id: (r.cluster, r.distance) for r in got.collect()}
    own, far, want = plain_clusters(vectors, list(range(300)), k, rounds)
    assert centers.tolist() == want.tolist()
    assert found == {i: (int(own[i]), int(far[i])) for i in range(300)}


def test_bounds_spare_scans():
    """Far more is certified than scanned where clusters are apart, and the bounds never lie."""
    rng = np.random.default_rng(1)
    centers = rng.integers(-1000, 1000, (16, 8))
    vectors = centers[rng.integers(0, 16, 4000)] + rng.integers(-20, 20, (4000, 8))
    bounds = centroids.Bounds.scan(vectors, centers, 4)
    for _ in range(4):
        after = centers + rng.integers(-15, 15, centers.shape)
        bounds.moved(np.sqrt(((after - centers) ** 2).sum(1).astype(float)), 4)
        bounds.needed[:] = 0
        bounds.assign(after)
        centers = after
        far = centroids.squared(vectors, centers)
        assert (bounds.cluster == far.argmin(1)).all()
        exact = np.sqrt(far)
        assert (bounds.upper >= exact[np.arange(4000), bounds.cluster]).all()
        assert (bounds.lower <= np.take_along_axis(exact, bounds.near, 1)).all()
        assert (bounds.needed > 4).mean() < 0.1


def test_clusters_odd(spark):
    good = [float(k) for k in range(64)]
    rows = [(1, good), (1, good), (None, good), (2, None), (3, []), (4, good[:63]), (5, [*good[:63], None]), (6, [*good[:63], float("nan")]), (7, [*good[:63], float("inf")]), (8, [-x for x in good]), (9, [*good[:63], 1e30]), (10, [x / 1000 for x in good])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("id", "vector", "cluster", "near", "distance")})
    got = centroids.digests(*centroids.cluster_vectors(df)).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in got) == [(False, 1), (False, 1), (False, 8), (False, 10), (True, None)]
    assert all(r.distance == 0 and r.inertia == 0 for r in got)  # fewer vectors than clusters
    assert len({r.cluster for r in got if r.vec_id in (1, None)}) == 1
    assert centroids.digests(*centroids.cluster_vectors(df.filter("false"))).count() == 0


# 13


@functools.cache
def with_specials():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A)


@functools.cache
def ids_of(text):
    return [*with_specials().encode(text or "", add_special_tokens=False).ids, 0]


def check_packed(rows, docs, window=1024):
    """Each id of each document lies in one piece, and sequences have no gaps."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == window or at & (at - 1) == 0
    for doc, texts in docs.items():
        want = sorted(i for t in texts for i in ids_of(t))
        assert sorted(i for r in by_doc[doc] for i in np.frombuffer(r.ids, "<u4").tolist()) == want
        assert sum(r.length for r in by_doc[doc]) == sum(len(ids_of(t)) for t in texts)
        if len(texts) == 1:
            own = sorted(by_doc[doc], key=lambda r: r.start)
            assert [i for r in own for i in np.frombuffer(r.ids, "<u4").tolist()] == ids_of(texts[0])
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and {r.doc_tokens for r in own} == {len(ids_of(texts[0]))}


def test_packing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = defaultdict(list)
    for r in docs.collect():
        held[r.doc_id].append(r.text)
    rows = packing.pack_documents(docs.repartition(3), A).collect()
    check_packed(rows, held)
    assert sum(r.length == r.doc_tokens for r in rows) > 0.5 * len(held)
    digest = packing.op13_sum_of_squares(spark, data).collect()
    assert sum(r.length for r in digest) == sum(r.length for r in rows)
    whole = {r.doc_id: r for r in digest if r.length == r.doc_tokens and len(held[r.doc_id]) == 1}
    assert all(r.ids_crc32 == binascii.crc32(np.array(ids_of(held[d][0]), "<u4").tobytes()) for d, r in whole.items())


def test_packing_odd(spark, odd):
    held = defaultdict(list)
    for r in odd.collect():
        held[r.doc_id].append(r.text)
    for parts in (1, 4):
        check_packed(packing.pack_documents(odd.repartition(parts), A).collect(), held)
    check_packed(packing.pack_documents(odd.repartition(2), A, window=16, room=1).collect(), held, 16)
    assert packing.pack_documents(odd.filter("false"), A).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack_documents(odd, A, window=1000)


def plain_level(counts, n, window):
    """The level for which the sum of squares comes out least, by trying all."""
    tried = []
    for h in [0, *(h for h in range(1, window - n + 1) if counts[h])]:
        after = counts.copy()
        if h:
            after[h] -= 1
        if h + n < window:
            after[h + n] += 1
        tried.append(((after**2).sum(), -h))
    return -min(tried)[1]


def test_the_level_is_the_best():
    rng = random.Random(3)
    packer = packing.Packer(64)
    for _ in range(300):
        packer.counts[1:64] = [rng.choice([0, 0, 0, 1, 2, 7]) for _ in range(63)]
        n = rng.randrange(1, 64)
        assert packer.level(n) == plain_level(packer.counts, n, 64)


@pytest.mark.parametrize("sizes", [[600] * 5000, [1] * 3000, [1023, 1] * 500, [5000] * 20, list(range(1, 1500)), [700, 700, 324] * 300])
def test_packer(sizes):
    packer, most = packing.Packer(room=8), 0
    for k, n in enumerate(sizes):
        packer.add(k, n)
        most = max(most, packer.room)
        assert packer.waiting >= packer.room and len(packer.queue) <= 8 * 1024 + 1
        assert packer.room == sum((1024 - h) * int(c) for h, c in enumerate(packer.counts))
    assert most <= 8 * 1024
    packer.close()
    filled, cut = Counter(), Counter()
    for doc, _, n, sequence, _ in packer.pieces:
        filled[sequence] += n
        cut[doc] += n
    assert [cut[k] for k in range(len(sizes))] == sizes
    assert all(n & (n - 1) == 0 for n in filled.values()) and sum(n < 1024 for n in filled.values()) <= 10
    assert sequences_are_whole(packer.pieces)


def sequences_are_whole(pieces):
    held = defaultdict(list)
    for _, _, n, sequence, offset in pieces:
        held[sequence].append((offset, n))
    return all(o == sum(n for _, n in sorted(v)[:k]) for v in held.values() for k, (o, _) in enumerate(sorted(v)))


def test_sequences(spark, odd):
    pieces = packing.pack_documents(odd.repartition(2), A)
    whole = packing.sequences(pieces).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in pieces.select("length").collect())
    assert all(len(r.ids) == 4 * r.length == 4 * sum(r.lengths) and len(r.doc_ids) == len(r.lengths) for r in whole)
