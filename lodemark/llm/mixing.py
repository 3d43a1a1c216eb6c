"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are counted by the set of sources they belong to (their pattern). The flow sends each pattern's words to its
sources' quotas; another pass over the same words costs one more than the pass before it (convex repetition costs), so
words that have not been used are taken first. What a pattern has to give is then dealt to its documents: whole passes to all,
the rest to the first documents in seeded order. Only patterns are ever seen by the driver, never documents.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.storage import save

from .common import WORD, fresh, read_table

WEIGHTS, SHARE, PASSES, SEED = (5, 2, 1), 1.5, 2, 17
#: Hex digits of the bins, step by step.
BINS = (2, 4, 6)


def words(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> dict:
    """Words that each source shall give: ``share`` of all words by weight, at most ``passes`` times a source's size.

    Sources are in code point order, null last, and weigh ``weights`` in turn. The excess over a cap goes to the others
    by weight, until none is above its cap. Sources that reach their caps do so in order of cap over weight.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    caps = {s: passes * sizes[s] for s in order}
    total, left = share * sum(sizes.values()), sum(weigh.values())
    out = {}
    for s in sorted(order, key=lambda s: caps[s] / weigh[s]):
        if weigh[s] * total > caps[s] * left:
            out[s] = float(caps[s])
            total, left = total - caps[s], left - weigh[s]
        else:
            out[s] = weigh[s] * total / left
    return out


def min_cost_flow(supply: dict, quotas: dict, passes: int = PASSES) -> dict:
    """Words from each pattern (a tuple of sources) to each source: {(pattern, source): words}.

    ``supply``: words of each pattern; each pass over them costs one more than the last. Successive shortest paths on each
    connected part of patterns and sources.
    """
    of, out = defaultdict(list), {}
    for p in supply:
        for s in p:
            of[s].append(p)
    seen, met = set(), set()
    for start in supply:
        if start in seen:
            continue
        part, rest = [], [start]
        while rest:
            p = rest.pop()
            if p not in seen:
                seen.add(p)
                part.append(p)
                rest += [q for s in p if s not in met for q in of[s]]
                met.update(p)
        out |= _part_flow({p: supply[p] for p in part}, quotas, passes)
    return out


def _part_flow(supply: dict, quotas: dict, passes: int) -> dict:
    arcs: list[list] = []  # from, to, capacity left, cost; the arc back stands next to it
    at = defaultdict(list)

    def arc(a, b, room, cost):
        for x, y, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            at[x].append(len(arcs))
            arcs.append([x, y, r, c])

    for p, n in supply.items():
        for k in range(passes):
            arc("from", ("p", p), float(n), k)
        for s in p:
            arc(("p", p), ("s", s), float("inf"), 0)
    for s in sorted({s for p in supply for s in p}, key=lambda s: (s is None, s or "")):
        arc(("s", s), "to", float(quotas.get(s, 0)), 0)
    while True:
        far, by, queue = {"from": 0}, {}, ["from"]
        while queue:
            later = []
            for x in queue:
                for i in at[x]:
                    _, y, room, cost = arcs[i]
                    if room > 1e-9 and far[x] + cost < far.get(y, float("inf")):
                        far[y], by[y] = far[x] + cost, i
                        later.append(y)
            queue = later
        if "to" not in far:
            break
        path, x = [], "to"
        while x != "from":
            path.append(by[x])
            x = arcs[by[x]][0]
        room = min(arcs[i][2] for i in path)
        for i in path:
            arcs[i][2] -= room
            arcs[i ^ 1][2] += room
    return {(p, s): sum(arcs[i ^ 1][2] for i in at["p", p] if arcs[i][1] == ("s", s) and arcs[i][2] == float("inf")) for p in supply for s in p}


def place(key: str, seed: int) -> Column:
    """Seeded place of a document in its pattern's order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))


def plan(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """For each pattern: target, source_size, whole passes, and the last place (``until``) that gets one more.

    ``sized``: doc_id, size, sources (sorted array of strings; an element may be null). In seeded order, documents get one more pass
    while their words fit what is left; the one at the border gets it if that comes nearer. The border is found
    step by step, in sums by the first hex digits of the place, then within one of the last bins: no step sorts more than 256 sums, or
    one of 16,777,216 bins, of a source.
    """
    spark = sized.sparkSession
    totals = [(tuple(r.sources), r.words) for r in sized.groupBy("sources").agg(F.sum("size").alias("words")).collect()]
    sizes: dict = defaultdict(int)
    for p, n in totals:
        for s in p:
            sizes[s] += n
    goal = targets(sizes, weights, share, passes)
    flow = min_cost_flow(dict(totals), goal, passes)
    rows = []
    for p, n in totals:
        gives = sum(flow[p, s] for s in p)
        whole = min(passes, int(gives // n)) if n else 0
        rows.append((list(p), [goal[s] for s in p], [sizes[s] for s in p], whole, gives - whole * n if whole < passes else 0.0))
    schema = "sources array<string>, targets array<double>, source_sizes array<long>, whole int, rest double"
    wanted = save(spark.createDataFrame(rows, schema), "wanted")  # of a known size, so that a small one is broadcast
    placed = sized.select("sources", "size", place("doc_id", seed).alias("place"))
    border = wanted.filter("rest > 0").select("sources", "rest", F.lit("").alias("bin"), F.lit(0).cast("long").alias("before"))
    w = Window.partitionBy("sources").orderBy("bin")
    for digits in BINS:
        inside = placed.join(border.withColumnRenamed("bin", "_in"), "sources").filter(F.col("place").startswith(F.col("_in")))
        by_bin = inside.groupBy("sources", "rest", "before", F.substring("place", 1, digits).alias("bin")).agg(F.sum("size").alias("words"))
        by_bin = by_bin.withColumn("through", F.col("before") + F.sum("words").over(w)).filter("through > rest AND through - words <= rest")
        border = save(by_bin.select("sources", "rest", "bin", (F.col("through") - F.col("words")).alias("before")), "border")
    near = placed.join(border, "sources").filter(F.col("place").startswith(F.col("bin"))).groupBy("sources", "bin", "before", "rest", "place").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("sources", "bin").orderBy("place")
    near = near.withColumn("through", F.col("before") + F.sum("words").over(w)).filter("through <= rest OR through - rest < rest - (through - words)")
    last = near.groupBy("sources", "bin").agg(F.max("place").alias("place"))
    until = border.join(last, ["sources", "bin"], "left").select("sources", F.coalesce("place", "bin").alias("until"))
    return wanted.join(until, "sources", "left").withColumn("until", F.when(F.col("rest") > 0, F.coalesce("until", F.lit("g"))).otherwise(F.lit("")))  # "g" is after every digit


def mix(docs: DataFrame, sources: Column, key: str = "doc_id", text: str = "text", weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """doc_id, size, sources, targets, source_sizes, copies, taken for each row of ``docs``.

    ``sources``: the sources a document belongs to, as an array. Null texts and texts without words have size 0 and are taken as
    often as their place says, for no words. Rows that repeat an id have one place, so they are taken alike. Null ids share
    one place. Empty tables give no rows.
    """
    sized, chosen = planned(docs, sources, key, text, weights, share, passes, seed)
    out = sized.join(chosen, "sources").withColumn("copies", F.col("whole") + (place("doc_id", seed) <= F.col("until")).cast("int"))
    return out.select("doc_id", "size", "sources", "targets", "source_sizes", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def planned(docs: DataFrame, sources: Column, key: str, text: str, weights: tuple, share: float, passes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Sizes of all rows, and the plan as a written table: Spark knows its size and broadcasts it if it is small."""
    sized = save(docs.select(F.col(key).alias("doc_id"), words(text).alias("size"), F.array_sort(F.array_distinct(sources)).alias("sources")), "sized")
    return sized, save(plan(sized, weights, share, passes, seed), "plan")


def mix_documents(docs: DataFrame, sources: Column, key: str = "doc_id", text: str = "text", weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them.

    Null, empty, repeated and very long texts, null ids, ties and empty tables are as in ``mix``. No column's name can clash.
    """
    _, chosen = planned(docs, sources, key, text, weights, share, passes, seed)
    own, whole, until, copy = (fresh(docs, c) for c in ("own", "whole", "until", "copy"))
    chosen = chosen.select(F.col("sources").alias(own), F.col("whole").alias(whole), F.col("until").alias(until))
    copies = F.col(whole) + (place(key, seed) <= F.col(until)).cast("int")
    joined = docs.withColumn(own, F.array_sort(F.array_distinct(sources))).join(chosen, own)
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array_repeat(F.lit(True), copies)).alias(copy)).drop(copy)


def op9_mix_flow(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs, F.array("source"))
    return mixed.select("doc_id", "size", F.get("source_sizes", F.lit(0)).alias("source_size"), F.get("targets", F.lit(0)).alias("target"), F.col("taken").cast("long").alias("taken"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w
  FROM sized GROUP BY source
), tested AS (
  SELECT *, w * (1.5::DOUBLE * (sum(n) OVER ())::DOUBLE - coalesce(sum(2 * n) OVER before, 0)::DOUBLE)
            > (2 * n)::DOUBLE * (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS capped
  FROM src WINDOW before AS (ORDER BY (2 * n)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, n, CASE WHEN capped THEN (2 * n)::DOUBLE ELSE
    w * (1.5::DOUBLE * (sum(n) OVER ())::DOUBLE - coalesce(sum(2 * n) FILTER (capped) OVER (), 0)::DOUBLE)
      / (sum(w) OVER () - coalesce(sum(w) FILTER (capped) OVER (), 0))::DOUBLE END AS target
  FROM tested
), planned AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(2, CAST(floor(target / n) AS INT)) END AS whole FROM goal
), placed AS (
  SELECT sized.*, p.n, p.target, p.whole, CASE WHEN p.whole < 2 THEN p.target - p.whole * p.n ELSE 0 END AS rest,
         sum(size) OVER (PARTITION BY sized.source ORDER BY place) AS through,
         sum(size) OVER (PARTITION BY sized.source, place) AS own
  FROM sized JOIN planned p ON sized.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, n AS source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND (through <= rest OR through - rest < rest - (through - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
