"""Crawls against a plain breadth-first walk, and commits over several tables."""

import random

import pytest
from pyspark.sql import functions as F

from lodemark.operators import commits
from lodemark.operators.crawl import allowed, crawl, page_links, page_series


def plain(links, seeds, depth, barred=()):
    met, frontier = {s: 0 for s in seeds if s not in barred}, [s for s in seeds if s not in barred]
    for k in range(1, depth + 1):
        frontier = list(dict.fromkeys(d for s, d in links if s in frontier and d not in met and d not in barred))
        met |= dict.fromkeys(frontier, k)
    return met


def test_crawl(spark):
    """Equals the plain walk on random graphs with cycles, repeats, nulls and a hub; a barred address is neither met nor followed."""
    rng = random.Random(3)
    links = [(f"http://h{rng.randrange(3)}/{rng.randrange(30)}", f"http://h{rng.randrange(3)}/{rng.randrange(30)}") for _ in range(90)]
    links += [("http://h0/0", f"http://h1/{k}") for k in range(30)] + [("a", "b"), ("b", "a"), ("b", "b"), (None, "a"), ("a", None)] + links[:9]
    edges = spark.createDataFrame(links, "src string, dst string")
    seeds = spark.createDataFrame([("http://h0/0",), ("a",), ("a",), (None,)], "url string")
    for depth in (0, 1, 3, 40):
        got = crawl(edges, seeds, depth).collect()
        assert len(got) == len({r.url for r in got})
        assert {r.url: r.depth for r in got} == plain([x for x in links if None not in x], ["http://h0/0", "a"], depth)
    rules = spark.createDataFrame([("h1", "/1", False), ("h1", "/12", True), ("h2", "/", False)], "host string, prefix string, allow boolean")
    barred = {f"http://h1/{k}" for k in range(30) if str(k).startswith("1") and k != 12} | {f"http://h2/{k}" for k in range(30)}
    assert {r.url: r.depth for r in crawl(edges, seeds, 5, rules).collect()} == plain([x for x in links if None not in x], ["http://h0/0", "a"], 5, barred)
    assert crawl(edges, seeds.limit(0), 5).count() == 0


def test_links_of_pages(spark):
    html = '<a href="/x">1</a> <A class=c HREF=\'y?q=1#top\'>2</A><a href="#top">3</a><a href="mailto:a@b">4</a><a href="//o.org/z">5</a><a href="?page=2">6</a><a href="https://e.org">7</a><a href="/x">8</a>'
    pages = spark.createDataFrame([("http://s.com/a/b?k=1#f", html), ("http://s.com", '<a href="w">'), ("http://s.com/e", ""), ("http://s.com/n", None), (None, html)], "url string, html string")
    want = {("http://s.com/a/b?k=1", d) for d in ("http://s.com/x", "http://s.com/a/y?q=1", "http://o.org/z", "http://s.com/a/b?page=2", "https://e.org")} | {("http://s.com", "http://s.com/w")}
    got = [tuple(r) for r in page_links(pages).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {tuple(r) for r in page_series(pages.filter("url = 'http://s.com/e'")).collect()} == {("http://s.com/e", "http://s.com/e?page=2")}
    rules = spark.createDataFrame([("S.com", "/a", False), ("s.com", "/a", True), ("s.com", "/e", False)], "host string, prefix string, allow boolean")
    assert {r.url for r in allowed(pages.select("url").dropna(), rules).collect()} == {"http://s.com/a/b?k=1#f", "http://s.com", "http://s.com/n"}


def test_commits(spark, tmp_path):
    """What a commit writes appears together; a failure between two writes, or another's commit, leaves readers with the old state."""
    root = f"file://{tmp_path}/db"
    frame = lambda *rows: spark.createDataFrame([*rows], "id long, v string")
    both = lambda: ({r.id for r in commits.read(spark, root, "a").collect()}, {r.id for r in commits.read(spark, root, "b").collect()})
    commits.commit(spark, root, replace={"a": frame((1, "x"), (2, None)), "b": frame((9, "y"))})
    commits.commit(spark, root, append={"a": frame((3, "z"))}, replace={"b": commits.read(spark, root, "b").withColumn("id", F.col("id") + 1)})
    assert both() == ({1, 2, 3}, {10})
    bad = frame((5, "q")).withColumn("v", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        commits.commit(spark, root, append={"a": frame((4, "w")), "b": bad})
    assert both() == ({1, 2, 3}, {10})
    with pytest.raises(ValueError, match="v is string"):
        commits.commit(spark, root, append={"a": frame((4, "w")).withColumn("v", F.lit(1))})
    with pytest.raises(commits.Conflict):
        commits._publish(spark, root, 2, "{}")
    assert both() == ({1, 2, 3}, {10}) and commits.versions(spark, root) == [1, 2]
    assert commits.read(spark, root, "a", 1).count() == 2
    commits.commit(spark, root, append={"a": frame((7, "n")).withColumn("more", F.lit(True))})
    assert [(r.id, r.more) for r in commits.read(spark, root, "a").orderBy("id").collect()] == [(1, None), (2, None), (3, None), (7, True)]
    assert commits.vacuum(spark, root) == 3 and commits.versions(spark, root) == [3] and both() == ({1, 2, 3, 7}, {10})


def test_archive(spark, tmp_path):
    """Rows for which the rule is null stay; archived rows are added to those of before."""
    root = f"file://{tmp_path}/db"
    commits.commit(spark, root, replace={"s": spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, age int")})
    commits.archive(spark, root, "s", "old", F.col("age") > 30, F.struct("id", "age"))
    assert {r.id for r in commits.read(spark, root, "s").collect()} == {1, 3} and [r.record.id for r in commits.read(spark, root, "old").collect()] == [2]
    commits.archive(spark, root, "s", "old", F.col("age") > 3, F.struct("id", "age"))
    assert {r.id for r in commits.read(spark, root, "s").collect()} == {3} and {r.record.id for r in commits.read(spark, root, "old").collect()} == {1, 2}


def test_save_run(spark, tmp_path):
    """A run's three tables share one id, which reads back as text."""
    root = f"file://{tmp_path}/db"
    one = spark.createDataFrame([(1.5,)], "x double")
    ids = {commits.save_run(spark, root, one, one.union(one), one) for _ in range(2)}
    assert len(ids) == 2 and {r.run_id for r in commits.read(spark, root, "backtest_runs").collect()} == ids
    trades = commits.read(spark, root, "backtest_trades")
    assert trades.filter(F.col("run_id") == min(ids)).count() == 2 and commits.read(spark, root, "equity_curves").count() == 2
