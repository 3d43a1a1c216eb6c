"""Bounded crawls: a frontier of addresses goes from link to link, round by round, and meets no address twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.functions.text import host, next_page
from lodemark.storage import save


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst: each page's links as absolute addresses without fragments. Mail, scripts and other schemes are left out."""
    ref = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#]*)"""), F.lit(1))
    rows = pages.select(F.regexp_replace(url, "#.*$", "").alias("src"), F.explode(ref).alias("ref")).filter("ref <> '' AND src IS NOT NULL")
    scheme, root = F.regexp_extract("src", r"^([A-Za-z]+:)", 1), F.regexp_extract("src", r"^([A-Za-z]+://[^/?]*)", 1)
    folder = F.regexp_extract("src", r"^([A-Za-z]+://[^/?]*(?:/[^/?]*)*/)[^/?]*(?:\?.*)?$", 1)
    base = F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder)
    dst = (
        F.when(F.col("ref").rlike(r"^https?://"), F.col("ref"))
        .when(F.startswith("ref", F.lit("//")), F.concat(scheme, "ref"))
        .when(F.startswith("ref", F.lit("/")), F.concat(root, "ref"))
        .when(F.startswith("ref", F.lit("?")), F.concat(F.regexp_replace("src", r"\?.*$", ""), "ref"))
        .when(~F.col("ref").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(base, "ref"))
    )
    return rows.select("src", dst.alias("dst")).filter("dst IS NOT NULL").distinct()


def page_series(pages: DataFrame, url: str = "url") -> DataFrame:
    """src, dst: each page and the next page of its series."""
    return pages.filter(F.col(url).isNotNull()).select(F.col(url).alias("src"), next_page(F.col(url)).alias("dst")).distinct()


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The rows whose address no rule (host, prefix, allow) forbids: of a host's rules that fit the path, the longest decides, of equal ones the one that allows."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    asked = urls.select(F.col(url).alias("_url"), host(F.col(url)).alias("host"), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)).alias("_path")).distinct()
    fits = asked.join(rules.select(F.lower("host").alias("host"), "prefix", "allow"), "host").filter(F.startswith("_path", "prefix"))
    barred = fits.groupBy("_url").agg(F.max(F.struct(F.length("prefix").alias("n"), "allow"))["allow"].alias("ok")).filter("NOT ok")
    return urls.join(barred, F.col(url) == barred["_url"], "left_anti")


def crawl(links: DataFrame, seeds: DataFrame, depth: int, rules: DataFrame | None = None) -> DataFrame:
    """url, depth: the addresses that at most ``depth`` links of ``links`` (src, dst) lead to from ``seeds`` (url), each with the fewest.

    A round joins the frontier, each address of it once, with the links and leaves out what an earlier round has met, so cycles and
    repeated links end. Rounds are tables of their own; the driver sees whether a frontier is empty, never an address. Addresses
    barred by ``rules`` (see ``allowed``) are neither met nor followed. Null addresses are left out; no seeds give no rows.
    """
    gate = (lambda df: allowed(df, rules)) if rules is not None else (lambda df: df)
    links = links.filter("src IS NOT NULL AND dst IS NOT NULL")
    met = [save(gate(seeds.select("url").dropna().distinct()).select("url", F.lit(0).alias("depth")), "frontier")]
    for k in range(1, depth + 1):
        reached = met[-1].join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        visited = reduce(DataFrame.unionByName, met).select("url")
        frontier = save(gate(reached.join(visited, "url", "left_anti")).select("url", F.lit(k).alias("depth")), "frontier")
        if frontier.isEmpty():
            break
        met.append(frontier)
    return reduce(DataFrame.unionByName, met)
