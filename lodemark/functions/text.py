"""Text functions: entities, cleaning, similarity, records, literals, addresses and lenient JSON."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def coin(pair: Column) -> Column:
    """BTCUSDT to BTC."""
    return F.regexp_replace(F.upper(F.trim(pair)), "USDT$", "")


def pair(symbol: Column) -> Column:
    return F.concat(coin(symbol), F.lit("USDT"))


def entities(text: Column, patterns: dict[str, list[str]]) -> Column:
    """Sorted names one of whose words the text holds, whatever the case."""
    hits = (F.when(F.coalesce(text, F.lit("")).rlike(r"(?i)(?<!\w)(" + "|".join(words) + r")(?!\w)"), F.lit(name)) for name, words in sorted(patterns.items()))
    return F.array_compact(F.array(*hits))


def aliases(text: Column, names: dict[str, list[str]]) -> Column:
    """Sorted names one of whose aliases stands anywhere in the upper-cased text."""
    up = F.upper(F.coalesce(text, F.lit("")))

    def held(words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | up.contains(w.upper())
        return found

    return F.array_compact(F.array(*(F.when(held(words), F.lit(name)) for name, words in sorted(names.items()))))


def primary(found: Column, order: list[str]) -> Column:
    """The first of ``order`` that is found, else the first found."""
    return F.coalesce(*(F.when(F.array_contains(found, n), F.lit(n)) for n in order), F.get(found, F.lit(0)))


def clean(text: Column, most: int = 4000) -> Column:
    """Without addresses and control characters, white space collapsed, cut to ``most`` characters."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://\S+", " ")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    return F.substring(F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " ")), 1, most)


def mask(text: Column) -> Column:
    """Values of keys, tokens, secrets and passwords become ***."""
    return F.regexp_replace(text, r"""(?i)((?:api[_-]?key|token|secret|password)["']?\s*[:=]\s*["']?)[^"'\s,;]+""", "$1***")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer, of lower-cased texts; 1 for two empty ones."""
    x, y = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return F.coalesce(1 - F.try_divide(F.levenshtein(x, y), F.greatest(F.length(x), F.length(y))), F.lit(1.0))


def matching_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks over all characters, of lower-cased texts; 1 for two empty ones."""

    @F.pandas_udf("double")
    def ratio(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(xs, ys, strict=True)], dtype="float64")

    return ratio(a, b)


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of n words; a text of fewer is one."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\r\n]+"), lambda w: w != "")
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " ")))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def record(prompt: Column, answer: Column) -> Column:
    """Training record of an instruction and its answer, as one JSON object with ``text``."""
    return F.to_json(F.struct(F.concat(F.lit("<s>[INST] "), prompt, F.lit(" [/INST] "), answer, F.lit(" </s>")).alias("text")))


def sql_literal(value: Column, kind: str) -> Column:
    if kind == "string":
        return F.when(value.isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))
    if kind == "boolean":
        return F.when(value.isNull(), "NULL").when(value, "TRUE").otherwise("FALSE")
    plain = value.cast("double")
    return F.when(value.isNull() | F.isnan(plain) | (F.abs(plain) == float("inf")), "NULL").otherwise(value.cast("string"))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def next_page(url: Column) -> Column:
    """The address of the next page: ``page`` one higher, or added as 2."""
    page = F.regexp_extract(url, r"[?&]page=(\d+)", 1)
    base = F.regexp_replace(url, "#.*$", "")
    more = F.concat(base, F.when(F.instr(base, "?") > 0, "&").otherwise("?"), F.lit("page=2"))
    return F.when(page == "", more).otherwise(F.concat(F.regexp_extract(base, r"^(.*[?&]page=)\d+", 1), (page.try_cast("long") + 1).cast("string"), F.regexp_extract(base, r"[?&]page=\d+(.*)$", 1)))


def parsed_time(value: Column) -> Column:
    """ISO 8601 with or without a zone (then the session's, UTC), or milliseconds since 1970; null for anything else."""
    millis = F.when(value.rlike(r"^\d{12,14}$"), F.timestamp_millis(value.try_cast("long")))
    return F.coalesce(millis, F.try_to_timestamp(value))


def ab_bucket(key: Column, ratio: float) -> Column:
    """Whether the sum of the characters' codes, modulo 100, falls under ``ratio``."""
    codes = F.transform(F.split(key, ""), lambda c: F.ascii(c))
    return (F.aggregate(codes, F.lit(0), lambda a, x: a + x) % 100) / F.lit(100.0) < ratio


def lenient_json(text: Column, schema: str, default: Column) -> Column:
    """The object, or the one between the first { and the last }, or the default."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    whole = F.when(F.trim(text).rlike(r"(?s)^\{.*\}$"), F.from_json(text, schema))
    return F.coalesce(whole, F.when(inner != "", F.from_json(inner, schema)), default)


def normal_label(label: Column, confidence: Column, least: float = 0.0) -> tuple[Column, Column]:
    """Unknown labels are NEUTRAL, bad confidences 0.5, the others are held to [0, 1]; below ``least`` all is NEUTRAL."""
    up = F.upper(F.trim(label))
    c = F.least(F.greatest(F.coalesce(confidence.try_cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return F.when(up.isin("BULLISH", "BEARISH", "FUD", "NEUTRAL") & (c >= least), up).otherwise("NEUTRAL"), c


def sparkline(values: Column) -> Column:
    """One of seven bars for each value, from the least to the largest."""
    bars, low, high = "▁▂▃▄▅▆▇", F.array_min(values), F.array_max(values)
    return F.array_join(F.transform(values, lambda v: F.substr(F.lit(bars), F.coalesce(F.floor(F.try_divide((v - low) * 6, F.nullif(high - low, F.lit(0.0)))), F.lit(0)).cast("int") + 1, F.lit(1))), "")
