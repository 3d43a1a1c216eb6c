"""Text, records and model outputs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.functions import labels, models, text
from lodemark.operators.jaccard import jaccard_classes
from lodemark.operators.neardup import keep_first, near_titled
from lodemark.operators.rolling import with_next

from .registry import query
from .tables import candles, load, news_articles, sentiment_scores, ticks

COINS = {"LIC": ["license", "licence"], "APA": ["apache"], "THAT": ["that"], "WITH": ["with"], "FROM": ["from"]}


@query(
    r"SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^0-9A-Za-z_])({'|'.join(w)})($|[^0-9A-Za-z_])') THEN '{k}' END" for k, w in sorted(COINS.items())) + "], lambda x: x IS NOT NULL) AS found FROM documents"
)
def entity_extract(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.entities(F.col("text"), COINS).alias("found"))


@query(
    "SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(upper(text), {chr(39)}{x.upper()}{chr(39)})' for x in w)} THEN '{k}' END" for k, w in sorted(COINS.items())) + "], lambda x: x IS NOT NULL) AS found FROM documents"
)
def alias_extract(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.aliases(F.col("text"), COINS).alias("found"))


@query(r"SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' '), 4000) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query(r"""SELECT doc_id, regexp_replace(text, '(?i)((?:api[_-]?key|token|secret|password)["'']?\s*[:=]\s*["'']?)[^"''\s,;]+', '\1***', 'g') AS masked FROM documents""")
def mask_sensitive(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.mask(F.col("text")).alias("masked"))


LEXICONS = {"BEARISH": ["license"], "FUD": ["apache"], "BULLISH": ["that"]}


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'BEARISH' WHEN contains(lower(text), 'apache') THEN 'FUD' WHEN contains(lower(text), 'that') THEN 'BULLISH' ELSE 'NEUTRAL' END AS label, CASE WHEN contains(lower(text), 'license') THEN 0.75::DOUBLE WHEN contains(lower(text), 'apache') THEN 0.8 WHEN contains(lower(text), 'that') THEN 0.72 ELSE 0.55 END AS confidence FROM documents")
def keyword_heuristic(spark, sf_dir):
    label, confidence = labels.keyword_label(F.col("text"), LEXICONS, {"BEARISH": 0.75, "FUD": 0.8, "BULLISH": 0.72, "NEUTRAL": 0.55})
    return load(spark, sf_dir, "documents").select("doc_id", label.alias("label"), confidence.alias("confidence"))


@query(
    r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '') AS w FROM benchmark),
    s AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w) SELECT item_id, len(s) AS n, list_sort(s)[1] AS first FROM s"""
)
def word_shingles(spark, sf_dir):
    s = text.shingles(F.col("text"))
    return load(spark, sf_dir, "benchmark").select("item_id", F.size(s).cast("long").alias("n"), F.array_sort(s)[0].alias("first"))


@query()
def title_similarity(spark, sf_dir):
    """Each item's text beside the next one's: ratio of matching blocks, and edit distance; checked against difflib in the tests."""
    rows = with_next(load(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text").filter("next IS NOT NULL")
    return rows.select("item_id", F.round(text.matching_ratio(F.col("text"), F.col("next")), 6).alias("ratio"), F.round(text.similarity(F.col("text"), F.col("next")), 6).alias("similarity"))


@query()
def near_articles(spark, sf_dir):
    """Near-duplicate articles by the reference's rule: titles alike by 0.80 and three-word minima by 0.90."""
    return near_titled(news_articles(spark, sf_dir).select("id", "title", "content"))


@query()
def first_articles(spark, sf_dir):
    """Articles of which no earlier one that is kept is like them, by the same rule; checked against a plain loop in the tests."""
    return keep_first(news_articles(spark, sf_dir).select("id", "title", "content"))


@query()
def minhash_lsh_dedup(spark, sf_dir):
    """Class of each document by five-word Jaccard of 0.8 or more; checked against all pairs in the tests."""
    return jaccard_classes(load(spark, sf_dir, "documents").select("doc_id", "text")).select("id", "class_id")


@query(r"""SELECT event_id, '{"text":"' || '<s>[INST] Symbol ' || symbol || ' at ' || size || ' [/INST] ' || sentiment || ' </s>' || '"}' AS line FROM (SELECT *, CASE WHEN size >= 66 THEN 'BULLISH' ELSE 'NEUTRAL' END AS sentiment FROM ticks)""", "ticks")
def sft_records(spark, sf_dir):
    prompt = F.concat(F.lit("Symbol "), "symbol", F.lit(" at "), F.col("size").cast("string"))
    return ticks(spark, sf_dir).select("event_id", text.record(prompt, F.when(F.col("size") >= 66, "BULLISH").otherwise("NEUTRAL")).alias("line"))


@query("SELECT symbol, count(*) AS n FROM (SELECT symbol FROM ticks UNION ALL SELECT primary_symbol FROM news_articles WHERE length(content) >= 500 UNION ALL SELECT symbol FROM candles_1d) GROUP BY 1", "ticks", "news_articles", "candles_1d")
def training_union(spark, sf_dir):
    parts = [ticks(spark, sf_dir).select("symbol"), news_articles(spark, sf_dir).filter(F.length("content") >= 500).select(F.col("primary_symbol").alias("symbol")), candles(spark, sf_dir, "1d").select("symbol")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("symbol").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, (list_sum(list_transform(string_split(c_name, ''), lambda x: ascii(x))) % 100) / 100.0::DOUBLE < 0.3 AS treated FROM customer")
def ab_bucket(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", text.ab_bucket(F.col("c_name"), 0.3).alias("treated"))


@query()
def url_functions(spark, sf_dir):
    """Host and next page of every address; checked against urllib in the tests."""
    return load(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"), text.next_page(F.col("url")).alias("next"))


@query("SELECT n_nationkey, CASE WHEN n_name IS NULL THEN 'NULL' ELSE '''' || replace(n_name, '''', '''''') || '''' END AS literal, upper(trim(n_name)) || 'USDT' AS pair FROM nation")
def sql_literals(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", text.sql_literal(F.col("n_name"), "string").alias("literal"), text.pair(F.col("n_name")).alias("pair"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 2 THEN 'NEUTRAL' ELSE CASE WHEN size >= 50 THEN 'BULLISH' ELSE 'NEUTRAL' END END AS label, CASE WHEN user_id % 3 = 2 THEN 0.5::DOUBLE ELSE size / 100.0::DOUBLE END AS confidence FROM ticks""", "ticks")
def lenient_json(spark, sf_dir):
    """Replies that are JSON, hold JSON, or don't."""
    body = F.to_json(F.struct(F.when(F.col("size") >= 50, "bullish").otherwise("unclear").alias("sentiment"), (F.col("size") / F.lit(100.0)).cast("string").alias("confidence")))
    reply = F.when(F.col("user_id") % 3 == 0, body).when(F.col("user_id") % 3 == 1, F.concat(F.lit("Well: "), body, F.lit(" so."))).otherwise(F.lit("no idea"))
    default = F.struct(F.lit("NEUTRAL").alias("sentiment"), F.lit("0.5").alias("confidence"))
    parsed = text.lenient_json(reply, "sentiment string, confidence string", default)
    rows = ticks(spark, sf_dir).select("event_id", parsed.alias("p"))
    label, confidence = text.normal_label(F.col("p.sentiment"), F.col("p.confidence"))
    return rows.select("event_id", label.alias("label"), confidence.alias("confidence"))


def _learners():
    i = F.col("event_id")
    out = []
    for k in (7, 11, 13):
        up = (i % k) / F.lit(float(k))
        down = (1 - up) * ((i % (k - 2)) / F.lit(float(k - 2)))
        out.append({"UP": F.round(up, 4), "DOWN": F.round(down, 4), "SIDEWAYS": F.round(1 - F.round(up, 4) - F.round(down, 4), 4)})
    return out


def _learner_sql(k):
    return f"round((event_id % {k}) / {k}.0::DOUBLE, 4) AS u{k}, round((1 - (event_id % {k}) / {k}.0::DOUBLE) * ((event_id % {k - 2}) / {k - 2}.0::DOUBLE), 4) AS d{k}"


def _top(u, d, s):
    return f"CASE WHEN {u} = greatest({u}, {d}, {s}) THEN 'UP' WHEN {d} = greatest({u}, {d}, {s}) THEN 'DOWN' ELSE 'SIDEWAYS' END"


@query(
    f"""WITH a AS (SELECT event_id, {", ".join(map(_learner_sql, (7, 11, 13)))} FROM ticks), b AS (SELECT *, round(1 - u7 - d7, 4) AS s7, round(1 - u11 - d11, 4) AS s11, round(1 - u13 - d13, 4) AS s13 FROM a),
    c AS (SELECT *, round(0.3 * u7 + 0.4 * u11 + 0.3 * u13, 6) AS up, round(0.3 * d7 + 0.4 * d11 + 0.3 * d13, 6) AS down, round(0.3 * s7 + 0.4 * s11 + 0.3 * s13, 6) AS side, len(list_distinct([{_top('u7', 'd7', 's7')}, {_top('u11', 'd11', 's11')}, {_top('u13', 'd13', 's13')}])) AS tops,
      (greatest(u7, d7, s7) + greatest(u11, d11, s11) + greatest(u13, d13, s13)) / 3 AS m FROM b)
    SELECT event_id, up, down, side, round(least(greatest(m * CASE tops WHEN 1 THEN 1.2 WHEN 2 THEN 1.0 ELSE 0.7 END, 0), 1), 6) AS confidence FROM c""",
    "ticks",
)
def ensemble_vote(spark, sf_dir):
    made = models.ensemble(_learners())
    return ticks(spark, sf_dir).select("event_id", F.round(made["UP"], 6).alias("up"), F.round(made["DOWN"], 6).alias("down"), F.round(made["SIDEWAYS"], 6).alias("side"), F.round(made["confidence"], 6).alias("confidence"))


@query("SELECT event_id, round(price * (1 + size / 100.0::DOUBLE * 0.01 * CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END), 6) AS predicted, round(least(greatest(1 - (price * 0.2) / (2 * greatest(abs(price), 1e-9)), 0), 1), 6) AS confidence, [CAST(least(greatest(event_id % 5 - 1, 0), 2) = i AS INT) for i in [0, 1, 2]] AS hot FROM ticks", "ticks")
def prediction_functions(spark, sf_dir):
    i, p = F.col("event_id"), F.col("price")
    label = F.when(i % 3 == 0, "UP").when(i % 3 == 1, "DOWN").otherwise("SIDEWAYS")
    return ticks(spark, sf_dir).select("event_id", F.round(models.predicted_price(p, label, F.col("size") / F.lit(100.0)), 6).alias("predicted"), F.round(models.interval_confidence(p * 0.9, p * 1.1, p), 6).alias("confidence"), models.one_hot(i % 5 - 1).alias("hot"))


@query("SELECT symbol, source_type, sentiment_label, count(*) AS n FROM sentiment_scores GROUP BY 1, 2, 3", "sentiment_scores")
def histogram(spark, sf_dir):
    return sentiment_scores(spark, sf_dir).groupBy("symbol", "source_type", "sentiment_label").agg(F.count("*").alias("n"))


@query()
def direction_model(spark, sf_dir):
    """Accuracy by symbol, on the last fifth of bars, of a forest trained on the first four fifths."""
    from lodemark.functions.features import flat_frame
    from lodemark.operators.relational import chronological_split

    frame = flat_frame(candles(spark, sf_dir)).withColumn("label", (F.col("target") > F.col("close")).cast("double"))
    frame = chronological_split(frame, ["symbol"], "ts", 0.8)
    model = models.train_direction(frame.filter("part = 'train'"), ["return_1", "return_5", "volatility_20"])
    return model.transform(frame.filter("part = 'valid'")).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"))


@query(
    """WITH f AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS x, lead(close) OVER w / close - 1 AS y FROM candles_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, count(*) AS rows, 'trained' AS status, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept FROM f WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1""",
    "candles_1h",
)
def models_by_symbol(spark, sf_dir):
    """A model of the next return for each symbol, from the last one, as a table of artifacts."""
    w = Window.partitionBy("symbol").orderBy("ts")
    frame = candles(spark, sf_dir).select("symbol", (F.col("close") / F.lag("close").over(w) - 1).alias("x"), (F.lead("close").over(w) / F.col("close") - 1).alias("y"))
    fitted = models.train_each(frame, "symbol", ["x"], "y", least_rows=2)
    return fitted.select("symbol", "rows", "status", F.round(F.get("weights", F.lit(1)), 5).alias("slope"), F.round(F.get("weights", F.lit(0)), 5).alias("intercept"))


@query("SELECT symbol, list(close ORDER BY ts) AS closes, count(*) AS n FROM candles_1d GROUP BY 1", "candles_1d")
def sparkline_input(spark, sf_dir):
    return candles(spark, sf_dir, "1d").groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "close"))), lambda x: x["close"]).alias("closes"), F.count("*").alias("n"))
