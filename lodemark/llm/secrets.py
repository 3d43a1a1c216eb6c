"""Secret scan: candidates by pattern, false positives removed by a random forest, in DataFrame operations and Spark's ML only.

A candidate is a run of at least 16 characters of keys with a digit, or of 20 without one that changes case in two places, a private key block, the password within an
address, or whatever is assigned to a secret's name by ``=`` or ``:``, be it as short and of such characters as it may. What tells a key from an identifier, a path, a digest or a number is
its length, how often the character class changes, how much of it dictionary words cover, whether it is part of a path, and the words
next to it. The forest learns that from labelled findings: a table of (before, candidate, after, label).
"""

from __future__ import annotations

import functools

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.storage import save

from .common import read_table

#: What can end the name of a secret, and what stands between it and its value. The first lookbehinds are short and spare most places the long one.
NAMED = r"(?:secret(?!ar)|token(?!i)|passw(?:or)?d|passphrase|pwd|api[_-]?key|auth(?!or)|bearer|credential|private[_-]?key|access[_-]?key|signature)"
ASSIGNED = r"(?<=[:= \t\"'`])(?<=[:=][ \t]{0,3}[\"'`]?)(?<=(?i:" + NAMED + r")[A-Za-z0-9_-]{0,16}[\"'`\]]{0,2}[ \t]{0,3}[:=]{1,2}[ \t]{0,3}[\"'`]?)"
#: Where another name is assigned to: there a value without quotes ends.
NEXT = r"[A-Za-z_][\w .-]{0,30}(?:=|:[ \t])"
#: A value in quotes goes to the closing one, else to white space, a quote, &, a comma or semicolon at the end or before the next name.
VALUE = ASSIGNED + r"(?:(?<=[\"'`])[^\"'`\r\n]++(?=[\"'`])|(?<![\"'`])(?![:=])(?:[^\s\"'`&<>,;]++|[,;](?![\s\"'`]|$|" + NEXT + r"))++)"
#: A run of characters of keys with a digit, or one that changes case in two places. Most words are too short for either.
RUN = r"(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
MIXED = r"(?=[A-Za-z+/_-]*?[a-z][A-Z][A-Za-z+/_-]*?[a-z][A-Z])[A-Za-z+/_-]{20,}+(?![0-9])"
WORDS = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})(?:" + RUN + "|" + MIXED + ")"
#: The body of a block holds no five hyphens, so it is never read twice.
BODY = r"[A-Za-z0-9+/=,:\s]*+(?:-{1,4}+(?!-)[A-Za-z0-9+/=,:\s]*+)*+"
BLOCK = r"-----BEGIN (?:[A-Z]{1,16} ){0,4}PRIVATE KEY-----" + BODY + r"-----END (?:[A-Z]{1,16} ){0,4}PRIVATE KEY-----"
ADDRESS = r"(?<=[^\s:/@]:)(?<=://[^\s:/@]{1,64}:)[^\s:/@]++(?=@)"
CANDIDATE = f"(?:{BLOCK}|{ADDRESS}|{VALUE}|{WORDS})"
#: Stands around candidates while a text is cut; no character of any writing.
MARK = "\ufdd0"
BEFORE, AFTER = 48, 16
SECRET_WORDS = ("secret", "token", "password", "passwd", "pwd", "api[_-]?key", "apikey", "auth", "bearer", "credential", "private", "access[_-]?key", "signature")
OTHER_WORDS = ("commit", "sha", "md5", "hash", "checksum", "digest", "uuid", "guid", "etag", "revision", "version", "build", "card", "phone", "isbn", "order", "http", "www", "file", "path", "image")
DICTIONARY = (
    "access", "account", "admin", "article", "assets", "backup", "build", "cache", "client", "config", "content", "data", "default", "demo", "docs", "download", "example", "file", "final", "report",
    "home", "image", "index", "insert", "item", "library", "local", "main", "model", "module", "news", "node", "package", "page", "password", "photo", "placeholder", "post", "product", "project",
    "public", "python", "release", "sample", "script", "server", "service", "site", "source", "static", "story", "style", "system", "table", "test", "token", "update", "upload", "user", "version", "video", "your", "here",
)


def share(text: Column, kept: Column) -> Column:
    """Part of the characters that are gone in ``kept``."""
    return 1 - F.length(kept) / F.greatest(F.length(text), F.lit(1))


def features(before: Column, candidate: Column, after: Column) -> dict[str, Column]:
    low = F.lower(before)
    near = F.right(low, F.lit(24))
    n = F.greatest(F.length(candidate), F.lit(1))
    return {
        "chars": F.log2(n),
        "transitions": F.regexp_count(candidate, F.lit(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_-])(?=[A-Za-z0-9])")) / n,
        "digits": share(candidate, F.translate(candidate, "0123456789", "")),
        "upper": share(candidate, F.translate(candidate, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
        "hexadecimal": candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("int"),
        "kinds": F.size(F.array_distinct(F.split(candidate, ""))) / F.least(n, F.lit(64)),
        "dictionary": share(candidate, F.regexp_replace(F.lower(candidate), "|".join(DICTIONARY), "")),
        "symbols": share(candidate, F.regexp_replace(candidate, r"[^\sA-Za-z0-9+/_=-]", "")),
        "blanks": share(candidate, F.regexp_replace(candidate, r"\s", "")),
        "code": candidate.rlike(r"[(){}\[\]$<>]|^[A-Za-z_]\w*(\.[A-Za-z_]\w*)+$").cast("int"),
        "vowels": share(F.lower(candidate), F.translate(F.lower(candidate), "aeiou", "")),
        "plain": candidate.rlike(r"^([A-Z]?[a-z]+|[A-Z]+)[.:!?]?$").cast("int"),
        "separators": share(candidate, F.translate(candidate, "_-", "")),
        "slashes": share(candidate, F.translate(candidate, "/", "")),
        "block": candidate.startswith("-----BEGIN ").cast("int"),
        "in_address": (before.rlike("://[^ /@]+:$") & after.startswith("@")).cast("int"),
        "grouped": candidate.rlike("^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$").cast("int"),
        "in_path": (before.rlike(r"[/.@\\]$") | after.rlike(r"^[/.@\\]")).cast("int"),
        "secret_word": near.rlike("|".join(SECRET_WORDS)).cast("int"),
        "other_word": near.rlike("|".join(OTHER_WORDS)).cast("int"),
        "assigned": before.rlike(r"""[:=]\s{0,3}["'`]?$""").cast("int"),
        "quoted": (before.rlike(r"""["'`]$""") & after.rlike(r"""^["'`]""")).cast("int"),
    }


NAMES = ["chars", "transitions", "digits", "upper", "hexadecimal", "kinds", "dictionary", "symbols", "blanks", "code", "vowels", "plain", "separators", "slashes", "block", "in_address", "grouped", "in_path", "secret_word", "other_word", "assigned", "quoted"]


def with_features(rows: DataFrame) -> DataFrame:
    made = rows.withColumns({k: v.cast("double") for k, v in features(F.col("before"), F.col("candidate"), F.col("after")).items()})
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(made)


def labelled_findings(spark: SparkSession, n: int = 8000, seed: int = 5) -> DataFrame:
    """Findings (template, before, candidate, after, label) made by rule, for use where nobody has labelled any: about half of them keys in their usual places.

    Words in them are of the dictionary or, as often, made up of syllables, so that the forest can't take the dictionary for all there is.
    """

    drawn: dict[int, Column] = {}  # hashes of the id, each in a column of its own

    def some(k: int) -> Column:
        drawn[k] = F.sha2(F.concat(F.lit(f"{seed}:{k}:"), F.col("id").cast("string")), 256)
        return F.col(f"h{k}")

    def base64(k: int, chars: int) -> Column:
        return F.substring(F.translate(F.base64(F.unhex(F.concat(some(k), some(k + 50)))), "=", "x"), 1, chars)

    def pick(k: int, *options: str) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (F.conv(F.substring(some(k), 1, 6), 16, 10).cast("int") % len(options) + 1).cast("int"))

    prose = pick(1, "and then the ", "of this. The ", "with a line ", "\n", "; ", "see there, ")
    syllables = ("ba", "cor", "di", "fen", "gu", "hal", "ki", "lom", "mer", "no", "pra", "qui", "ros", "sta", "ter", "vo")
    made = [F.concat(*(pick(j, *syllables) for j in (60 + 3 * k, 61 + 3 * k, 62 + 3 * k))) for k in range(3)]
    words = [F.when(F.conv(F.substring(some(70 + k), 1, 2), 16, 10).cast("int") % 2 == 0, pick(10 + k, *DICTIONARY[k::3])).otherwise(made[k]) for k in range(3)]
    digits = F.translate(some(2), "abcdef", "012345")
    key_name = pick(3, "token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "TOKEN", "ApiKey", "private_key")
    join = pick(4, " = \"", ": \"", "=", " = '", ": ", "\": \"")
    close = F.when(join.endswith("\""), F.lit("\"")).when(join.endswith("'"), F.lit("'")).otherwise(F.lit(" "))
    number = pick(5, "16", "20", "32", "40", "64").cast("int")
    hexadecimal = F.substring(some(6), F.lit(1), number)
    cases = [
        (F.concat(key_name, join), hexadecimal, close, 1),
        (F.concat(key_name, join), F.upper(hexadecimal), close, 1),
        (F.concat(key_name, join), F.substring(base64(7, 64), F.lit(1), number), close, 1),
        (F.concat(pick(8, "Authorization: Bearer ", "bearer "), F.lit("")), base64(7, 48), F.lit("\n"), 1),
        (F.concat(pick(8, "aws_access_key_id = ", "AccessKey: "), F.lit("")), F.concat(F.lit("AKIA"), F.upper(F.substring(some(9), 1, 16))), F.lit("\n"), 1),
        (F.concat(pick(8, "key ", "login ", "use "), join), base64(7, 40), close, 1),
        (pick(8, "commit ", "sha1 ", "revision ", "hash: "), F.substring(some(6), 1, 40), F.lit(" "), 0),
        (pick(8, "sha256:", "md5 ", "checksum=", "digest "), F.when(F.col("id") % 2 == 0, some(6)).otherwise(F.substring(some(6), 1, 32)), F.lit(" "), 0),
        (pick(8, "uuid ", "id=", "request ", "order "), F.regexp_replace(F.substring(some(6), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(" "), 0),
        (pick(8, "in /", "file ", "from https://example.com/"), F.concat(words[0], F.lit("/"), words[1], F.lit("/"), words[2], F.substring(digits, 1, 4)), pick(9, ".html", ".py ", "/"), 0),
        (F.concat(key_name, join), F.concat(F.lit("your_"), words[0], F.lit("_"), words[1], F.lit("_"), F.substring(digits, 1, 4)), close, 0),
        (pick(8, "number ", "card ", "", "call ", "page "), F.substring(digits, F.lit(1), pick(9, "16", "17", "19", "24").cast("int")), pick(9, " ", ". ", ", "), 0),
        (pick(8, "", "image ", "see "), F.concat(words[0], F.lit("_"), words[1], F.lit("-"), words[2], F.substring(digits, 1, 3)), F.lit(" "), 0),
        (F.concat(key_name, join), F.concat(F.repeat(F.lit("x"), 15), F.substring(digits, 1, 1), F.repeat(F.lit("0"), 8)), close, 0),
        (F.concat(key_name, join), F.substring(F.translate(base64(7, 64), "0123456789", "qXvKzRwTmB"), F.lit(1), pick(9, "10", "16", "24", "40").cast("int")), close, 1),
        (F.concat(key_name, join), F.substring(F.translate(some(6), "0123456789", "ghjkmnpqrs"), F.lit(1), pick(9, "12", "20", "32").cast("int")), close, 1),
        (F.concat(pick(8, "password", "passwd", "pwd", "DB_PASSWORD"), join), F.concat(F.substring(base64(7, 8), 2, 5), pick(9, "!", "#", "@", "$", "%", "*"), F.substring(digits, 1, 2), pick(21, "", "!", "x", "?")), close, 1),
        (F.concat(pick(8, "password", "passwd", "pwd", "DB_PASSWORD"), join), F.concat(words[0], pick(9, "!", "#", "@", "$", "%"), F.substring(digits, 1, 3)), close, 1),
        (F.concat(key_name, join), pick(9, "None", "null", "true", "false", "the", "see", "required", "string", "optional", "this", "is", "undefined", "changeme", "it", "str", "An", "some"), pick(21, ",", " ", "\n", ")"), 0),
        (F.concat(key_name, join), F.concat(words[0], pick(9, "", ".", "_", "-"), words[1]), close, 0),
        (pick(8, "", "key.pem\n", "as follows:\n"), F.concat(F.lit("-----BEGIN "), pick(9, "", "RSA ", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----\n"), base64(7, 64), F.lit("\n"), base64(22, 64), F.lit("\n-----END "), pick(9, "", "RSA ", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----")), F.lit("\n"), 1),
        (F.concat(pick(8, "postgres://", "https://", "redis://", "amqp://"), words[0], F.lit(":")), F.concat(F.substring(base64(7, 16), 1, 9), pick(9, "", "!", "-x")), F.concat(F.lit("@"), words[1], F.lit(".example")), 1),
        (F.concat(key_name, join), F.concat(base64(7, 30), F.upper(words[0])), close, 1),
        (pick(8, "", "see ", "class ", "call "), F.concat(F.initcap(words[0]), F.initcap(words[1]), F.initcap(words[2]), pick(9, "Handler", "ServiceFactory", "Test", "Builder")), pick(21, "(", " ", ".", ":"), 0),
        (pick(8, "key ", "use ", ""), F.translate(base64(7, 44), "0123456789", "qXvKzRwTmB"), F.lit(" "), 1),
        (F.concat(key_name, pick(4, " = ", "=", ": ")), F.concat(pick(8, "self.", "os.environ[", "get_", "process.env.", "${", "config.", "request.", "read("), pick(9, "token", "password", "key", "auth_key", "secret"), pick(21, "", "()", "]", "}", ")")), F.lit("\n"), 0),
        (F.concat(key_name, pick(4, " = \"", ": \"")), F.concat_ws(" ", pick(9, "Enter", "The", "Your", "Please give", "Invalid"), words[0], words[1]), F.lit("\""), 0),
    ]
    rows, out = save(spark.range(0, n, 1, 1).select("id", *(c.alias(f"h{k}") for k, c in sorted(drawn.items()))), "drawn"), None
    which = (F.col("id") % len(cases)).cast("int")
    for first in range(0, len(cases), 7):  # more at once is too much for one generated method
        some_cases = range(first, min(first + 7, len(cases)))
        before, candidate, after, label = (functools.reduce(lambda out, k, j=j: F.when(which == k, cases[k][j]).otherwise(out), some_cases, F.lit(None)) for j in range(4))
        part = rows.filter(which.between(some_cases[0], some_cases[-1])).select(which.alias("template"), F.concat(prose, before).alias("before"), candidate.alias("candidate"), after.alias("after"), label.alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


def train(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 5) -> RandomForestClassificationModel:
    """``findings``: before, candidate, after, label (1: a secret). Rows with a null candidate or label are left out."""
    rows = findings.select(F.coalesce("before", F.lit("")).alias("before"), "candidate", F.coalesce("after", F.lit("")).alias("after"), F.col("label").cast("double").alias("label")).dropna()
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(save(with_features(save(rows, "findings")).select("features", "label"), "features"))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ordinal (from 0), before, candidate, after: ``BEFORE`` and ``AFTER`` characters of the text around each candidate."""
    marked = F.regexp_replace(F.translate(F.col(text), MARK, "\ufffd"), CANDIDATE, f"{MARK}$0{MARK}")
    found = docs.select(F.col(key).alias("doc_id"), marked.alias("marked")).filter(F.contains("marked", F.lit(MARK)))
    # Text and candidates in turn. Neighbouring candidates are a character or more apart, so 2 * BEFORE parts are long enough; long ones are cut first.
    found = found.select("doc_id", F.split("marked", MARK, -1).alias("parts"))
    found = found.withColumn("found", F.filter("parts", lambda p, i: i % 2 == 1))
    found = found.withColumn("tails", F.transform("parts", lambda p: F.right(p, F.lit(BEFORE)))).withColumn("heads", F.transform("parts", lambda p: F.left(p, F.lit(AFTER))))
    before = lambda i: F.array_join(F.slice("tails", F.greatest(2 * i + 2 - 2 * BEFORE, F.lit(1)), F.least(2 * i + 1, F.lit(2 * BEFORE))), "")
    one = F.transform("found", lambda c, i: F.struct(F.right(before(i), F.lit(BEFORE)).alias("before"), c.alias("candidate"), F.left(F.array_join(F.slice("heads", 2 * i + 3, 2 * AFTER), ""), F.lit(AFTER)).alias("after")))
    return found.select("doc_id", F.posexplode(one).alias("ordinal", "c")).select("doc_id", "ordinal", "c.*")


def secret_scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ordinal, candidate, probability, is_secret for each candidate.

    A value without quotes ends where another name is assigned to (``password=a;user=b``). The noncharacter U+FDD0, which no writing uses, is read as U+FFFD.
    Null and empty texts have none; rows that repeat and null ids are kept as they are, equal candidates of a text each; a key as long as the text is one candidate, and
    texts of any length are read whole. Columns other than key and text aren't read, whatever their names. An empty table gives no rows.
    ``findings``: labelled findings of one's own in place of those made by rule.
    """
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    scored = model.transform(with_features(candidates(docs, key, text)))
    probability = vector_to_array("probability")[1]
    return scored.select("doc_id", "ordinal", "candidate", probability.alias("probability"), (probability >= threshold).alias("is_secret"))


def op5_secret_forest(spark, sf_dir):
    return secret_scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
