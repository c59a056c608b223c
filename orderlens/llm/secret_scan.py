"""Secret scan: candidates by their shape, and a random forest that takes out false positives.

A candidate is a run of at least 12 key-like characters with a digit among them or a provider's prefix (of ``name=value`` the value
counts), or any quoted or unbroken value of at least 6 characters after the name of a credential and = or :. The
forest (Spark's own) sees its length, letters and digits, changes between kinds of characters, how much of it dictionary words cover, path marks, and the words around it. The dictionary holds the most
frequent words of all documents. The forest is trained on labelled findings, at most ``most_findings`` of them,
in the order of a hash. Where no one has labelled findings, ``labelled_by_format`` labels those that a
provider's format, or an address or number format, settles; the forest then judges all candidates. Several features
(prefix, name, quotes, signs) are what these rules look at, so such a forest says of the settled findings what the rules say,
and only the others are its own judgement.

Runs and values may be of any length. Everything is DataFrame operations on one scan of the texts; a finding is a distinct value of a document. Null
and empty texts have no findings. Null ids keep their findings (doc_id null); repeated rows give their
findings once each. Without labelled findings of both kinds every candidate is kept, with score 1.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

#: Beginnings that providers give their keys.
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk-", "AIza"]
CANDIDATE = (r"(?<![A-Za-z0-9_+/=.@-])(?:(?=[A-Za-z_+/=.@-]*+[0-9])|(?=" + "|".join(PREFIXES) + "))[A-Za-z0-9_+/=.@-]{12,}+")
#: Names of credentials, and names of things that look like them.
SECRET_WORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "auth", "bearer",
                "credential", "private_key", "client_secret", "key"]
OTHER_WORDS = ["sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "uuid", "guid", "hash", "mail", "phone",
               "isbn", "version", "card", "order", "invoice"]
#: The name of a credential up to the value given to it, and such a value with its quotes or without.
LEAD = r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|credentials?|(?:api|access|private|secret)[_-]?key|(?<![a-z])(?:key|auth|bearer))[\"'`]?[ \t]{0,8}[=:]{1,2}[ \t]{0,8}"
GIVEN = LEAD + r"(?:\"[^\"\n]{6,}+\"|'[^'\n]{6,}+'|`[^`\n]{6,}+`|[\"'`]?[^\s\"'`]{6,}+)"
FEATURES = ["size", "digits", "uppers", "lowers", "hexes", "turns", "case_turns", "distinct_chars", "covered", "slashes", "dots",
            "ats", "dashes", "prefixed", "assigned", "quoted", "secret_words", "other_words", "before_letters", "after_letters"]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, value, name, first_at, times, before, after: distinct candidate values of each document."""
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns({
        "found": F.array_distinct(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))),
        "given": F.array_distinct(F.regexp_extract_all("text", F.lit(GIVEN), F.lit(0)))})

    def times(c: Column) -> Column:
        return ((F.length("text") - F.length(F.replace(F.col("text"), c, F.lit("")))) / F.greatest(F.length(c), F.lit(1))).cast("int")

    def before(at: Column) -> Column:
        return F.substring(F.col("text"), F.greatest(at - 48, F.lit(1)), F.least(at - 1, F.lit(48)))

    def after(at: Column, c: Column) -> Column:
        return F.substring(F.col("text"), at + F.length(c), F.lit(32))

    def given(c: Column) -> Column:
        lead = F.regexp_extract(c, f"^{LEAD}[\"'`]?", 0)
        value = F.regexp_replace(F.regexp_replace(F.substring(c, F.length(lead) + 1, F.length(c)), "[\"'`]$", ""), r"[.,;:)\]}]+$", "")
        at = F.position(c, F.col("text")) + F.length(lead)
        return F.struct(value.alias("value"), F.lit("").alias("name"), at.alias("at"), times(value).alias("times"),
                        before(at).alias("before"), after(at, value).alias("after"))

    def run(c: Column) -> Column:
        parts = r"^([A-Za-z][A-Za-z0-9_.-]*)=(.{6,})$"
        named = F.regexp_extract(c, parts, 1)
        value = F.regexp_replace(F.when(named != "", F.regexp_extract(c, parts, 2)).otherwise(c), "[.]+$", "")
        at = F.position(c, F.col("text"))
        return F.struct(value.alias("value"), F.lower(named).alias("name"), at.alias("at"), times(c).alias("times"),
                        before(at).alias("before"), after(at, c).alias("after"))

    # a value that both forms give counts once, with the words around it where it is given
    each = (rows.filter((F.size("found") > 0) | (F.size("given") > 0))
            .withColumn("given", F.filter(F.transform("given", given), lambda x: F.length(x["value"]) >= 6))
            .withColumn("values", F.transform("given", lambda x: x["value"]))
            .withColumn("given", F.filter("given", lambda x, i: F.array_position("values", x["value"]) == i + 1))
            .withColumn("found", F.filter(F.transform("found", run), lambda x: ~F.array_contains("values", x["value"])))
            .select("doc_id", F.explode(F.concat("given", "found")).alias("c")))
    return each.select("doc_id", "c.value", "c.name", F.col("c.at").alias("first_at"), "c.times", "c.before", "c.after")


def dictionary(docs: DataFrame, most: int = 600, shortest: int = 3, longest: int = 8) -> list[str]:
    """The most frequent words of all texts; a fixed number of them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![a-z0-9])[a-z]{{{shortest},{longest}}}(?![a-z0-9])"), F.lit(0))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").count()
    return [r.word for r in counted.orderBy(F.desc("count"), "word").limit(most).collect()]


def _count(value: str | Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def _mentions(text: Column, words: list[str]) -> Column:
    return _count(text, r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])")


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """The findings with the columns of FEATURES."""
    size = F.greatest(F.length("value"), F.lit(1)).cast("double")
    pieces = F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))
    known = F.array(*map(F.lit, words)).cast("array<string>")
    covered = F.aggregate(F.filter(pieces, lambda p: F.array_contains(known, p)), F.lit(0), lambda a, p: a + F.length(p))
    near = F.concat_ws(" ", F.lower(F.regexp_extract("before", r"(\S+\s+\S*)\s*\S*$", 0)), F.nullif(F.col("name"), F.lit("")))
    return found.withColumns({
        "size": size, "digits": _count("value", "[0-9]") / size, "uppers": _count("value", "[A-Z]") / size,
        "lowers": _count("value", "[a-z]") / size, "hexes": _count("value", "[0-9a-fA-F]") / size,
        "turns": _count("value", "[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])") / size,
        "case_turns": _count("value", "[a-z](?=[A-Z])|[A-Z](?=[a-z])") / size,
        "distinct_chars": F.size(F.array_distinct(F.split("value", ""))) / size,
        "covered": covered / size, "slashes": _count("value", "/"), "dots": _count("value", "[.]"), "ats": _count("value", "@"),
        "dashes": _count("value", "-"), "prefixed": F.col("value").rlike("^(?:" + "|".join(PREFIXES) + ")").cast("double"),
        "assigned": ((F.col("name") != "") | F.col("before").rlike(r"[=:]\s*[\"']?$")).cast("double"),
        "quoted": F.col("before").rlike("[\"'`]$").cast("double"),
        "secret_words": _mentions(near, SECRET_WORDS), "other_words": _mentions(near, OTHER_WORDS),
        "before_letters": _count("before", "[A-Za-z]") / 48.0, "after_letters": _count("after", "[A-Za-z]") / 32.0})


def labelled_by_format(found: DataFrame) -> DataFrame:
    """Findings with ``label`` where their format settles it."""
    name = F.concat_ws(" ", F.lower("before"), F.nullif(F.col("name"), F.lit("")))
    credential = name.rlike(r"(password|passwd|passphrase|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key)[\"'`]?(\s*[=:]+\s*[\"'`]?)?$")
    provider = F.col("value").rlike(r"^AKIA[A-Z0-9]{16}$")
    given = (name.rlike(r"(password|passwd|secret|token|api_?key)(\s*[=:]\s*[\"']?)?$") & ~F.col("value").rlike("[.@/]")
             & F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]"))
    address = F.col("value").rlike(r"@|^[0-9.+-]+$|^[0-9]+(\.[0-9]+)+$|\.(com|net|org|html?)")
    # after a credential's name marks and figures settle nothing, but a whole address, a reference or plain words do
    other = (F.col("value").rlike(r"^([a-z]+://)?[A-Za-z0-9._+-]+(@[A-Za-z0-9-]+)?\.(com|net|org|html?)(/|$)|^(\$|<|\{\{|%[(A-Z])")
             | ((F.col("quoted") == 0) & (F.col("covered") >= 1) & (F.col("turns") == 0)))
    harmless = F.when(credential, other).otherwise(address)
    # nor does a value need figures: in quotes, or longer than words are, it is what the name says
    plain = (credential & ((F.col("quoted") > 0) | (F.col("size") >= 16)) & (F.col("covered") < 0.5) & ~F.col("value").rlike(r"[\s()\[\]./]"))
    return found.withColumn("label", F.when(harmless, 0.0).when(provider | given | plain, 1.0)).filter("label is not null")


def fit(labelled: DataFrame, most_findings: int = 20_000, trees: int = 30, depth: int = 6, seed: int = 3) -> RandomForestClassificationModel | None:
    """A forest on ``label`` over FEATURES; None without both labels."""
    order = F.xxhash64("doc_id", "value", F.lit(seed))
    rows = stage(labelled.orderBy(order, "doc_id", "value").limit(most_findings).select(*FEATURES, "label"), "labelled-findings")
    if rows.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="vector", handleInvalid="keep").transform(rows)
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(assembled.select("vector", "label"))


def judge(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """The findings with score, the forest's share of votes for a secret."""
    if model is None:
        return found.withColumn("score", F.lit(1.0))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector", handleInvalid="keep").transform(found)
    return model.transform(vectors).withColumn("score", F.round(vector_to_array("probability")[1], 6))


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, value, first_at (from 1), times, score, secret: one row for each distinct candidate of a document.

    ``labelled`` are findings with FEATURES and a label; without them those that a format settles are taken.
    """
    found = stage(features(candidates(docs), dictionary(docs)), "candidates")
    model = fit(labelled if labelled is not None else labelled_by_format(found))
    return (judge(found, model).withColumn("secret", F.col("score") >= threshold)
            .select("doc_id", "value", "first_at", "times", "score", "secret"))


def redact(docs: DataFrame, labelled: DataFrame | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced, and ``n_chars``, where there is one, counted anew.

    Findings return to their documents by a digest of the text, so null and repeated ids do no harm.
    """
    digest = F.md5(F.coalesce("text", F.lit("")))
    keyed = docs.select(digest.alias("doc_id"), "text")
    secrets = scan(keyed, labelled).filter("secret").groupBy("doc_id").agg(F.collect_set("value").alias("values"))
    rows = docs.select(F.struct("*").alias("doc"), digest.alias("digest")).join(
        stage(secrets, "secrets").withColumnRenamed("doc_id", "digest"), "digest", "left")
    # one pass from left to right, longer values first: a mark is never searched again, and a value that begins or
    # ends with a letter or digit is none inside a longer word
    ordered = F.array_sort("values", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    edge = lambda v, at, guard: F.when(v.rlike(at), F.lit(guard)).otherwise(F.lit(""))
    quoted = F.transform(ordered, lambda v: F.concat(
        edge(v, "^[A-Za-z0-9]", "(?<![A-Za-z0-9])"), F.lit("\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"),
        edge(v, "[A-Za-z0-9]$", "(?![A-Za-z0-9])")))
    literal = mark.replace("\\", "\\\\").replace("$", "\\$")
    text = F.when(F.col("values").isNull(), F.col("doc.text")).otherwise(
        F.regexp_replace(F.col("doc.text"), F.array_join(quoted, "|"), F.lit(literal)))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("values").isNull(), F.col("doc.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[(out[c] if c in out else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
