"""Secret scan with linking of multipart credentials. Built-in functions only.

Five patterns give parts with code-point offsets: the text between matches and
the matches themselves alternate, so running sums of their lengths are the
offsets. Sure parts (``assign``, ``access``, ``hex``) are always reported. Weak
parts (``endpoint``, ``identifier``, ``weak``: a short or assigned value, or 16 to 31
hex digits) are reported only when both complementary roles start within
``SCOPE`` code points. That is an interval join on (document, block of SCOPE
code points): a block holds one row per role with its first and last start, so
a part meets at most nine rows, however dense the document is.

Defined cases: null text counts as empty; equal rows get equal results; spans of one kind never overlap;
columns other than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statwarden.llm.registry import query, table
from statwarden.llm.shared import row_key

SCOPE = 200
KINDS = ("assign", "access", "hex", "endpoint", "identifier", "weak")
ROLES = {"assign": "secret", "hex": "secret", "weak": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
SURE = KINDS[:3]


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


VALUE = r"""["']?\x20*[:=]\x20*["']?"""
WORDS = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")])
NAMES = "|".join([*map(any_case, ("username", "user", "login", "account")), any_case("client") + "_?" + any_case("id")])
SCHEMES = "https?|ftp|postgresql|postgres|mysql|mongodb|redis|amqp|s3"
PATTERNS = {
    "assign": rf"({WORDS}){VALUE}([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
    "endpoint": rf"(?:{SCHEMES})://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+",
    "identifier": rf"(?:{NAMES}){VALUE}[A-Za-z0-9@._+-]+",
}


def pieces(text: Column, kind: str) -> Column:
    """For each match: the length of the text before it since the last one, its own length, the length of its value."""
    pattern = PATTERNS[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    value = (lambda m: F.length(F.regexp_extract(m, pattern, 2))) if kind == "assign" else F.length
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.length(m).alias("long"), value(m).alias("value")))
    both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m["long"].alias("long"), m["value"].alias("value")))
    return F.when(text.rlike(pattern), both)


def parts(docs: DataFrame) -> DataFrame:
    """One row per match: ``_id``, ``_h``, kind, start, end (code points, end exclusive)."""
    text = F.col("text")
    found = docs.select(*row_key(), *[pieces(text, k).alias(k) for k in PATTERNS])
    found = found.where(reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in PATTERNS])).dropDuplicates(["_id", "_h"])
    listed = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in PATTERNS]), lambda x: x["found"].isNotNull())
    rows = found.select("_id", "_h", F.explode(listed).alias("x")).select("_id", "_h", "x.kind", F.posexplode("x.found").alias("at", "m"))
    w = W.partitionBy("_id", "_h", "kind").orderBy("at")
    start = F.sum(F.col("m.gap") + F.col("m.long")).over(w) - F.col("m.long")
    rows = rows.select("_id", "_h", "kind", start.alias("start"), (start + F.col("m.long")).alias("end"), "m.value")
    return rows.withColumn("kind", graded(F.col("kind"), F.col("end") - F.col("start"), F.col("value"))).where("kind IS NOT NULL").drop("value")


def graded(kind: Column, long: Column, value: Column) -> Column:
    """The kind by which a match is reported, null for none."""
    return (
        F.when((kind == "assign") & (value < 8), "weak")
        .when((kind == "hex") & (long < 32), "weak")
        .when((kind == "access") & (long < 16), None)
        .otherwise(kind)
    )


def reported(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Sure parts, and weak ones with both complementary roles within ``scope``."""
    role = F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.col("kind"))
    rows = found.withColumn("role", role)
    block = F.floor(F.col("start") / scope)
    blocks = rows.groupBy("_id", "_h", block.alias("block"), "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = rows.where(~F.col("kind").isin(*SURE)).withColumn("block", F.explode(F.sequence(block - 1, block + 1)))
    other = blocks.withColumnRenamed("role", "other")
    near = (F.col("other") != F.col("role")) & (F.col("last") >= F.col("start") - scope) & (F.col("first") <= F.col("start") + scope)
    linked = (
        weak.join(other, ["_id", "_h", "block"]).where(near)
        .groupBy("_id", "_h", "kind", "start", "end").agg(F.count_distinct("other").alias("roles"))
        .where("roles = 2").drop("roles")
    )
    return rows.where(F.col("kind").isin(*SURE)).drop("role").unionByName(linked)


def spans_of(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and reported spans of each document, sorted by start, then kind as listed."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    per = reported(parts(docs), scope).groupBy("_id", "_h").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    own = docs.select("doc_id", *row_key()).join(per, ["_id", "_h"], "left")
    return own.select("doc_id", F.coalesce("spans", F.array().cast(per.schema["spans"].dataType)).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    found = spans_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(SURE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in SURE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, unnest(string_split_regex(text, '{p}')) AS gap, unnest(regexp_extract_all(text, '{p}')) AS m,"
        f" unnest(regexp_extract_all(text, '{p}', {2 if k == 'assign' else 0})) AS v, generate_subscripts(string_split_regex(text, '{p}'), 1) AS nth FROM d"
        for k, p in quoted.items()
    )
    roles = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLES.items())
    ranks = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({found}),
p AS (SELECT doc_id, kind, length(m) AS long, length(v) AS value,
        CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY nth) AS BIGINT) AS stop FROM f WHERE m IS NOT NULL),
g AS (SELECT doc_id, stop - long AS start, stop,
        CASE WHEN kind = 'assign' AND value < 8 THEN 'weak' WHEN kind = 'hex' AND long < 32 THEN 'weak' WHEN kind = 'access' AND long < 16 THEN NULL ELSE kind END AS kind FROM p),
r AS (SELECT *, CASE kind {roles} END AS role, CASE kind {ranks} END AS rank FROM g WHERE kind IS NOT NULL),
k AS (SELECT * FROM r WHERE rank < 3 OR (SELECT count(DISTINCT o.role) FROM r o WHERE o.doc_id = r.doc_id AND o.role <> r.role AND abs(o.start - r.start) <= {SCOPE}) = 2),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id)
"""


@query("op2_secret_linking", _oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
