"""Time-varying curriculum: mixing sources to target weights along a training run.

1. Targets: the sources share ``share`` times all words by weight; no target
   exceeds ``repeat`` times its source, the excess being shared again by weight.
   With sources ordered by where they saturate, that is one running sum.
2. Every source reads its documents in digest order, pass after pass, until its
   target is reached; the document at the end is cut there. So the words taken
   are exactly the target without its fraction, and no document is taken more than ``repeat`` times.
3. A source's weight runs linearly over training time from ``begin`` to ``end``
   times its mean. Its integral is the source's cumulative demand; inverting that
   at the words read before a document gives the document's training position.
4. Documents are range-sorted by position.

Running sums over a source that may hold most rows are taken in two steps:
totals of digest ranges, whose number follows the row count, then rows within a range.

Defined cases: null text has no words; null sources are one source, ranked last;
equal rows are read one after the other; a document not taken has a null position; source columns
other than doc_id, text and source are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statwarden.llm.registry import query, table
from statwarden.llm.shared import BLANK, written

# fixed values: weights by source rank, share of all words, most repeats
WEIGHTS, SHARE, REPEAT = (5.0, 2.0, 1.0), 1.5, 2
# weight at the start and at the end of training, as a multiple of its mean; by source rank, repeating
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
# rows that one running sum holds, about
RANGE_ROWS = 5_000


def cycle(values: Sequence[float], rank: Column) -> Column:
    """The value of a rank counted from 0, the values repeating."""
    at = F.pmod(rank, F.lit(len(values)))
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at + 1).cast("int"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, number of words and the digest that orders a source's documents."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), digest_of().alias("digest"))


def digest_of() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """One row per source: rank, weight, source_size and target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", cycle(weights, F.col("rank")))
    filling = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, after = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    # the level if all sources up to here were full and the others were not
    level = (F.lit(share) * total - F.coalesce(repeat * F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= repeat * F.col("source_size"))
    # the first source that is not full sets the level of all after it
    bound = (F.col("source_size") / F.col("weight")).alias("bound")
    reached = F.min(F.when(F.col("open"), F.struct(bound, "rank", "level"))).over(W.partitionBy())
    passed = F.struct(bound, "rank") >= F.struct(reached["bound"].alias("bound"), reached["rank"].alias("rank"))
    full = (repeat * F.col("source_size")).cast("double")
    target = F.when(reached.isNotNull() & passed, F.least(reached["level"] * F.col("weight"), full)).otherwise(full)
    return leveled.select("source", "rank", "weight", "source_size", target.alias("target"))


def ranged(sizes: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``before``: the words of a source's documents ahead of each one in digest order."""
    count = F.broadcast(sizes.agg(F.count(F.lit(1)).alias("n")))
    # so many leading bits of the digest that a range has at most about range_rows rows
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(float(range_rows))))).cast("int")
    number = F.conv(F.substring("digest", 1, 12), 16, 10).cast("long")
    cut = sizes.crossJoin(count).withColumn("range", F.floor(number / F.pow(F.lit(2.0), F.lit(48) - bits)).cast("long")).drop("n")
    totals = cut.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    within = F.sum("size").over(W.partitionBy("source", "range").orderBy("digest", "size").rowsBetween(W.unboundedPreceding, -1))
    summed = cut.withColumn("within", F.coalesce(within, F.lit(0)))
    joined = summed.join(totals, summed["source"].eqNullSafe(totals["s"]) & (summed["range"] == totals["r"]))
    return joined.select("doc_id", "source", "size", "digest", (F.col("ahead") + F.col("within")).alias("before"))


def when_read(words: Column, target: Column, begin: Column, end: Column) -> Column:
    """The training time in [0, 1] at which a source has read ``words`` of its target.

    Solves begin * t + (end - begin) / 2 * t**2 = words / target * (begin + end) / 2,
    in the form that is stable for begin = end.
    """
    demand = words / target * (begin + end) / 2
    root = F.sqrt(F.greatest(F.lit(0.0), begin * begin + 2 * (end - begin) * demand))
    return F.least(F.lit(1.0), 2 * demand / (begin + root))


def passes(sizes: DataFrame, weights: Sequence[float], share: float, repeat: int, schedule: Sequence[tuple[float, float]], range_rows: int) -> DataFrame:
    """One row per document: digest, sizes, target, and for each pass the words taken and the training position."""
    # one row per source, left to the planner's own size check
    goal = targets(sizes, weights, share, repeat).withColumnRenamed("source", "goal_source")
    placed = ranged(sizes, range_rows)
    placed = placed.join(goal, placed["source"].eqNullSafe(goal["goal_source"]))
    begin = cycle([b for b, _ in schedule], F.col("rank"))
    end = cycle([e for _, e in schedule], F.col("rank"))
    whole = F.floor("target").cast("long")
    out = []
    for k in range(repeat):
        start = F.col("before") + k * F.col("source_size")
        part = F.greatest(F.lit(0), F.least("size", whole - start)).cast("long")
        out += [part.alias(f"part_{k + 1}"), F.when(part > 0, when_read(start, F.col("target"), begin, end)).alias(f"position_{k + 1}")]
    return placed.select("doc_id", "source", "size", "digest", "source_size", "target", *out)


def curriculum(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT,
    schedule: Sequence[tuple[float, float]] = SCHEDULE, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per document, sorted by its first training position; ``position_k`` is that of pass k."""
    rows = passes(written(sized(docs), "curriculum-sizes"), weights, share, repeat, schedule, range_rows)
    taken = sum((F.col(f"part_{k + 1}") for k in range(repeat)), F.lit(0).cast("long"))
    out = rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *[f"position_{k + 1}" for k in range(repeat)])
    # a range sort: partitions follow each other along the training run
    return out.orderBy(F.col("position_1").asc_nulls_last(), "doc_id")


def orderable(docs: DataFrame, name: str) -> Column:
    """A field of ``row`` by which rows can be ordered; nested ones by their text."""
    field = F.col(f"row.`{name}`")
    return F.to_json(F.struct(field)) if isinstance(docs.schema[name].dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType)) else field


def mixed(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT,
    schedule: Sequence[tuple[float, float]] = SCHEDULE, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The mix itself, in training order: a row per document and pass, with the columns of ``docs``.

    The document at which a source's target ends has its first words only, joined by single spaces.
    """
    sizes = written(sized(docs), "curriculum-sizes")
    rows = passes(sizes, weights, share, repeat, schedule, range_rows)
    each = F.explode(F.array(*[F.struct(F.col(f"part_{k + 1}").alias("part"), F.col(f"position_{k + 1}").alias("position")) for k in range(repeat)]))
    # rows of equal digest and source are equal in what is read; they are numbered so that each gets its own part
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("digest", "source").orderBy("position_1")))
    taken = rows.select("digest", "source", "nth", "size", each.alias("x")).where("x.part > 0").select("digest", "source", "nth", "size", "x.*")
    own = docs.select(F.struct("*").alias("row"), digest_of().alias("own_digest"), F.col("source").alias("own_source"))
    # by all that is not in the digest, so that a task that is run again numbers its rows alike
    rest = [F.col("row.text").isNull(), *[orderable(docs, n) for n in docs.columns if n not in ("doc_id", "text", "source")]]
    own = own.withColumn("own_nth", F.row_number().over(W.partitionBy("own_digest", "own_source").orderBy(*rest)))
    joined = own.join(taken, (F.col("own_digest") == F.col("digest")) & (F.col("own_nth") == F.col("nth")) & F.col("own_source").eqNullSafe(F.col("source")))
    words = F.split(F.trim(F.regexp_replace("row.text", BLANK, " ")), " ")
    text = F.when(F.col("part") < F.col("size"), F.array_join(F.slice(words, 1, F.col("part").cast("int")), " ")).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("part") < F.col("size"), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return joined.orderBy("position", "row.doc_id").select(row.alias("row")).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + CAST(rank % 3 AS INTEGER)] AS DOUBLE) AS weight, [1.5, 1.0, 0.5][1 + CAST(rank % 3 AS INTEGER)]::DOUBLE AS b, [0.5, 1.0, 1.5][1 + CAST(rank % 3 AS INTEGER)]::DOUBLE AS e FROM s),
-- the sources that are full: the smallest set under whose level no other source is above twice its size
c AS (SELECT f.source_size / f.weight AS bound, f.rank AS r,
        (1.5 * (SELECT sum(source_size) FROM w) - coalesce((SELECT sum(2 * g.source_size) FROM w g WHERE (g.source_size / g.weight, g.rank) < (f.source_size / f.weight, f.rank)), 0))
        / (SELECT sum(g.weight) FROM w g WHERE (g.source_size / g.weight, g.rank) >= (f.source_size / f.weight, f.rank)) AS level, f.weight, f.source_size
      FROM w f),
l AS (SELECT bound, r, level FROM c WHERE level * weight <= 2 * source_size ORDER BY bound, r LIMIT 1),
t AS (SELECT w.*, CASE WHEN (source_size / weight, rank) >= (bound, r) THEN least(level * weight, 2 * source_size) ELSE 2.0 * source_size END AS target FROM w LEFT JOIN l ON true),
p AS (SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bef FROM d),
j AS (SELECT p.doc_id, p.source, p.size, t.source_size, t.target, bef, b, e,
        greatest(0, least(p.size, CAST(floor(target) AS BIGINT) - bef)) AS t1, greatest(0, least(p.size, CAST(floor(target) AS BIGINT) - bef - source_size)) AS t2
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, CAST(t1 + t2 AS BIGINT) AS taken,
  CASE WHEN t1 > 0 THEN least(1.0, 2 * (bef / target * (b + e) / 2) / (b + sqrt(greatest(0.0, b * b + 2 * (e - b) * (bef / target * (b + e) / 2))))) END AS position_1,
  CASE WHEN t2 > 0 THEN least(1.0, 2 * ((bef + source_size) / target * (b + e) / 2) / (b + sqrt(greatest(0.0, b * b + 2 * (e - b) * ((bef + source_size) / target * (b + e) / 2))))) END AS position_2
FROM j
"""


@query("op3_mixing_curriculum", ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(table(spark, sf_dir, "documents"))
