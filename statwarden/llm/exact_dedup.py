"""Exact dedup through a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of new documents is
digested once, reduced to one row per digest, anti-joined with the index by a
merge of sorted buckets, and what is new is appended. Members of known groups
are counted by appended rows too, so the index is append-only.

Defined cases: null text counts as empty; null doc_ids sort after all others;
rows equal in doc_id and text are one group, of which a single row stays;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statwarden.llm.registry import query, table
from statwarden.llm.shared import BLANK, folder, written

# A digest of at least this share of the rows is hot: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
BATCHES = 2


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ").cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: its digest and ``row``, ordered by doc_id with nulls last, then by input position."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("at"))
    return docs.select(digest(F.col("text")).alias("digest"), row.alias("row"))


class DigestIndex:
    """A catalog table ``name`` of one row per digest and batch: digest, batch, first row, rows."""

    def __init__(self, spark: SparkSession, name: str, buckets: int, path: str | None = None):
        self.spark, self.name, self.buckets, self.path = spark, name, buckets, path

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digested: DataFrame, batch: int) -> None:
        """Adds a batch made by ``digests`` (and written, so that its row numbers are settled)."""
        new = digested.groupBy("digest").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
        if self.exists():
            if not self.entries().where(F.col("batch") == batch).isEmpty():
                raise ValueError(f"batch {batch} is in the index {self.name} already")
            # both sides are sorted by digest: a merge without a shuffle of the index
            known = self.entries().where("is_new").select("digest")
            fresh = new.join(known.hint("merge"), "digest", "left_anti").withColumn("is_new", F.lit(True))
            again = new.join(known.hint("merge"), "digest", "left_semi").withColumn("is_new", F.lit(False))
            new = written(fresh.unionByName(again), "digest-batch")
        else:
            new = new.withColumn("is_new", F.lit(True))
        rows = new.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest")
        writer = rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)

    def groups(self) -> DataFrame:
        """One row per digest over all batches: the row that stays and the group's size."""
        first = F.struct(F.col("first.no_id").alias("no_id"), F.col("first.doc_id").alias("doc_id"), "batch", F.col("first.at").alias("at"))
        return self.entries().groupBy("digest").agg(F.min(first).alias("first"), F.sum("rows").alias("group_size"))

    def resolve(self, digested: DataFrame, batch: int | None) -> DataFrame:
        """Each document of a batch with the row that stays; without a batch, of all batches that were digested as one.

        Digests held by a large share of the rows are few by arithmetic, so their
        groups are broadcast; all others merge with the sorted buckets.
        """
        groups = self.groups()
        total = self.entries().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"))
        is_hot = F.col("group_size") >= F.greatest(F.col("total") * HOT_SHARE, F.lit(2))
        marked = groups.crossJoin(F.broadcast(total))
        hot = marked.where(is_hot).select("digest", F.struct("first", "group_size").alias("hot"))
        tagged = digested.join(F.broadcast(hot), "digest", "left")
        cold = tagged.where("hot IS NULL").join(groups.hint("merge"), "digest").select("digest", "row", "first", "group_size")
        both = tagged.where("hot IS NOT NULL").select("digest", "row", "hot.first", "hot.group_size").unionByName(cold)
        kept = F.col("first.doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("first.at") == F.col("row.at"))
        if batch is not None:
            kept = kept & (F.col("first.batch") == batch)
        return both.select(
            F.col("row.doc_id").alias("doc_id"), F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def index_of(spark: SparkSession, name: str | None, buckets: int | None) -> DigestIndex:
    """A named index, which lasts, or a new one; both lie in the shared folder."""
    own = folder(spark, "digest-index")
    path = f"{own.rsplit('/', 1)[0]}/digest-index-{name}" if name else own
    return DigestIndex(spark, name or f"digest_index_{uuid.uuid4().hex}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), path)


def exact_dedup(docs: DataFrame, index_name: str, batch: int, buckets: int | None = None) -> DataFrame:
    """Appends ``docs`` to the index as a batch of its own and resolves each document."""
    index = index_of(docs.sparkSession, index_name, buckets)
    digested = written(digests(docs), "digests")
    index.append(digested, batch)
    return index.resolve(digested, batch)


def dedup_in_batches(docs: DataFrame, batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """All documents through an index of their own, batch by batch: each is anti-joined with what came before.

    Batches are dealt by a hash of the doc_id; all rows are resolved once the last one is in.
    """
    spark = docs.sparkSession
    index = index_of(spark, None, buckets)
    digested = written(digests(docs), "digests")
    for batch in range(batches):
        index.append(digested.where(F.pmod(F.xxhash64("row.doc_id"), F.lit(batches)) == batch), batch)
    found = written(index.resolve(digested, None), "digest-resolved")
    spark.sql(f"DROP TABLE {index.name}")
    return found


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op4_exact_dedup", ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_in_batches(table(spark, sf_dir, "documents"))
