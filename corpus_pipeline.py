"""From raw documents to token shards: five stages, each over all that the one before it kept.

Every stage's rows are written as Parquet in the shared folder and read again.
Toxic documents go, one document of each group of near copies stays,
documents with benchmark windows go, the sources are mixed to their targets
(documents repeat, the last one of a source is cut), and the mix is encoded into shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statwarden.llm import curriculum, decontamination, minhash_odd, token_output, toxicity
from statwarden.llm.registry import table
from statwarden.llm.shared import settings, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settings(spark)
    return toxicity.accepted(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settings(spark)
    return minhash_odd.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settings(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settings(spark)
    return curriculum.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settings(spark)
    return token_output.token_output(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
# a trained model and encoded ids are not SQL: tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(settings(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
