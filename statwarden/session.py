"""Session settings the jobs rely on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plans; a cluster supplies its own sizes.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
# Can only be set when a session is made: recording the call site of every Column
# costs more than building the plan.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    """Applies the settings above to a session made elsewhere."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("statwarden")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SESSION_CONF, **START_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(scanned: DataFrame, key: str) -> DataFrame:
    """Rows of a scan dealt over all cores by ``key`` where the scan has fewer splits than there are cores.

    For work that is heavy per row, such as the decision: a small file is one split and
    would keep one core busy. A scan of many splits is left as it is.
    """
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    return scanned.repartition(key) if scanned.rdd.getNumPartitions() < cores else scanned


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables written by a job.

    It lies in the shared folder named by ``spark.checkpoint.dir``. Only a session
    within one process may go without: it gets a folder of its machine, once.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="statwarden-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/statwarden/{name}-{uuid.uuid4().hex}"
