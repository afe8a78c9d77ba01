"""Session settings and checkpoint handling shared by the whole package."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that suit this workload; a cluster session may override any of them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # exact percentiles keep their state in an object hash aggregate, which by
    # default turns to a sort after only 128 groups per task
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
}


def build_session(app_name: str = "ostinato", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a local session gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = os.path.join(tempfile.mkdtemp(prefix="ostinato-"), "checkpoints")
    context.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that later reads neither
    recompute it nor depend on executors that may be lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, rows: int, each: int = 5_000) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more partitions than there are cores or, if that is more,
    parts of ``each`` rows. A partition becomes a file, and on a local file system two launches of
    chmod by the executor, so small tables in hundreds of files cost more than their rows."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
