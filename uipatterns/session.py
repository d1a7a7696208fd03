"""Session settings the operators are written for.

Everything works on a session built elsewhere; these are the settings we would
choose.  Adaptive execution does the runtime work that depends on data size:
picking broadcast or shuffled joins, coalescing small shuffle partitions and
splitting skewed join partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch of whole HTML pages is far heavier than a batch of short rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Checkpoint files go with the last reference to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "uipatterns", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``; where the session names none, a folder
    below the warehouse, which is shared too.  The same on one machine and on
    a cluster.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def work_tasks(spark: SparkSession) -> int:
    """Partitions for rows that are few bytes and much work each: their size alone would put them into one or two."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, for results that several branches of a plan read.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints``, as
    ``build_session`` sets it, the files go when nothing refers to them.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
