"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE sizes the shuffles at run time and splits skewed partitions. Forcing the
# skew split matters here: without it Spark leaves a hot join key in one task
# whenever an aggregation on the same key follows the join.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Limits per key go before the shuffle for larger limits too (default 1000).
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # Hash instead of sort where every partition of one side turns out this
    # small: the large side is not sorted. 20 million commands: 19 s -> 11 s.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Whole texts go to Python tasks: 10,000 of them (the default) are tens of MB, held several times over.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # An overwrite replaces the partitions it has rows for, not the whole table.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings this library relies on; returns the session."""
    for name, value in ADAPTIVE.items():
        spark.conf.set(name, value)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``, or else a folder below the warehouse.

    A machine-local temporary folder is never taken: executors would write to
    their own disks and later reads would miss files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several jobs: the stored files survive the loss
    of executors, and later jobs start from them instead of the full lineage.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def forget(*stored: DataFrame) -> None:
    """Delete the folders of ``materialize`` results that nothing lazy reads any more."""
    for df in stored:
        path, files = _file_system(df.sparkSession, df._stored_at)
        files.delete(path, True)


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """What lies directly in a folder of any file system; nothing where it is not there."""
    path, files = _file_system(spark, folder)
    return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []
