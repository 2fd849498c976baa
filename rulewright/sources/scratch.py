"""Intermediate tables on the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folder for sessions on one machine that set none.
_LOCAL: list[str] = []
#: Spark deletes what a query has shuffled as it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set, one temporary folder of this process, which is an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="rulewright-"))
        root = _LOCAL[0]
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: lineage ends here and survives lost executors.

    Shuffle files of the write go as it ends, so the disk of a job of many steps holds those of one step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
