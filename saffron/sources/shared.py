"""The folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "/tmp/saffron"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Without that setting a local session uses a folder of this machine; on a cluster,
    whose executors each have their own disk, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{LOCAL}"
    return f"{root.rstrip('/')}/saffron-{spark.sparkContext.applicationId}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the shared folder and read back, so that it isn't computed again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result needs them; archives that executors load stay."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path):
        for entry in files.listStatus(path):
            if not entry.getPath().getName().endswith(".zip"):
                files.delete(entry.getPath(), True)
