"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs no recomputation of what was written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import release as release
from ..sources.shared import shared_dir as app_dir


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the table read back."""
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
