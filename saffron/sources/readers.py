"""Scans: typed, source-preserving and inferred CSV, Parquet, text, and in-memory rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import TABLES


def typed_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table's CSV under its explicit schema; what doesn't parse becomes null."""
    return spark.read.schema(TABLES[table].schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def source_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Every column as the text of the source, with ``_corrupt_record`` and ``_source_file``.

    A header that differs from the schema fails. Malformed rows are only seen when
    the CSV parser reads all columns, so this scan turns its column pruning off.
    """
    fields = [T.StructField(f.name, T.StringType()) for f in TABLES[table].schema]
    schema = T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", enforceSchema=False, multiLine=True, columnPruning=False).csv(path)
    return rows.withColumn("_source_file", F.col("_metadata.file_path"))


def inferred_csv(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """A CSV with inferred types, and how each column's type compares with the contract."""
    rows = spark.read.options(header=True, inferSchema=True).csv(path)
    found, wanted = dict(rows.dtypes), {f.name: f.dataType.simpleString() for f in TABLES[table].schema}
    names = sorted({*found, *wanted})
    compared = spark.createDataFrame([(n, wanted.get(n), found.get(n), wanted.get(n) == found.get(n)) for n in names], "column string, declared string, inferred string, equal boolean")
    return rows, compared


def parquet(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


def register(tables: dict[str, DataFrame]) -> None:
    """Temp views of the names given."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def rows_of(spark: SparkSession, table: str, rows: Iterable[tuple]) -> DataFrame:
    """Rows in memory, under the table's schema."""
    return spark.createDataFrame(list(rows), TABLES[table].schema)


def source_rows(spark: SparkSession, table: str, rows: Iterable[tuple[str | None, ...]]) -> DataFrame:
    """Rows in memory as a source-preserving scan gives them."""
    names = [f.name for f in TABLES[table].schema]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt_record", "_source_file"]])
    return spark.createDataFrame([(*r, *[None] * (len(schema) - len(r))) for r in rows], schema)


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text evidence."""
    return spark.read.text(path)
