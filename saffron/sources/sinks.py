"""Sinks: write-once versions, read-back checks, ordered exports, evidence, bundles, models."""

from __future__ import annotations

import re

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PERSONAL = re.compile(r"(^|_)(name|email|phone|address)($|_)")


class ReadBackError(RuntimeError):
    """What was written doesn't read back as expected."""


def version_path(root: str, version: str, table: str) -> str:
    if not re.fullmatch(r"v[0-9]+", version):
        raise ValueError(f"a version is v and digits, not {version!r}")
    return f"{root}/{version}/{table}"


def write_once(df: DataFrame, root: str, version: str, table: str, key: list[str] | None = None) -> DataFrame:
    """Write a new version (an existing one is an error) and return the checked read-back.

    The source is counted by itself, with only the columns that a count needs: an
    observation of the write would do it in one run, but leaves the session with a
    listener that fitted models then can't be serialised with.
    """
    path = version_path(root, version, table)
    df.write.mode("errorifexists").parquet(path)
    return read_back(df.sparkSession, path, df, df.count(), key)


def overwrite(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replace a table; with ``by`` only the partitions that the rows touch."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.parquet(path)


def read_back(spark: SparkSession, path: str, expected: DataFrame, rows: int, key: list[str] | None = None) -> DataFrame:
    """Read a table again; its fields, row count and key must be as expected."""
    got = spark.read.parquet(path)
    if got.columns != expected.columns:
        raise ReadBackError(f"{path}: fields {got.columns}, expected {expected.columns}")
    if (n := got.count()) != rows:
        raise ReadBackError(f"{path}: {n} rows, expected {rows}")
    if key and not duplicate_keys(got, key).isEmpty():
        raise ReadBackError(f"{path}: {key} is not unique")
    return got


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1")


def personal_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if _PERSONAL.search(c)]


def refuse_personal_columns(df: DataFrame) -> DataFrame:
    """Fail if a mart carries a name, email, phone or address."""
    if found := personal_columns(df):
        raise ValueError(f"personal columns: {found}")
    return df


#: Rows up to which a mart may be written as one file by one task.
ONE_FILE_ROWS = 5_000_000


def one_file(df: DataFrame) -> DataFrame:
    """The rows in one partition; a mart of over ONE_FILE_ROWS rows raises before it gets there."""
    if (n := df.limit(ONE_FILE_ROWS + 1).count()) > ONE_FILE_ROWS:
        raise ValueError(f"over {n - 1} rows are no small mart: write them as several files")
    return df.coalesce(1)


def export_csv(df: DataFrame, path: str, order: list[str], single_file: bool = False) -> None:
    """CSV in the order of a key; files are ranges of it, or one file for small marts."""
    rows = one_file(df).sortWithinPartitions(*order) if single_file else df.orderBy(*order)
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_parquet(df: DataFrame, path: str) -> DataFrame:
    """A small mart as one Parquet file, and the SHA-256 of the files written."""
    one_file(df).write.mode("overwrite").parquet(path)
    return checksums(df.sparkSession, path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a path: the manifest of a bundle.

    Paths are relative to it. A file is one value, so it must stay below 2 GB; larger
    ones are an error of the scan, not a wrong digest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = re.sub(r"^[a-z0-9]+:/*", "/", path.rstrip("/"))
    inside = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + re.escape(root) + "/", "")
    return files.select(inside.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_bundle(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(path, fault) of what differs from a manifest; empty if the bundle is whole.

    Faults: outside (an absolute path, or one that climbs out of the bundle), missing,
    unknown, changed.
    """
    now = checksums(spark, path).withColumnsRenamed({"bytes": "bytes_now", "sha256": "sha256_now"})
    both = manifest.join(now, "path", "full")
    outside = F.col("path").rlike(r"^/|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")
    fault = F.when(outside, "outside").when(F.col("sha256_now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when((F.col("sha256") != F.col("sha256_now")) | (F.col("bytes") != F.col("bytes_now")), "changed")
    return both.select("path", fault.alias("fault")).where("fault is not null")


def with_provenance(df: DataFrame, method: str, interpretation: str, as_of: DataFrame | None = None) -> DataFrame:
    """Add what a reader of a mart must know: method, interpretation and analysis_as_of (the one value of ``as_of``)."""
    rows = df.withColumns({"method": F.lit(method), "interpretation": F.lit(interpretation)})
    if as_of is None:
        return rows.withColumn("analysis_as_of", F.lit(None).cast("date"))
    return rows.crossJoin(F.broadcast(as_of.toDF("analysis_as_of").select(F.to_date("analysis_as_of").alias("analysis_as_of"))))


def write_evidence(spark: SparkSession, path: str, fields: dict[str, str]) -> None:
    """One JSON row of facts about a run."""
    spark.createDataFrame([tuple(fields.values())], list(fields)).write.mode("overwrite").json(path)


def preview(df: DataFrame, n: int = 10) -> list[str]:
    """The first rows as JSON, for a report."""
    return [r["value"] for r in df.limit(n).select(F.to_json(F.struct("*")).alias("value")).collect()]


def save_model(model: PipelineModel, path: str, rows: DataFrame, n: int = 5) -> PipelineModel:
    """Save a fitted pipeline, load it again and require predictions for a few rows."""
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    if loaded.transform(rows.limit(n)).where("prediction is null").count():
        raise ReadBackError(f"{path}: the loaded model gives no prediction")
    return loaded
