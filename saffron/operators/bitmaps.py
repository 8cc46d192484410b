"""Exact distinct counts at many grains from one table of bitmaps.

Ids are numbered densely once. A group's ids are then words of 64 bits, of which only
those with a bit set are stored; words of finer groups merge into those of coarser ones by
OR, and counting is adding up set bits. So every grain comes from one table, and no
id is counted again from the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .ranges import running

WORD = 64


def dense_numbers(df: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): each present value with its place among all of them, from 0; written once."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("_one", F.lit(1).cast("long"))
    return kept(running(values, [column], {out: "_one"}, "numbers").select(column, out), "dense-numbers")


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(WORD)).cast("int"))


def bitmaps(df: DataFrame, by: list[str], numbers: dict[str, Column]) -> DataFrame:
    """(by, of, word, bits): of each group the numbers seen under each name, from one scan."""
    each = F.array(*(F.when(n.isNotNull(), F.struct(F.lit(name).alias("of"), n.cast("long").alias("number"))) for name, n in numbers.items()))
    rows = df.select(*by, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("_x"))
    word = F.floor(F.col("_x.number") / WORD).alias("word")
    return rows.groupBy(*by, F.col("_x.of").alias("of"), word).agg(F.bit_or(_bit(F.col("_x.number"))).alias("bits"))


def merged(table: DataFrame, by: list[str]) -> DataFrame:
    """The bitmaps of coarser groups."""
    return table.groupBy(*by, "of", "word").agg(F.bit_or("bits").alias("bits"))


def distinct_counts(table: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """(by, names): how many numbers each group holds under each name; any grain that ``table`` can be merged to."""
    words = merged(table, by)
    n = lambda name: F.sum(F.when(F.col("of") == name, F.bit_count("bits")).otherwise(0)).cast("long").alias(name)
    return words.groupBy(*by).agg(*map(n, names))
