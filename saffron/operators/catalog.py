"""Served views of marts: filter, search, sort and limit as a user of the reports asks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class ReportCatalog:
    """Named marts with the columns that may be filtered, searched and sorted."""

    marts: dict[str, DataFrame] = field(default_factory=dict)
    most: int = 1000
    default: int = 500

    def view(self, mart: str, equals: dict[str, str] | None = None, contains: dict[str, str] | None = None, between: dict[str, tuple] | None = None, sort: str | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
        """Rows of a mart. Text compares without regard to case; descending puts nulls first.

        Rows come in the order of ``sort`` and then of all columns, so a limit takes the
        same rows each time.
        """
        if mart not in self.marts:
            raise KeyError(mart)
        df = self.marts[mart]
        limit = self.default if limit is None else limit
        if not 1 <= limit <= self.most:
            raise ValueError(f"limit must be between 1 and {self.most}")
        for c, v in (equals or {}).items():
            df = df.where(F.lower(F.col(c).cast("string")) == str(v).lower())
        for c, v in (contains or {}).items():
            df = df.where(F.contains(F.lower(F.col(c).cast("string")), F.lit(str(v).lower())))
        for c, (lo, hi) in (between or {}).items():
            df = df.where(F.col(c).between(lo, hi))
        first = [F.desc_nulls_first(sort) if descending else F.asc_nulls_last(sort)] if sort else []
        rest = [F.asc_nulls_last(c) for c, kind in df.dtypes if c != sort and not kind.startswith(("map", "variant"))]
        return df.orderBy(*first, *rest).limit(limit)

    def closest(self, mart: str, column: str, text: str, least: float = 0.66) -> DataFrame:
        """Values of a column that are similar to a text, by edit distance over length."""
        plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
        values = self.marts[mart].select(column).distinct()
        a, b = plain(F.col(column).cast("string")), plain(F.lit(text))
        alike = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
        return values.withColumn("similarity", alike).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), column)
