"""Dense panels: entities by a regular time grid, zero-filled, with lags and rolling means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class PanelError(ValueError):
    """An entity has several rows for one step."""


def time_grid(facts: DataFrame, at: str, step: str) -> DataFrame:
    """All steps from the first to the last of the facts: one row unfolded, no trip through the driver."""
    ends = facts.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    return ends.select(F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias(at))


def dense(facts: DataFrame, entity: list[str], at: str, step: str, values: list[str], entities: DataFrame | None = None, grid: DataFrame | None = None) -> DataFrame:
    """Every entity at every step; missing values are zero.

    The grid is as long as the time span, so it is small beside the entities and is
    broadcast only while it has fewer than 100,000 steps.
    """
    grid = time_grid(facts, at, step) if grid is None else grid
    entities = facts.select(*entity).distinct() if entities is None else entities
    n = grid.count()
    full = entities.crossJoin(F.broadcast(grid) if n < 100_000 else grid)
    return full.join(facts.select(*entity, at, *values), [*entity, at], "left").fillna(0, values)


def check_unique(facts: DataFrame, entity: list[str], at: str) -> DataFrame:
    if not facts.groupBy(*entity, at).count().where("count > 1").isEmpty():
        raise PanelError(f"several rows for one {entity} and {at}")
    return facts


def ordered(entity: list[str], at: str):
    return Window.partitionBy(*entity).orderBy(at)


def lags(panel: DataFrame, entity: list[str], at: str, value: str, steps: tuple[int, ...]) -> DataFrame:
    w = ordered(entity, at)
    return panel.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(w) for k in steps})


def past_means(panel: DataFrame, entity: list[str], at: str, value: str, lengths: tuple[int, ...], mean=F.avg) -> DataFrame:
    """Means over the last k steps, the present one left out."""
    w = ordered(entity, at)
    return panel.withColumns({f"{value}_mean_prev_{k}": mean(value).over(w.rowsBetween(-k, -1)) for k in lengths})


def next_value(panel: DataFrame, entity: list[str], at: str, value: str, out: str) -> DataFrame:
    """The next step's value as a target; an entity's last step has none and drops out."""
    return panel.withColumn(out, F.lead(value).over(ordered(entity, at))).where(F.col(out).isNotNull())


def split_by_time(rows: DataFrame, at: str, train_before: Column | str, test_from: Column | str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows before the first bound, between the bounds, and from the second on."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") if isinstance(x, str) else x for x in (train_before, test_from))
    t = F.col(at).cast("timestamp_ntz")
    return rows.where(t < lo), rows.where((t >= lo) & (t < hi)), rows.where(t >= hi)
