"""Scenario arithmetic as Columns, so that a scenario runs over a whole mart.

Scenarios are arithmetic on the assumptions given, not forecasts. Assumptions
out of bounds raise; negative or non-finite measures give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _assume(name: str, value: float, low: float, high: float) -> float:
    if not math.isfinite(value) or not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return float(value)


def _measure(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when((x >= 0) & (x < float("inf")), x)


def price(df: DataFrame, change: float, elasticity: float = 0.0, price_col: str = "price", cost_col: str = "unit_cost", units_col: str = "units") -> DataFrame:
    change, elasticity = _assume("change", change, -0.9, 2), _assume("elasticity", elasticity, -10, 0)
    p, c, u = _measure(price_col), _measure(cost_col), _measure(units_col)
    new_p, new_u = p * (1 + change), F.greatest(F.lit(0.0), u * (1 + elasticity * change))
    new_u = F.when(u.isNotNull(), new_u)
    return df.withColumns({
        "baseline_revenue": p * u, "baseline_contribution": (p - c) * u, "scenario_price": new_p, "scenario_units": new_u,
        "scenario_revenue": new_p * new_u, "scenario_contribution": (new_p - c) * new_u,
    })


def promotion(df: DataFrame, frequency_change: float, discount: float, revenue_col: str = "revenue", contribution_col: str = "contribution") -> DataFrame:
    f, d = _assume("frequency_change", frequency_change, -1, 5), _assume("discount", discount, 0, 0.9)
    r, c = _measure(revenue_col), _measure(contribution_col)
    return df.withColumns({"scenario_revenue": r * (1 + f) * (1 - d), "scenario_contribution": c * (1 + f) - r * (1 + f) * d})


def demand(df: DataFrame, change: float, demand_col: str = "demand", margin_col: str = "contribution_per_unit") -> DataFrame:
    x = _assume("change", change, -1, 5)
    new = _measure(demand_col) * (1 + x)
    return df.withColumns({"scenario_units": new, "scenario_contribution": new * _measure(margin_col)})


def inventory(df: DataFrame, waste_rate: float = 0.0, demand_col: str = "demand", stock_col: str = "on_hand") -> DataFrame:
    w = _assume("waste_rate", waste_rate, 0, 1)
    target, stock = _measure(demand_col) * (1 + w), _measure(stock_col)
    gap = target - stock
    return df.withColumns({"target_stock": target, "surplus": F.when(gap.isNotNull(), F.greatest(F.lit(0.0), -gap)), "shortfall": F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap))})


def preparation(df: DataFrame, waste_rate: float, reduction: float, prepared_col: str = "prepared", demand_col: str = "demand") -> DataFrame:
    w, r = _assume("waste_rate", waste_rate, 0, 1), _assume("reduction", reduction, 0, 1)
    made = _measure(prepared_col)
    new = made * (1 - r)
    left = new * (1 - w)
    short = _measure(demand_col) - left
    return df.withColumns({"estimated_waste": made * w, "scenario_prepared": new, "scenario_waste": new * w, "available_after_waste": left, "shortfall": F.when(short.isNotNull(), F.greatest(F.lit(0.0), short))})


def remove_item(df: DataFrame, revenue_col: str = "revenue", contribution_col: str = "contribution") -> DataFrame:
    """The whole period without the item, without substitution."""
    return df.withColumns({"revenue_lost": _measure(revenue_col), "contribution_lost": _measure(contribution_col), "scenario_revenue": F.lit(0.0), "scenario_contribution": F.lit(0.0)})
