"""Linear and logistic models from mergeable sums.

One aggregation gives the sums of products of all features and the target, a square of
a few dozen numbers for each group, whatever the number of rows. Models of many
groups or time spans come from one scan, for the sums of a span are those of its
parts. A logistic model takes one such aggregation for each Newton step.

The penalty on a coefficient is in proportion to the variance of its feature, so units
don't matter; the intercept has none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .compiled import Scorer, name, number

#: Newton steps of a logistic model, and the bound of a linear predictor.
STEPS, BOUND = 10, 30.0


@dataclass(frozen=True)
class Linear:
    """An intercept and a coefficient for each feature; ``logistic`` turns the sum into a probability."""

    names: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    logistic: bool = False

    def column(self) -> Column:
        """The prediction as an expression over the features' columns."""
        out = F.lit(self.intercept)
        for n, c in zip(self.names, self.coefficients, strict=True):
            out = out + F.lit(c) * F.col(n)
        return sigmoid(out) if self.logistic else out

    def scorer(self) -> Scorer:
        """The prediction as SQL text, for marts, single rows and other engines."""
        out = " + ".join([number(self.intercept), *(f"{number(c)} * {name(n)}" for n, c in zip(self.names, self.coefficients, strict=True))])
        return Scorer(f"1e0 / (1e0 + exp(-greatest({number(-BOUND)}, least({number(BOUND)}, {out}))))" if self.logistic else out, self.names)

    def rows(self) -> list[tuple[str, float]]:
        return [("intercept", self.intercept), *zip(self.names, self.coefficients, strict=True)]


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), with x within BOUND of zero."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), x))))


def product_sums(rows: DataFrame, columns: list[Column], by: list[str | Column] = ()) -> DataFrame:
    """(by, sums): sums of the products of each two columns, the upper triangle row by row. Rows with a null count nowhere."""
    whole = rows.select(*by, *(c.cast("double").alias(f"_{i}") for i, c in enumerate(columns))).dropna(subset=[f"_{i}" for i in range(len(columns))])
    pairs = [F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i in range(len(columns)) for j in range(i, len(columns))]
    names = [b if isinstance(b, str) else whole.columns[k] for k, b in enumerate(by)]
    return whole.groupBy(*names).agg(F.array(*(F.coalesce(p, F.lit(0.0)) for p in pairs)).alias("sums"))


def cumulative_sums(parts: DataFrame, order: str, size: int) -> DataFrame:
    """The sums of each part and all parts before it; ``parts`` holds one row a part, a bounded number."""
    up_to = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.select(order, F.array(*(F.sum(F.col("sums")[i]).over(up_to) for i in range(size))).alias("sums"))


def square(sums: list[float], n: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = sums
    return out + np.triu(out, 1).T


def solve(names: list[str], sums: list[float], penalty: float) -> Linear:
    """The ridge regression of the last column of (1, features, target) on the others."""
    m = square(sums, len(names) + 2)
    a, b = m[:-1, :-1].copy(), m[:-1, -1]
    n = a[0, 0]
    if n == 0:
        return Linear(tuple(names), 0.0, (0.0,) * len(names))
    a[np.diag_indices(len(a))] += _penalties(a, penalty)
    beta = np.linalg.solve(a, b)
    return Linear(tuple(names), float(beta[0]), tuple(float(x) for x in beta[1:]))


def _penalties(a: np.ndarray, penalty: float) -> np.ndarray:
    """``penalty`` times the rows and the variance of each feature; a constant feature gets no coefficient."""
    n, squares = a[0, 0], np.diag(a)[1:]
    spread = squares - a[0, 1:] ** 2 / n
    return np.append(0.0, np.where(spread <= 1e-9 * squares, n, penalty * spread))


def linear(rows: DataFrame, names: list[str], target: str, penalty: float = 1e-3) -> Linear:
    sums = product_sums(rows, [F.lit(1.0), *map(F.col, names), F.col(target)]).first()
    return solve(names, sums["sums"] if sums else [0.0] * ((len(names) + 2) * (len(names) + 3) // 2), penalty)


def linear_by_origin(rows: DataFrame, names: list[str], target: str, at: str, origins: list[str], penalty: float = 1e-3) -> dict[str, Linear]:
    """A model for each origin from the rows up to its day, all from one scan.

    A row adds to the first origin that it isn't after; sums of later origins follow by
    addition. At most one row of sums for each origin comes to the driver.
    """
    days = sorted(set(origins))
    if not days:
        return {}
    after = F.filter(F.array(*map(F.lit, days)), lambda o: o.cast("date") >= F.col(at))
    with_origin = rows.withColumn("_origin", F.get(after, F.lit(0))).where("_origin is not null")
    size = (len(names) + 2) * (len(names) + 3) // 2
    parts = product_sums(with_origin, [F.lit(1.0), *map(F.col, names), F.col(target)], ["_origin"])
    found = {r["_origin"]: r["sums"] for r in cumulative_sums(parts, "_origin", size).collect()}
    out, last = {}, [0.0] * size
    for o in days:
        last = found.get(o, last)
        out[o] = solve(names, last, penalty)
    return out


def logistic(rows: DataFrame, names: list[str], label: str, weight: Column | None = None, penalty: float = 1e-3, steps: int = STEPS) -> Linear:
    """A logistic regression of a 0/1 label by Newton's method; each step is one aggregation of weighted sums."""
    x = [F.lit(1.0), *(F.col(n).cast("double") for n in names)]
    narrow = kept(rows.select(*(c.alias(f"_{i}") for i, c in enumerate(x)), F.col(label).cast("double").alias("_y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w")).dropna(), "logistic")
    cols, root = [F.col(f"_{i}") for i in range(len(x))], F.sqrt("_w")
    first = product_sums(narrow, [root * c for c in cols]).first()
    beta = np.zeros(len(x))
    if first is None or first["sums"][0] == 0:
        return Linear(tuple(names), 0.0, (0.0,) * len(names), True)
    penalties = _penalties(square(first["sums"], len(x)), penalty)
    for _ in range(steps):
        eta = F.lit(float(beta[0]))
        for b, c in zip(beta[1:], cols[1:], strict=True):
            eta = eta + F.lit(float(b)) * c
        seen = narrow.withColumn("_p", sigmoid(eta)).withColumn("_h", F.col("_w") * F.col("_p") * (1 - F.col("_p")))
        pull = [F.sum(F.col("_w") * (F.col("_y") - F.col("_p")) * c) for c in cols]
        curve = [F.sum(F.col("_h") * a * b) for i, a in enumerate(cols) for b in cols[i:]]
        got = seen.agg(F.array(*pull).alias("pull"), F.array(*curve).alias("curve")).first()
        beta = beta + np.linalg.solve(square(got["curve"], len(x)) + np.diag(penalties), np.array(got["pull"]) - penalties * beta)
    return Linear(tuple(names), float(beta[0]), tuple(float(b) for b in beta[1:]), True)
