"""Experiments: constraints, best trials, Pareto fronts, parameter grids and a sampler."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def violation(value: Column, kind: str, bound: Column | float) -> Column:
    """Signed violation of a limit (`max` or `min`); a missing value violates by 1."""
    bound = bound if isinstance(bound, Column) else F.lit(float(bound))
    return F.when(value.isNull() | F.isnan(value), 1.0).otherwise(value - bound if kind == "max" else bound - value)


def with_violations(trials: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Trials with one v_<metric> per limit and `violation`, the sum of the positive ones."""
    out = trials
    for name, (kind, bound) in limits.items():
        out = out.withColumn(f"v_{name}", violation(F.col(name).cast("double"), kind, bound))
    total = reduce(lambda a, b: a + b, (F.greatest(F.lit(0.0), F.col(f"v_{n}")) for n in limits))
    return out.withColumn("violation", total)


def best_trial(trials: DataFrame, scope: list[str], objective: str, minimise: bool, number: str) -> DataFrame:
    """Per scope the best feasible trial, or of none the best of those least infeasible; the first wins ties."""
    part = Window.partitionBy(*scope)
    least = F.min("violation").over(part)
    pool = trials.withColumn("__l", least).filter(F.col("violation") <= F.greatest(F.col("__l"), F.lit(0.0)) + 1e-12)
    order = F.col(objective).asc_nulls_last() if minimise else F.col(objective).desc_nulls_last()
    return pool.withColumn("__r", F.row_number().over(part.orderBy(order, number))).filter(F.col("__r") == 1).drop("__l", "__r")


def pareto_front(trials: DataFrame, scope: list[str], x: str, y: str) -> DataFrame:
    """Trials that no other of the scope beats in both x and y (smaller is better).

    One sort per scope: a trial is beaten if a smaller x has a y at most as large, or an equal x a smaller y.
    """
    part = Window.partitionBy(*scope).orderBy(x)
    cells = trials.groupBy(*scope, x).agg(F.min(y).alias("__low"))
    before = F.min("__low").over(part.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("__low") < F.col("__before")))
    return trials.join(cells.select(*scope, x, F.col("__low").alias("__y")), [*scope, x]).filter(F.col(y) == F.col("__y")).drop("__y")


def grid(spark: SparkSession, space: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Every combination of stepped values (low, high, steps): one row each, numbered; the product is generated, not joined."""
    sizes = [steps for _, _, steps in space.values()]
    total = int(np.prod(sizes))
    out, left = spark.range(total).withColumnRenamed("id", "point"), F.col("point")
    for (name, (low, high, steps)) in space.items():
        at = left % steps
        left = F.floor(left / steps)
        out = out.withColumn(name, F.lit(float(low)) + (float(high) - float(low)) * at / max(1, steps - 1))
    return out


def widened(space: dict[str, tuple[float, float]], baseline: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Ranges that also hold the baseline's values."""
    return {k: (min(lo, baseline.get(k, lo)), max(hi, baseline.get(k, hi))) for k, (lo, hi) in space.items()}


def condition_holds(condition: dict | list[dict] | None, values: dict) -> bool:
    """Whether a parameter's condition holds: a conjunction, or a list of alternatives."""
    if not condition:
        return True
    holds = lambda c: all(values.get(k) in (v if isinstance(v, (list, tuple, set)) else [v]) for k, v in c.items())
    return any(holds(c) for c in condition) if isinstance(condition, list) else holds(condition)


class OnePlusOne:
    """A constrained (1+1) evolution strategy with covariance adaptation, in the unit cube with reflection at its sides.

    The success rule grows or shrinks the step; accepted steps feed the covariance; directions that violated a constraint are damped.
    """

    def __init__(self, dim: int, seed: int = 0, sigma: float = 0.2):
        self.rng, self.dim, self.sigma = np.random.default_rng(seed), dim, sigma
        self.mean, self.best = np.full(dim, 0.5), np.inf
        self.shape, self.path = np.eye(dim), np.zeros(dim)
        self.success, self.target = 2 / 11, 2 / 11
        self.walls: dict[int, np.ndarray] = {}

    @staticmethod
    def reflect(x: np.ndarray) -> np.ndarray:
        x = np.mod(np.abs(x), 2)
        return np.where(x > 1, 2 - x, x)

    def ask(self) -> np.ndarray:
        self.step = self.shape @ self.rng.normal(size=self.dim)
        return self.reflect(self.mean + self.sigma * self.step)

    def tell(self, x: np.ndarray, value: float, violated: tuple[int, ...] = ()) -> None:
        for j in violated:
            self.walls[j] = 0.8 * self.walls.get(j, np.zeros(self.dim)) + 0.2 * self.step
            w = np.linalg.solve(self.shape + 1e-9 * np.eye(self.dim), self.walls[j])
            self.shape = self.shape - 0.1 / len(violated) * np.outer(self.walls[j], w) / max(float(w @ w), 1e-12)
        if violated:
            return
        won = value <= self.best
        self.success = 0.9 * self.success + 0.1 * won
        self.sigma *= float(np.exp((self.success - self.target) / (1 - self.target) / (1 + self.dim / 2)))
        if won:
            self.mean, self.best = x, value
            self.path = 0.8 * self.path + 0.6 * self.step
            cov = 0.9 * self.shape @ self.shape.T + 0.1 * np.outer(self.path, self.path)
            self.shape = np.linalg.cholesky(cov + 1e-12 * np.eye(self.dim))
