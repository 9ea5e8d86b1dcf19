"""Equivalence, non-inferiority, verdicts, multiplicity and coverage."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.config import Margin, MetricSpec

VERDICTS = ("superior", "worse", "statistically_equivalent", "statistically_different_within_margin", "inconclusive")


class MarginRequired(ValueError):
    """Equivalence without a declared margin is not defined."""


@dataclass(frozen=True)
class EquivalenceResult:
    """Two one-sided tests, or one of them."""

    conclusion: str
    low: float
    high: float
    p_value: float
    alpha: float
    margin: Margin
    kind: str = "tost"

    @property
    def holds(self) -> bool:
        return self.conclusion in ("equivalent", "non_inferior")


def _margin(margin: Margin | None) -> Margin:
    if margin is None:
        raise MarginRequired("declare a margin: a difference that would not matter in practice")
    return margin


def significance(beyond: np.ndarray) -> float:
    """Achieved level: share of replicates beyond a bound, not below 1 / (B + 1)."""
    return max(float(np.mean(beyond)), 1 / (len(beyond) + 1))


def tost(replicates: np.ndarray, margin: Margin | None, alpha: float = 0.05) -> EquivalenceResult:
    """Equivalent if the central 1 - 2 alpha interval of the difference lies strictly within the margin."""
    margin = _margin(margin)
    low, high = (float(q) for q in np.quantile(replicates, [alpha, 1 - alpha]))
    p = max(significance(replicates <= -margin.lower), significance(replicates >= margin.upper))
    if low > -margin.lower and high < margin.upper:
        conclusion = "equivalent"
    elif low >= margin.upper or high <= -margin.lower:
        conclusion = "outside_margin"
    else:
        conclusion = "inconclusive"
    return EquivalenceResult(conclusion, low, high, p, alpha, margin)


def non_inferiority(replicates: np.ndarray, margin: Margin | None, direction: str, alpha: float = 0.05) -> EquivalenceResult:
    """Non-inferior if the one-sided bound on the harmful side lies within the margin."""
    margin = _margin(margin)
    if direction == "lower_is_better":
        bound = float(np.quantile(replicates, 1 - alpha))
        holds, p, low, high = bound < margin.upper, significance(replicates >= margin.upper), -math.inf, bound
    else:
        bound = float(np.quantile(replicates, alpha))
        holds, p, low, high = bound > -margin.lower, significance(replicates <= -margin.lower), bound, math.inf
    return EquivalenceResult("non_inferior" if holds else "not_shown", low, high, p, alpha, margin, "non_inferiority")


def classify_difference(difference: float, low: float, high: float, metric: MetricSpec, equivalence: EquivalenceResult | None = None) -> tuple[str, str | None]:
    """Verdict and which side it favours (candidate, baseline or none)."""
    differs = low > 0 or high < 0
    same = equivalence is not None and equivalence.conclusion == "equivalent"
    if differs and same:
        return "statistically_different_within_margin", None
    if differs:
        better = metric.better(difference)
        return ("superior", "candidate") if better else ("worse", "baseline")
    return ("statistically_equivalent", None) if same else ("inconclusive", None)


def holm(p: Sequence[float]) -> list[float]:
    """Step-down adjusted p-values, in the given order."""
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, top = [0.0] * len(p), 0.0
    for rank, i in enumerate(order):
        top = max(top, min(1.0, (len(p) - rank) * p[i]))
        out[i] = top
    return out


def bonferroni(p: Sequence[float]) -> list[float]:
    return [min(1.0, len(p) * x) for x in p]


def adjust(p: Mapping[str, float | None], method: str) -> dict[str, float | None]:
    """Adjusted p-values of a family; tests without one are kept and do not count."""
    have = [k for k, x in p.items() if x is not None and math.isfinite(x)]
    values = [p[k] for k in have]
    made = {"none": list, "holm": holm, "bonferroni": bonferroni}[method](values)
    return {k: None for k in p} | dict(zip(have, made, strict=True))


def adjusted(tests: DataFrame, method: str, family: str = "family", p: str = "p_value", key: str = "test") -> DataFrame:
    """tests with ``p_adjusted`` by family, for tables of tests."""
    group = Window.partitionBy(family, F.col(p).isNull())
    size, rank = F.count(p).over(group), F.row_number().over(group.orderBy(p, key)) - 1
    if method == "holm":
        step = F.least(F.lit(1.0), (size - rank) * F.col(p))
        made = tests.withColumn("__step", step)
        value = F.max("__step").over(group.orderBy(p, key).rowsBetween(Window.unboundedPreceding, 0))
        return made.withColumn("p_adjusted", F.when(F.col(p).isNotNull(), value)).drop("__step")
    value = F.least(F.lit(1.0), size * F.col(p)) if method == "bonferroni" else F.col(p)
    return tests.withColumn("p_adjusted", F.when(F.col(p).isNotNull(), value))


def monte_carlo_error(p: float, n: int) -> float:
    return math.sqrt(p * (1 - p) / n) if n else math.nan


def wilson_interval(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    if not n:
        return 0.0, 1.0
    z, p = NormalDist().inv_cdf((1 + level) / 2), hits / n
    centre, scale = p + z * z / (2 * n), 1 + z * z / n
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return max(0.0, (centre - half) / scale), min(1.0, (centre + half) / scale)


def wilson_columns(hits: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """The interval as column expressions; null without trials."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    p, scale = F.try_divide(hits.cast("double"), n.cast("double")), 1 + z * z / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(F.lit(0.0), (centre - half) / scale), F.least(F.lit(1.0), (centre + half) / scale)


@dataclass(frozen=True)
class CoverageEstimate:
    """How often intervals held the truth."""

    hits: int
    n: int
    nominal: float = 0.95

    @property
    def rate(self) -> float:
        return self.hits / self.n if self.n else math.nan

    @property
    def interval(self) -> tuple[float, float]:
        return wilson_interval(self.hits, self.n)

    @property
    def consistent(self) -> bool:
        low, high = self.interval
        return low <= self.nominal <= high

    @property
    def error(self) -> float:
        return monte_carlo_error(self.rate, self.n)


def estimate_coverage(lows: Sequence[float], highs: Sequence[float], truth: float, nominal: float = 0.95) -> CoverageEstimate:
    return CoverageEstimate(sum(a <= truth <= b for a, b in zip(lows, highs, strict=True)), len(lows), nominal)


def replications_for(half_width: float, p: float = 0.95, level: float = 0.95) -> int:
    z = NormalDist().inv_cdf((1 + level) / 2)
    return math.ceil(z * z * p * (1 - p) / half_width**2)


def compare_coverage(a: CoverageEstimate, b: CoverageEstimate) -> dict[str, float | bool]:
    gap = a.rate - b.rate
    error = math.sqrt(a.error**2 + b.error**2)
    return {"difference": gap, "error": error, "distinct": abs(gap) > 1.96 * error}
