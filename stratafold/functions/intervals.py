"""Intervals and tail probabilities of bootstrap replicates."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


@dataclass(frozen=True)
class Influence:
    """Leave-one-out estimates by their number, those that are finite, and their skewness (null where they do not vary)."""

    n: int
    n_finite: int
    skewness: float | None

    @property
    def acceleration(self) -> float | None:
        """Sum of cubed gaps to the mean over six times the sum of squared gaps to the power 3/2."""
        if self.skewness is None or not math.isfinite(self.skewness):
            return None
        return -self.skewness / (6 * math.sqrt(self.n))


def percentile(replicates: np.ndarray, level: float) -> tuple[float, float]:
    a = (1 - level) / 2
    low, high = np.quantile(replicates, [a, 1 - a])
    return float(low), float(high)


def basic(point: float, replicates: np.ndarray, level: float) -> tuple[float, float]:
    low, high = percentile(replicates, level)
    return 2 * point - high, 2 * point - low


def bca(point: float, replicates: np.ndarray, level: float, left: Influence | None) -> tuple[float, float] | str:
    """Bias-corrected and accelerated interval, or why there is none."""
    if left is None or left.n < 3 or left.n_finite < left.n:
        return "fewer than three finite leave-one-out estimates"
    below = float(np.mean(replicates < point))
    if below in (0.0, 1.0):
        return "all replicates lie on one side of the estimate"
    bias, speed = _NORMAL.inv_cdf(below), left.acceleration
    if speed is None:
        return "leave-one-out estimates do not vary"
    ends = []
    for tail in ((1 - level) / 2, (1 + level) / 2):
        shifted = bias + _NORMAL.inv_cdf(tail)
        room = 1 - speed * shifted
        place = bias + shifted / room if room else np.nan
        if not np.isfinite(place):
            return "an end is not finite"
        ends.append(float(np.quantile(replicates, min(1.0, max(0.0, _NORMAL.cdf(place))))))
    return ends[0], ends[1]


def interval(point: float, replicates: np.ndarray, level: float, method: str, left: Influence | None = None) -> tuple[float, float, str, str]:
    """Ends, the method that was used and a note if it is not the one asked for."""
    if method == "basic":
        return *basic(point, replicates, level), "basic", ""
    if method == "bca":
        found = bca(point, replicates, level, left)
        if not isinstance(found, str):
            return *found, "bca", ""
        return *percentile(replicates, level), "percentile", f"percentile instead of bca: {found}"
    if method != "percentile":
        raise ValueError(f"unknown interval method {method!r}")
    return *percentile(replicates, level), "percentile", ""


def p_two_sided(replicates: np.ndarray) -> float:
    """Twice the smaller tail at zero, not below 1 / (B + 1)."""
    smaller = min(float(np.mean(replicates <= 0)), float(np.mean(replicates >= 0)))
    return min(1.0, max(2 * smaller, 1 / (len(replicates) + 1)))


def outside(low: float, high: float, support: tuple[float | None, float | None]) -> list[str]:
    """Ends beyond what the metric can be; they are reported, never clamped."""
    out = []
    if support[0] is not None and low < support[0]:
        out.append(f"the lower end {low:g} is below the least possible value {support[0]:g}")
    if support[1] is not None and high > support[1]:
        out.append(f"the upper end {high:g} is above the largest possible value {support[1]:g}")
    return out
