"""Estimators: one number from a set of values.

Each estimator has three faces: a kernel over (values, integer multiplicities) in numpy, for
resampling; a Spark aggregate where plain aggregates express it; and otherwise an
aggregate over exact ranks.  All drop null, NaN and infinite values.

A custom estimator is a kernel with one of ``plain``, ``ranked`` and ``states``, which any
number of values passes, or a kernel alone: then the distinct values of a group, with their
multiplicities, meet in one task and must fit it.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators.ranks import ranked

Kernel = Callable[[np.ndarray, np.ndarray], float]
#: State of (values, multiplicities), of two states together, and the estimate of a state; a state is a sequence of doubles.
States = tuple[Callable[[np.ndarray, np.ndarray], Sequence[float]], Callable[[Sequence[float], Sequence[float]], Sequence[float]], Callable[[Sequence[float]], float]]

#: Values of a group are made into states by at most 2 ** CHUNK_BITS at once.
CHUNK_BITS = 17


@dataclass(frozen=True)
class Estimator:
    """A registered estimator.  ``factory(**params)`` checks parameters and gives the kernel."""

    name: str
    factory: Callable[..., Kernel]
    min_units: int
    min_values: int
    tail: bool
    definition: str
    plain: Callable[..., Callable[[Column], Column]] | None = None
    ranked: Callable[..., Callable[[Column, Column, Column], Column]] | None = None
    states: Callable[..., States] | None = None

    def parameters(self) -> dict[str, Any]:
        return {k: p.default for k, p in inspect.signature(self.factory).parameters.items()}


REGISTRY: dict[str, Estimator] = {}
METRIC_REGISTRY = REGISTRY


def register_estimator(name: str, *, min_units: int = 5, min_values: int = 1, tail: bool = False, definition: str = "", plain: Callable | None = None, ranked: Callable | None = None, states: Callable | None = None) -> Callable:
    """Decorator for a factory of kernels; for tables of any size, ``plain``, ``ranked`` or ``states`` say the same in parts."""

    def add(factory: Callable[..., Kernel]) -> Callable[..., Kernel]:
        REGISTRY[name] = Estimator(name, factory, min_units, min_values, tail, definition or (factory.__doc__ or name), plain, ranked, states)
        return factory

    return add


def tail_count(n: int, alpha: float) -> int:
    """Values in the mean of the most extreme share 1 - alpha; rounded before the ceiling, at least one."""
    return max(1, math.ceil(round((1 - alpha) * n, 9)))


def _average(x: np.ndarray, w: np.ndarray) -> float:
    return float(np.dot(x, w) / w.sum()) if w.sum() else math.nan


def _at(x: np.ndarray, w: np.ndarray, q: float) -> float:
    """Linear quantile of the expanded sample."""
    order = np.argsort(x, kind="stable")
    x, ends = x[order], np.cumsum(w[order])
    if not len(ends) or not ends[-1]:
        return math.nan
    place = q * (ends[-1] - 1)
    low, high = x[np.searchsorted(ends, [math.floor(place), math.ceil(place)], side="right")]
    return float(low + (high - low) * (place - math.floor(place)))


def _taken(x: np.ndarray, w: np.ndarray, skip: int, take: int) -> float:
    """Mean of ``take`` values of the expanded, ascending sample after ``skip``."""
    order = np.argsort(x, kind="stable")
    x, w = x[order], w[order]
    ends = np.cumsum(w)
    used = np.clip(np.minimum(ends, skip + take) - np.maximum(ends - w, skip), 0, None)
    return float(np.dot(x, used) / take)


@register_estimator("mean", definition="arithmetic mean", plain=lambda: F.avg)
def _mean() -> Kernel:
    return _average


@register_estimator("rate", definition="mean of 0/1 values", plain=lambda: F.avg)
def _rate() -> Kernel:
    return _average


@register_estimator("sum", definition="sum; 0 without values", plain=lambda: lambda v: F.coalesce(F.sum(v), F.lit(0.0)))
def _sum() -> Kernel:
    return lambda x, w: float(np.dot(x, w))


def _ranked_quantile(q: float) -> Callable[[Column, Column, Column], Column]:
    def build(v: Column, rank: Column, n: Column) -> Column:
        place = F.lit(float(q)) * (n - 1)
        low, high = (F.max(F.when(rank - 1 == f(place), v)) for f in (F.floor, F.ceil))
        return low + (high - low) * F.max(place - F.floor(place))

    return build


@register_estimator("median", min_units=8, definition="median, mean of the two central values", ranked=lambda: _ranked_quantile(0.5))
def _median() -> Kernel:
    return lambda x, w: _at(x, w, 0.5)


@register_estimator("std", min_units=10, min_values=2, definition="sample standard deviation", plain=lambda: F.stddev_samp)
def _std() -> Kernel:
    def kernel(x: np.ndarray, w: np.ndarray) -> float:
        n = w.sum()
        if n < 2:
            return math.nan
        return math.sqrt(np.dot(w, (x - np.dot(x, w) / n) ** 2) / (n - 1))

    return kernel


#: The quantile that is meant where none is named.
DEFAULT_QUANTILE = 0.9


@register_estimator("quantile", min_units=20, min_values=2, tail=True, definition="linear quantile", ranked=lambda q=DEFAULT_QUANTILE: _ranked_quantile(q))
def _quantile(q: float = DEFAULT_QUANTILE) -> Kernel:
    if not 0 <= q <= 1:
        raise ValueError(f"q is {q}; expected a number from 0 to 1")
    return lambda x, w: _at(x, w, q)


def _ranked_cvar(alpha: float = 0.9, tail: str = "upper") -> Callable[[Column, Column, Column], Column]:
    def build(v: Column, rank: Column, n: Column) -> Column:
        k = F.greatest(F.lit(1), F.ceil(F.round((F.lit(1.0) - F.lit(float(alpha))) * n, 9)))
        return F.avg(F.when((n - rank if tail == "upper" else rank - 1) < k, v))

    return build


@register_estimator("cvar", min_units=20, min_values=2, tail=True, definition="mean of the most extreme share 1 - alpha", ranked=_ranked_cvar)
def _cvar(alpha: float = 0.9, tail: str = "upper") -> Kernel:
    if not 0 <= alpha < 1:
        raise ValueError(f"alpha is {alpha}; expected a number from 0 to below 1")
    if tail not in ("upper", "lower"):
        raise ValueError(f"tail is {tail!r}; expected upper or lower")

    def kernel(x: np.ndarray, w: np.ndarray) -> float:
        n = int(w.sum())
        if not n:
            return math.nan
        k = tail_count(n, alpha)
        return _taken(x, w, n - k if tail == "upper" else 0, k)

    return kernel


def _ranked_trim(trim: float = 0.1) -> Callable[[Column, Column, Column], Column]:
    def build(v: Column, rank: Column, n: Column) -> Column:
        cut = F.floor(F.lit(float(trim)) * n)
        return F.avg(F.when((n - 2 * cut <= 0) | ((rank > cut) & (rank <= n - cut)), v))

    return build


@register_estimator("trimmed_mean", min_units=10, min_values=2, definition="mean without a share of each end", ranked=_ranked_trim)
def _trimmed_mean(trim: float = 0.1) -> Kernel:
    if not 0 <= trim < 0.5:
        raise ValueError(f"trim is {trim}; expected a number from 0 to below 0.5")

    def kernel(x: np.ndarray, w: np.ndarray) -> float:
        n = int(w.sum())
        if not n:
            return math.nan
        cut = math.floor(trim * n)
        return _taken(x, w, cut, n - 2 * cut) if n > 2 * cut else _average(x, w)

    return kernel


@register_estimator("p_exceed", min_units=20, tail=True, definition="share of values above a threshold", plain=lambda threshold=0.0: lambda v: F.avg((v > F.lit(float(threshold))).cast("double")))
def _p_exceed(threshold: float = 0.0) -> Kernel:
    return lambda x, w: _average((x > threshold).astype(float), w)


@register_estimator("max", min_units=30, tail=True, definition="largest value", plain=lambda: F.max)
def _max() -> Kernel:
    return lambda x, w: float(x[w > 0].max()) if (w > 0).any() else math.nan


@register_estimator("min", min_units=30, tail=True, definition="least value", plain=lambda: F.min)
def _min() -> Kernel:
    return lambda x, w: float(x[w > 0].min()) if (w > 0).any() else math.nan


@register_estimator("count", min_units=1, definition="number of finite values", plain=lambda: lambda v: F.count(v).cast("double"))
def _count() -> Kernel:
    return lambda x, w: float(w.sum())


#: Estimators whose bootstrap needs only sums of the resampled units.
ALGEBRAIC = ("mean", "rate", "sum", "count", "p_exceed", "std")


def lookup(name: str) -> Estimator:
    if name not in REGISTRY:
        raise ValueError(f"unknown estimator {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def build(name: str, **params: Any) -> Kernel:
    """Kernel over (values, multiplicities); checks the parameters."""
    return lookup(name).factory(**params)


def estimate(name: str, values: Sequence[float], **params: Any) -> float:
    """An estimator of plain values on the driver."""
    x = np.asarray(values, float)
    x = x[np.isfinite(x)]
    return build(name, **params)(x, np.ones(len(x), np.int64))


def finite(value: Column) -> Column:
    """The value, null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _weighed(have: DataFrame, keys: Sequence[str], kernel: Kernel, fields: str) -> DataFrame:
    """A kernel alone: a group's distinct values meet in one task, as it needs them."""

    def one(group):  # noqa: ANN001, ANN202
        return group[list(keys)].head(1).assign(estimate=kernel(group["__value"].to_numpy(float), group["__w"].to_numpy(np.int64)))

    return have.groupBy(*keys, "__value").agg(F.count("*").alias("__w")).groupBy(*keys).applyInPandas(one, f"{fields}estimate double")


def _merged(have: DataFrame, keys: Sequence[str], states: States, fields: str) -> DataFrame:
    """Mergeable states: one for each chunk of a group's values; only those meet in one task."""
    state, merge, finish = states

    def partial(group):  # noqa: ANN001, ANN202
        x = group["__value"].to_numpy(float)
        return group[list(keys)].head(1).assign(__state=[[float(v) for v in state(x, np.ones(len(x), np.int64))]])

    def total(group):  # noqa: ANN001, ANN202
        return group[list(keys)].head(1).assign(estimate=float(finish(reduce(merge, group["__state"]))))

    chunks = have.withColumn("__chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS))
    return chunks.groupBy("__chunk", *keys).applyInPandas(partial, f"{fields}__state array<double>").groupBy(*keys).applyInPandas(total, f"{fields}estimate double")


def estimate_by(df: DataFrame, keys: Sequence[str], value: str, name: str, **params: Any) -> DataFrame:
    """An estimator by group: keys and ``estimate``; groups without a finite value stay (null, or 0 for sum and count)."""
    build(name, **params)
    kind = lookup(name)
    rows = df.select(*keys, finite(F.col(value)).alias("__value"))
    if kind.plain:
        return rows.groupBy(*keys).agg(kind.plain(**params)(F.col("__value")).alias("estimate"))
    everyone = rows.select(*keys).distinct() if keys else None
    have = rows.where(F.col("__value").isNotNull())
    if kind.ranked:
        order = ranked(have, keys, "__value")
        made = order.groupBy(*keys).agg(kind.ranked(**params)(F.col("__value"), F.col("__rank"), F.col("__n")).alias("estimate"))
    else:
        fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
        made = _merged(have, keys, kind.states(**params), fields) if kind.states else _weighed(have, keys, build(name, **params), fields)
    if everyone is None:
        return made
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return everyone.alias("e").join(made.alias("m"), condition, "left").select(*(f"e.{k}" for k in keys), "m.estimate")


def definition(name: str, **params: Any) -> str:
    kind = lookup(name)
    given = {**kind.parameters(), **params}
    return kind.definition + (f" ({', '.join(f'{k}={v}' for k, v in given.items())})" if given else "")


def credibility(name: str, n_units: int, n_values: int | None = None) -> tuple[bool, str]:
    """Whether there are enough units (and values per unit) for the estimator, and why not."""
    kind = lookup(name)
    if n_units < kind.min_units:
        return False, f"{name} needs {kind.min_units} units or more; there are {n_units}"
    if n_values is not None and n_values < kind.min_values:
        return False, f"{name} needs {kind.min_values} values or more in a unit; there are {n_values}"
    return True, "enough units"


def listing() -> list[dict[str, Any]]:
    return [{"name": e.name, "definition": e.definition, "min_units": e.min_units, "min_values": e.min_values, "tail": e.tail, "parameters": e.parameters()} for _, e in sorted(REGISTRY.items())]
