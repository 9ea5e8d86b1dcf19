"""Leave-one-unit-out estimates of ordered values, by ranks alone.

The t-th value that is left without a unit has rank t + c in the whole panel, where c counts
the unit's own values with rank - place < t (place: their order within the unit).  So each
unit needs a look at one or two ranks and at sums up to them, not a pass over the panel:
rows and units are only ever joined on a rank that one row has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.functions.estimators import DEFAULT_QUANTILE, finite
from stratafold.operators.ranks import ranked
from stratafold.scratch import materialize

#: Ranks whose running sums one window adds up: 2 ** CHUNK_BITS.
CHUNK_BITS = 17

#: Of the number of values left: two places, and the estimate from values v and running sums s there.
Form = tuple[Callable[[Column], tuple[Column, Column]], Callable[[Column, list[Column], list[Column]], Column]]


def _quantile(q: float = DEFAULT_QUANTILE) -> Form:
    place = lambda n: F.lit(float(q)) * (n - 1)
    return lambda n: (F.floor(place(n)) + 1, F.ceil(place(n)) + 1), lambda n, v, s: v[0] + (v[1] - v[0]) * (place(n) - F.floor(place(n)))


def _cvar(alpha: float = 0.9, tail: str = "upper") -> Form:
    k = lambda n: F.greatest(F.lit(1), F.ceil(F.round((F.lit(1.0) - F.lit(float(alpha))) * n, 9)))
    return lambda n: (n - k(n), n) if tail == "upper" else (F.lit(0), k(n)), lambda n, v, s: (s[1] - s[0]) / k(n)


def _trimmed(trim: float = 0.1) -> Form:
    cut = lambda n: F.floor(F.lit(float(trim)) * n)
    return lambda n: (cut(n), n - cut(n)), lambda n, v, s: (s[1] - s[0]) / (n - 2 * cut(n))


#: Estimators that this module knows, with their parameters.
FORMS: dict[str, Callable[..., Form]] = {
    "median": lambda: _quantile(0.5),
    "quantile": _quantile,
    "cvar": _cvar,
    "trimmed_mean": _trimmed,
    "min": lambda: _quantile(0.0),
    "max": lambda: _quantile(1.0),
}


def _running(order: DataFrame, by: list[str]) -> DataFrame:
    """by, rank, value and the sum of values up to the rank; windows hold at most a chunk of ranks."""
    chunk = F.shiftright(F.col("rank") - 1, CHUNK_BITS)
    order = order.withColumn("chunk", chunk)
    ahead = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = order.groupBy(*by, "chunk").agg(F.sum("value").alias("own")).withColumn("ahead", F.coalesce(F.sum("own").over(ahead), F.lit(0.0)))
    inside = Window.partitionBy(*by, "chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return order.withColumn("total", F.sum("value").over(inside)).join(sums, [*by, "chunk"]).select(*by, "rank", "value", (F.col("total") + F.col("ahead")).alias("total"))


def leave_one_out(rows: DataFrame, units: DataFrame, estimator: str, params: dict, keys: Sequence[str] = ()) -> DataFrame:
    """units(keys, unit_ix, policy_id) with ``estimate``, that of the policy (in its group) without the unit; null where nothing is left.

    rows: keys, unit_ix, policy_id, value.  Policies without a finite value are absent.
    """
    places, estimate = FORMS[estimator](**params)
    by = [*keys, "policy_id"]
    have = rows.select(*by, "unit_ix", finite(F.col("value")).alias("value")).where(F.col("value").isNotNull())
    order = ranked(have, by, "value", ["unit_ix"]).withColumnRenamed("__rank", "rank").drop("__n")
    order = materialize(order, "leave-out-ranks")
    own = ranked(order, [*by, "unit_ix"], "rank").withColumnsRenamed({"__rank": "place", "__n": "own_n"})
    # One row per group and policy.
    sizes = F.broadcast(order.groupBy(*by).agg(F.count("*").alias("whole")))
    at = places(F.col("whole") - F.col("own_n"))
    before = [F.col("rank") - F.col("place") < t for t in at]
    each = own.join(sizes, by).groupBy(*by, "unit_ix").agg(
        F.max("own_n").alias("own_n"), *(F.count_if(b).alias(f"c{k}") for k, b in enumerate(before)), *(F.coalesce(F.sum(F.when(b, F.col("value"))), F.lit(0.0)).alias(f"o{k}") for k, b in enumerate(before))
    )
    each = units.join(sizes, by).join(each, [*by, "unit_ix"], "left").na.fill(0, ["own_n", "c0", "c1"]).na.fill(0.0, ["o0", "o1"])
    each = each.withColumn("n", F.col("whole") - F.col("own_n"))
    at = places(F.col("n"))
    looks = each.select(*by, "unit_ix", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (at[k] + F.col(f"c{k}")).alias("rank"), F.col(f"o{k}").alias("o")) for k in (0, 1)))).alias("look"))
    looks = looks.select(*by, "unit_ix", "n", "look.*").join(_running(order, by), [*by, "rank"], "left")
    pick = lambda c, k: F.max(F.when(F.col("k") == k, c))
    v = [pick(F.col("value"), k) for k in (0, 1)]
    s = [pick(F.coalesce("total", F.lit(0.0)) - F.col("o"), k) for k in (0, 1)]
    return looks.groupBy(*by, "unit_ix", "n").agg(estimate(F.col("n"), v, s).alias("estimate")).select(*by, "unit_ix", F.when(F.col("n") > 0, F.col("estimate")).alias("estimate"))
