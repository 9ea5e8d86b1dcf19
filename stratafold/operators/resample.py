"""Cluster bootstrap: units are drawn whole, with replacement.

How often a replicate draws a unit follows from counters alone (``multiplicity``), so each task
finds it beside the rows that it holds.  Where an estimator is a function of sums
(``ALGEBRAIC``), units are reduced to sufficient statistics, a task weighs those of its units for all
replicates by one matrix product, and only its sums leave it: replicates times tasks rows.
For order statistics every replicate weighs the panel; the panel is broadcast if it has at
most ``BROADCAST_ROWS`` rows, and beyond that ``histogram`` finds the ranks of all replicates at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import estimators, intervals
from stratafold.hierarchy import unit_label
from stratafold.operators import histogram, leave_out
from stratafold.operators.multiplicity import AT_ONCE, BASE, CANDIDATE, ITSELF, SUB, UNIT, WITHIN, weights
from stratafold.operators.pairing import PairedPanel
from stratafold.operators.ranks import ranked
from stratafold.scratch import materialize

__all__ = ["BASE", "CANDIDATE", "ITSELF", "SUB", "BootstrapError", "BootstrapResult", "cluster_bootstrap", "design_effect", "draws", "naive_iid_bootstrap", "paired_cluster_bootstrap", "replicates"]

#: Panel rows up to which order statistics ship the panel to every task.
BROADCAST_ROWS = 1_000_000
#: Fewer units make intervals optimistic; fewer usable replicates make none.
FEW_UNITS = 20
LEAST_REPLICATES = 100
#: Rows whose draws a task computes together.
LEAVES = 1 << 16


class BootstrapError(ValueError):
    """No interval can be given."""


def _blocks(spark: SparkSession, n_resamples: int) -> DataFrame:
    """Numbers of all replicates, ``ITSELF`` too, over all tasks."""
    tasks = max(1, min(n_resamples + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(ITSELF, n_resamples, numPartitions=tasks).withColumnRenamed("id", "b")


def draws(spark: SparkSession, seed: int, n_resamples: int, n_units: int, stream: int = BASE) -> DataFrame:
    """(b, unit_ix, w) for every replicate and unit that it draws, w times; ``ITSELF`` is among them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = pd.DataFrame({"unit_ix": np.arange(n_units), "k": n_units})
        for frame in frames:
            numbers = frame["b"].to_numpy()
            step = max(1, AT_ONCE // n_units)
            for at in range(0, len(numbers), step):
                b = numbers[at : at + step]
                w = weights(seed, stream, b, leaves)
                row, unit = np.nonzero(w)
                yield pd.DataFrame({"b": b[row], "unit_ix": unit, "w": w[row, unit]})

    return _blocks(spark, n_resamples).mapInPandas(run, "b bigint, unit_ix bigint, w bigint")


def numbered(units: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """units (one row each) with unit_ix, the position in code-point order within keys, and k, the number of units there."""
    placed = ranked(units, list(keys), "unit")
    return placed.withColumn("unit_ix", F.col("__rank") - 1).withColumnRenamed("__n", "k").drop("__rank")


def unit_index(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, unit, unit_ix, k)."""
    return numbered(rows.select(*keys, "unit").distinct(), keys)


def _statistics(policies: Sequence[str], estimator: str, threshold: float) -> list[Column]:
    """n0, s0, ss0, n1, ...: count, sum and sum of squares of each policy; of the indicator for an exceedance."""
    x = (F.col("value") > threshold).cast("double") if estimator == "p_exceed" else F.col("value")
    out = []
    for k, p in enumerate(policies):
        own = F.col("policy_id") == p
        out += [F.count(F.when(own, F.col("value"))).cast("double").alias(f"n{k}"), F.coalesce(F.sum(F.when(own, x)), F.lit(0.0)).alias(f"s{k}"), F.coalesce(F.sum(F.when(own, x * x)), F.lit(0.0)).alias(f"ss{k}")]
    return out


def _combined(estimator: str, n: Column, s: Column, ss: Column) -> Column:
    """The estimator from total count, sum and sum of squares."""
    if estimator == "sum":
        return F.when(n > 0, s).otherwise(0.0)
    if estimator == "count":
        return F.coalesce(n, F.lit(0.0))
    if estimator == "std":
        return F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), ss - s * s / n) / (n - 1)))
    return F.when(n > 0, s / n)


def wide(rows: DataFrame, policies: Sequence[str], estimator: str = "mean", threshold: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """One row per unit: keys, unit, unit_ix, k and the statistics of each policy, 0 where it has none."""
    return numbered(rows.groupBy(*keys, "unit").agg(*_statistics(policies, estimator, threshold)), keys)


def sub_units(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, unit, policy_id, sub) with ``UNIT`` and ``WITHIN``: sub-units in code-point order within a unit and policy."""
    units = unit_index(rows, keys).select(*keys, "unit", *UNIT)
    subs = ranked(rows.select(*keys, "unit", "policy_id", "sub").distinct(), [*keys, "unit", "policy_id"], "sub").withColumnsRenamed({"__rank": "sub_ix", "__n": "n_subs"})
    lists = ranked(subs.where("sub_ix = 1").select(*keys, "unit", "policy_id"), list(keys), "unit", ["policy_id"]).select(*keys, "unit", "policy_id", (F.col("__rank") - 1).alias("root"))
    return subs.withColumn("sub_ix", F.col("sub_ix") - 1).join(units, [*keys, "unit"]).join(lists, [*keys, "unit", "policy_id"])


def _on_subs(rows: DataFrame, subs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """rows with ``UNIT`` and ``WITHIN``; a null sub-unit is one."""
    r, s = rows.alias("r"), subs.alias("s")
    same = F.col("r.sub").eqNullSafe(F.col("s.sub"))
    for c in (*keys, "unit", "policy_id"):
        same = same & (F.col(f"r.{c}") == F.col(f"s.{c}"))
    return r.join(s, same).select(*(F.col(f"r.{c}") for c in (*keys, "policy_id", "value")), *(F.col(f"s.{c}") for c in (*UNIT, *WITHIN)))


def algebraic_replicates(leaves: DataFrame, policies: Sequence[str], estimator: str, seed: int, n_resamples: int, streams: Sequence[int] = (BASE,), keys: Sequence[str] = (), apart: bool = False) -> DataFrame:
    """(keys, b, e0, e1, ...): the estimator of each policy in each replicate, ``ITSELF`` too.

    leaves: ``wide``, or sub-units with their statistics.  streams: one for each policy; one stands for all if they are paired.
    Groups (by keys) draw from their own units what each would draw alone; with ``apart``, which takes one whole-number key, their draws differ.
    """
    names = [f"{c}{i}" for i in range(len(policies)) for c in ("n", "s", "ss")]
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    counters = [c for c in (*UNIT, *WITHIN) if c in kinds]
    owned = [list(range(len(names)))] if len(streams) == 1 else [list(range(3 * i, 3 * i + 3)) for i in range(len(policies))]
    numbers = np.arange(ITSELF, n_resamples)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in _gathered(frames, LEAVES):
            if apart:
                group = table[keys[0]].to_numpy(np.int64)
            else:
                group = table.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(table), np.int64)
            order = np.argsort(group, kind="stable")
            table, group = table.iloc[order], group[order]
            starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            ends = np.append(starts[1:], len(table))
            stats = table[names].to_numpy(float)
            step = max(1, AT_ONCE // len(table))
            for at in range(0, len(numbers), step):
                b = numbers[at : at + step]
                total = np.zeros((len(starts), len(b), len(names)))
                for stream, own in zip(streams, owned, strict=True):
                    w = weights(seed, stream, b, table[counters], group, apart).astype(float)
                    for g, (start, end) in enumerate(zip(starts, ends, strict=True)):
                        total[g][:, own] = w[:, start:end] @ stats[start:end, own]
                made = pd.DataFrame(total.reshape(-1, len(names)), columns=names)
                made.insert(0, "b", np.tile(b, len(starts)))
                for c in keys:
                    made[c] = table[c].iloc[np.repeat(starts, len(b))].to_numpy()
                yield made[[*keys, "b", *names]]

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "b bigint", *(f"{c} double" for c in names)])
    tasks = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor(F.col("unit_ix") * tasks / F.col("k"))  # neighbours share most of the tree
    sums = leaves.repartition(tasks, *keys, block).select(*keys, *counters, *names).mapInPandas(run, schema)
    whole = sums.groupBy(*keys, "b").agg(*(F.sum(c).alias(c) for c in names))
    return whole.select(*keys, "b", *(_combined(estimator, *(F.col(f"{c}{i}") for c in ("n", "s", "ss"))).alias(f"e{i}") for i in range(len(policies))))


def _gathered(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """A task's batches in tables of about ``most`` rows."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= most:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def order_replicates(rows: DataFrame, policies: Sequence[str], estimator: str, params: dict, seed: int, n_resamples: int, streams: Sequence[int] = (BASE,), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, b, e0, e1, ...) for estimators of ordered values, ``ITSELF`` too.

    rows: keys, ``UNIT`` (and ``WITHIN``), policy_id, value.
    """
    counters = [c for c in (*UNIT, *WITHIN) if c in rows.columns]
    rows = rows.select(*keys, *counters, "policy_id", estimators.finite(F.col("value")).alias("value")).where(F.col("value").isNotNull())
    if rows.count() > BROADCAST_ROWS:
        if estimator in leave_out.FORMS:
            return _by_policy(histogram.replicates(rows, policies, leave_out.FORMS[estimator](**params), seed, n_resamples, streams, keys), policies, keys)
        return _joined_replicates(rows, policies, estimator, params, seed, n_resamples, streams, keys)
    table = rows.toPandas().sort_values(["policy_id", "value"], kind="stable")  # size checked above
    leaf = table.groupby([*keys, *counters], sort=False).ngroup().to_numpy() if len(table) else np.zeros(0, np.int64)
    leaves = table.iloc[np.unique(leaf, return_index=True)[1]]
    group = leaves.groupby(list(keys)).ngroup().to_numpy() if keys and len(leaves) else np.zeros(len(leaves), np.int64)
    names = leaves[list(keys)].iloc[np.unique(group, return_index=True)[1]] if keys else pd.DataFrame(index=[0])
    arms = [[(leaf[own], table["value"].to_numpy(float)[own]) for p in policies for own in [((table["policy_id"] == p).to_numpy() & (group[leaf] == g))]] for g in range(len(names))]
    held = rows.sparkSession.sparkContext.broadcast((leaves[counters], group, names, arms))
    kernel = estimators.build(estimator, **params)
    paired = len(streams) == 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves, group, names, arms = held.value
        for frame in frames:
            numbers = frame["b"].to_numpy()
            step = max(1, AT_ONCE // max(1, len(leaves)))
            for at in range(0, len(numbers), step):
                b = numbers[at : at + step]
                drawn = [weights(seed, s, b, leaves, group) for s in streams]
                for g, own in enumerate(arms):
                    same = {c: names[c].iloc[g] for c in names}
                    yield pd.DataFrame({**same, "b": b, **{f"e{i}": [kernel(values, w[at_leaf]) for w in drawn[0 if paired else i]] for i, (at_leaf, values) in enumerate(own)}})

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), "b bigint", *(f"e{i} double" for i in range(len(policies)))])
    return _blocks(rows.sparkSession, n_resamples).mapInPandas(run, schema)


def _by_policy(each: DataFrame, policies: Sequence[str], keys: Sequence[str], number: str = "b") -> DataFrame:
    """(keys, number, policy_id, estimate) -> (keys, number, e0, e1, ...)."""
    return each.groupBy(*keys, number).agg(*(F.max(F.when(F.col("policy_id") == p, F.col("estimate"))).alias(f"e{k}") for k, p in enumerate(policies)))


def _joined_replicates(rows: DataFrame, policies: Sequence[str], estimator: str, params: dict, seed: int, n_resamples: int, streams: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Custom estimators of panels too large to broadcast: each task repeats its rows as drawn, estimated by (keys, b, policy)."""
    counters = [c for c in (*UNIT, *WITHIN) if c in rows.columns]
    numbers = np.arange(ITSELF, n_resamples)
    names = [*keys, "policy_id"]

    def drawn(stream: int):  # noqa: ANN202
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for table in _gathered(frames, LEAVES):
                group = table.groupby(list(keys)).ngroup().to_numpy() if keys else None
                for b in np.array_split(numbers, max(1, len(numbers) * len(table) // AT_ONCE)):
                    if len(b):
                        w = weights(seed, stream, b, table[counters], group)
                        which, row = np.nonzero(w)
                        again = np.repeat(np.arange(len(row)), w[which, row])
                        yield table[[*names, "value"]].iloc[row[again]].assign(b=b[which[again]])[[*names, "b", "value"]]

        return run

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), "b bigint", "value double"])
    made = None
    for k, stream in enumerate(streams):
        own = list(policies) if len(streams) == 1 else [policies[k]]
        repeated = rows.where(F.col("policy_id").isin(own)).mapInPandas(drawn(stream), schema)
        each = estimators.estimate_by(repeated, [*keys, "b", "policy_id"], "value", estimator, **params)
        made = each if made is None else made.unionByName(each)
    return _by_policy(made, policies, keys)


def replicates(
    rows: DataFrame, policies: Sequence[str], estimator: str = "mean", params: dict | None = None, *, seed: int = 0, n_resamples: int = 2000, streams: Sequence[int] = (BASE,), two_stage: bool = False, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, b, e0, e1, ...): estimates of each policy in each replicate; those of the replicate ``ITSELF`` are the panel's.

    rows: keys, unit, policy_id, value, and sub for two stages: units first, then as many sub-units within each drawn unit
    and policy.  Groups by keys (strings, never null) are resampled as each would be alone, all in the same jobs.
    """
    params = params or {}
    threshold = float(params.get("threshold", 0.0))
    if estimator in estimators.ALGEBRAIC:
        if two_stage:
            leaves = _on_subs(rows, sub_units(rows, keys), keys).groupBy(*keys, *UNIT, *WITHIN).agg(*_statistics(policies, estimator, threshold))
        else:
            leaves = wide(rows, policies, estimator, threshold, keys)
        return algebraic_replicates(leaves, policies, estimator, seed, n_resamples, streams, keys)
    placed = _on_subs(rows, sub_units(rows, keys), keys) if two_stage else rows.join(unit_index(rows, keys), [*keys, "unit"]).select(*keys, *UNIT, "policy_id", "value")
    return order_replicates(placed, policies, estimator, params, seed, n_resamples, streams, keys)


@dataclass
class BootstrapResult:
    """An estimate with its replicates."""

    estimate: float
    low: float
    high: float
    se: float
    method: str
    n_units: int
    replicates: np.ndarray
    p_value: float | None = None
    notes: list[str] = field(default_factory=list)
    seed: int = 0
    confidence_level: float = 0.95

    @property
    def excludes_zero(self) -> bool:
        return self.low > 0 or self.high < 0


def leave_one_out(rows: DataFrame, policies: Sequence[str], estimator: str = "mean", params: dict | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, unit_ix, e0, e1, ...): estimates without each unit: totals minus own for sums, by ranks for ordered values.

    rows: keys, unit, policy_id, value.  A custom estimator weighs the panel once for each unit.
    """
    params = params or {}
    if estimator in estimators.ALGEBRAIC:
        table = materialize(wide(rows, policies, estimator, float(params.get("threshold", 0.0)), keys), "leave-one-out")
        names = [f"{c}{i}" for i in range(len(policies)) for c in ("n", "s", "ss")]
        totals = table.groupBy(*keys).agg(*(F.sum(c).alias(f"t_{c}") for c in names))
        left = table.join(totals, list(keys)) if keys else table.crossJoin(F.broadcast(totals))  # one row
        return left.select(*keys, "unit_ix", *(_combined(estimator, *(F.col(f"t_{c}{i}") - F.col(f"{c}{i}") for c in ("n", "s", "ss"))).alias(f"e{i}") for i in range(len(policies))))
    index = materialize(unit_index(rows, keys), "units")
    placed = rows.join(index, [*keys, "unit"]).select(*keys, "unit_ix", "policy_id", "value")
    if estimator in leave_out.FORMS:
        units = index.select(*keys, "unit_ix", F.explode(F.array(*map(F.lit, policies))).alias("policy_id"))
        each = leave_out.leave_one_out(placed, units, estimator, params, keys)
    else:
        # Each unit's values go to every other unit of its group: what the estimator does with them is not known.
        on = [F.col(f"o.{c}") == F.col(f"i.{c}") for c in keys]
        others = index.alias("i").join(index.alias("o"), [*on, F.col("o.unit_ix") != F.col("i.unit_ix")]).select(*(F.col(f"i.{c}").alias(c) for c in keys), F.col("i.unit_ix").alias("unit_ix"), F.col("o.unit_ix").alias("out"))
        each = estimators.estimate_by(placed.join(others, [*keys, "unit_ix"]), [*keys, "out", "policy_id"], "value", estimator, **params).withColumnRenamed("out", "unit_ix")
    return _by_policy(each, policies, keys, "unit_ix")


def influence(left: DataFrame, series: dict[str, Column], keys: Sequence[str] = ()) -> dict[tuple, dict[str, intervals.Influence]]:
    """By group what an interval needs of leave-one-out estimates: central moments, merged over tasks; one row a group reaches the driver."""
    aggregates = []
    for name, x in series.items():
        usable = estimators.finite(x)
        aggregates += [F.count("*").alias(f"{name}_n"), F.count(usable).alias(f"{name}_finite"), F.skewness(usable).alias(f"{name}_skewness")]
    rows = left.groupBy(*keys).agg(*aggregates).collect()
    return {tuple(r[c] for c in keys): {name: intervals.Influence(r[f"{name}_n"], r[f"{name}_finite"], r[f"{name}_skewness"]) for name in series} for r in rows}


def _result(point: float, made: np.ndarray, left: intervals.Influence | None, n_units: int, level: float, method: str, seed: int, paired: bool) -> BootstrapResult:
    usable = made[np.isfinite(made)]
    notes = []
    if len(usable) < len(made):
        notes.append(f"{len(made) - len(usable)} replicate(s) gave no finite value and were left out")
    if len(usable) < LEAST_REPLICATES:
        raise BootstrapError(f"only {len(usable)} usable replicates; {LEAST_REPLICATES} are needed")
    low, high, used, note = intervals.interval(point, usable, level, method, left)
    if note:
        notes.append(note)
    if n_units < FEW_UNITS:
        notes.append(f"{n_units} units are few; intervals from fewer than {FEW_UNITS} tend to be too narrow")
    return BootstrapResult(point, low, high, float(np.std(usable, ddof=1)), used, n_units, usable, intervals.p_two_sided(usable) if paired else None, notes, seed, level)


def paired_results(table: pd.DataFrame, n_units: int, level: float, method: str, seed: int, left: dict[str, intervals.Influence] | None = None) -> dict[str, BootstrapResult]:
    """Baseline, candidate and difference from the replicates (b, e0, e1) of two policies."""
    table = table.sort_values("b")
    base, cand = table.loc[table["b"] == ITSELF, ["e0", "e1"]].to_numpy(float)[0]
    table = table[table["b"] != ITSELF]
    e0, e1 = table["e0"].to_numpy(float), table["e1"].to_numpy(float)
    series = {"baseline": (base, e0), "candidate": (cand, e1), "difference": (cand - base, e1 - e0)}
    return {k: _result(v, made, left[k] if left else None, n_units, level, method, seed, k == "difference") for k, (v, made) in series.items()}


def paired_cluster_bootstrap(
    panel: PairedPanel, estimator: str = "mean", params: dict | None = None, *, n_resamples: int = 2000, seed: int = 0, confidence_level: float = 0.95, method: str = "percentile", hierarchical: bool = False, paired: bool = True
) -> dict[str, BootstrapResult]:
    """Baseline, candidate and difference (candidate minus baseline) of the panel's first two policies."""
    alone = replace(panel, rows=panel.rows.withColumn("__all", F.lit("all")))
    found = grouped_bootstraps({"all": alone}, "__all", estimator, params, n_resamples=n_resamples, seed=seed, confidence_level=confidence_level, method=method, hierarchical=hierarchical, paired=paired)["all"]
    if isinstance(found, BootstrapError):
        raise found
    return found


def grouped_bootstraps(
    panels: dict[str, PairedPanel], key: str, estimator: str = "mean", params: dict | None = None, *, n_resamples: int = 2000, seed: int = 0, confidence_level: float = 0.95, method: str = "percentile", hierarchical: bool = False, paired: bool = True
) -> dict[str, dict[str, BootstrapResult] | BootstrapError]:
    """``paired_cluster_bootstrap`` of every group, in as many jobs as for one.

    panels: by the group's name in the column ``key``; all hold the rows of all groups, and the same policies.
    """
    out: dict[str, dict[str, BootstrapResult] | BootstrapError] = {g: BootstrapError("fewer than two units; nothing can be resampled") for g, p in panels.items() if p.n_units < 2}
    able = [g for g in panels if g not in out]
    if not able:
        return out
    pair = panels[able[0]].policies[:2]
    rows = panels[able[0]].rows.where(F.col("policy_id").isin(list(pair)) & F.col(key).isin(able))
    if hierarchical:
        deep = rows.groupBy(key, "unit", "policy_id").agg(F.countDistinct("sub").alias("k")).where("k > 1").select(key).distinct()
        has = {r[0] for r in deep.collect()}  # a row for each group
        out |= {g: BootstrapError("a two-stage bootstrap needs sub-units below the unit at the metric's level") for g in able if g not in has}
        able = [g for g in able if g in has]
    for streams in ((BASE,), (BASE, CANDIDATE)):
        own = [g for g in able if ((paired and panels[g].paired) or hierarchical) == (len(streams) == 1)]
        if not own:
            continue
        mine = rows if len(own) == len(panels) else rows.where(F.col(key).isin(own))
        table = replicates(mine, pair, estimator, params, seed=seed, n_resamples=n_resamples, streams=streams, two_stage=hierarchical, keys=[key]).toPandas()  # a row for each group and replicate
        left = influence(leave_one_out(mine, pair, estimator, params, [key]), {"baseline": F.col("e0"), "candidate": F.col("e1"), "difference": F.col("e1") - F.col("e0")}, [key]) if method == "bca" else {}
        for g in own:
            try:
                out[g] = paired_results(table[table[key] == g], panels[g].n_units, confidence_level, method, seed, left.get((g,)))
            except BootstrapError as e:
                out[g] = e
    return out


def cluster_bootstrap(rows: DataFrame, estimator: str = "mean", params: dict | None = None, *, n_resamples: int = 2000, seed: int = 0, confidence_level: float = 0.95, method: str = "percentile", hierarchical: bool = False) -> BootstrapResult:
    """One policy's estimate.  rows: unit, policy_id, value, sub of a single policy."""
    rows = rows.withColumn("policy_id", F.lit("one"))
    n = rows.select(F.countDistinct("unit")).first()[0]
    if n < 2:
        raise BootstrapError("fewer than two units; nothing can be resampled")
    table = replicates(rows, ("one",), estimator, params, seed=seed, n_resamples=n_resamples, two_stage=hierarchical).toPandas().sort_values("b")  # a row for each replicate
    left = influence(leave_one_out(rows, ("one",), estimator, params), {"one": F.col("e0")})[()]["one"] if method == "bca" else None
    point = float(table.loc[table["b"] == ITSELF, "e0"].to_numpy(float)[0])
    return _result(point, table.loc[table["b"] != ITSELF, "e0"].to_numpy(float), left, n, confidence_level, method, seed, False)


def naive_iid_bootstrap(rows: DataFrame, estimator: str = "mean", params: dict | None = None, **options: object) -> BootstrapResult:
    """Every row drawn on its own, for contrast only: it ignores the nesting."""
    return cluster_bootstrap(rows.withColumn("unit", unit_label(("label",)) if "label" in rows.columns else F.monotonically_increasing_id().cast("string")), estimator, params, **options)


def design_effect(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-way random effects (of each group): n_units, n, icc, design_effect, effective_n; nulls where they cannot be had."""
    unit = rows.groupBy("unit", *by).agg(F.count("value").cast("double").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_samp("value") * (F.count("value") - 1), F.lit(0.0)).alias("ssw"))
    total = unit.groupBy(*by).agg(F.count("*").cast("double").alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum("ssw").alias("ssw"))
    ssb = F.col("q") - F.col("s") * F.col("s") / F.col("N")
    facts = total.withColumns({"msb": F.try_divide(ssb, F.col("k") - 1), "msw": F.try_divide(F.col("ssw"), F.col("N") - F.col("k")), "m0": F.try_divide(F.col("N") - F.col("nn") / F.col("N"), F.col("k") - 1)})
    between = F.greatest(F.try_divide(F.col("msb") - F.col("msw"), F.col("m0")), F.lit(0.0))
    icc = F.try_divide(between, between + F.col("msw"))
    usable = (F.col("k") >= 2) & (F.col("N") > F.col("k")) & (F.col("m0") > 0)
    icc = F.when(usable, icc)
    effect = 1 + (F.col("N") / F.col("k") - 1) * icc
    return facts.select(*by, F.col("k").cast("bigint").alias("n_units"), F.col("N").cast("bigint").alias("n"), icc.alias("icc"), effect.alias("design_effect"), (F.col("N") / effect).alias("effective_n"))


