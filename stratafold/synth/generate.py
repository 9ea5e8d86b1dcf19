"""Synthetic nested experiments whose true effects are known by construction.

loss = level + unit + unit-by-policy + shift + event + noise + rare catastrophes, plus an
optional shock shared by units of one event group.  Everything is drawn on the driver:
scenarios are small; ``scaled`` makes large tables from hashes of row numbers instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and levels of the generated columns.
REASONS = ("reason_a", "reason_b", "reason_c", "reason_d")
ACTIONS = ("action_1", "action_2", "action_3", "action_4")
STRATA = {"difficulty": ("easy", "hard"), "scale": ("small", "large"), "regime": ("calm", "volatile"), "capacity": ("high", "low")}


@dataclass(frozen=True)
class Policy:
    """How an arm behaves."""

    name: str
    shift: float = 0.0
    catastrophe_rate: float = 0.0
    catastrophe_size: float = 0.0
    noise: float = 2.0
    crash_rate: float = 0.0
    crash_by_difficulty: float = 0.0
    success_offset: float = 0.0
    reasons: tuple[float, ...] = (0.4, 0.3, 0.2, 0.1)


@dataclass(frozen=True)
class World:
    """The design and its variance components."""

    n_units: int = 30
    n_events: int = 3
    n_observations: int = 10
    level: float = 12.0
    unit_sd: float = 3.0
    interaction_sd: float = 0.8
    event_sd: float = 1.0
    shared_shock_sd: float = 0.0
    events_span_units: bool = False
    strata: tuple[str, ...] = ()
    stratum_effects: dict[str, float] = field(default_factory=dict)


def generate_experiment(world: World, policies: Sequence[Policy], seed: int) -> pd.DataFrame:
    """One row per unit, event, policy and observation."""
    rng = np.random.default_rng(seed)
    unit = rng.normal(0, world.unit_sd, world.n_units)
    shock = rng.normal(0, world.shared_shock_sd, world.n_events)
    event = rng.normal(0, world.event_sd, (world.n_units, world.n_events))
    own = rng.normal(0, world.interaction_sd, (world.n_units, len(policies)))
    shape = (world.n_units, world.n_events, len(policies), world.n_observations)
    u, e, p, r = (x.ravel() for x in np.indices(shape))
    levels = {k: np.array(STRATA[k])[(np.arange(world.n_units) >> i) & 1] for i, k in enumerate(world.strata)}
    pick = lambda name: np.array([getattr(q, name) for q in policies])[p]
    loss = world.level + unit[u] + own[u, p] + pick("shift") + event[u, e] + (shock[e] if world.shared_shock_sd else 0.0)
    for k, effect in world.stratum_effects.items():
        loss = loss + effect * (levels[k][u] == STRATA[k][1])
    loss = loss + rng.normal(0, 1, len(u)) * pick("noise")
    loss = np.maximum(0.0, loss + (rng.random(len(u)) < pick("catastrophe_rate")) * pick("catastrophe_size"))
    success = (rng.random(len(u)) < 1 / (1 + np.exp((loss - world.level) / 3 - 1.5 - pick("success_offset")))).astype(float)
    hard = (unit - unit.min()) / (np.ptp(unit) or 1)
    runs = rng.random(shape[:3])
    crashed = runs[u, e, p] < pick("crash_rate") * (1 + pick("crash_by_difficulty") * hard[u])
    mix = np.array([np.cumsum(q.reasons) / sum(q.reasons) for q in policies])
    reason = np.array(REASONS)[(rng.random(len(u))[:, None] > mix[p]).sum(axis=1).clip(max=3)]
    names = [f"u{k:04d}" for k in range(world.n_units)]
    group = [f"g0000-e{j:02d}" for j in range(world.n_events)]
    table = pd.DataFrame({"world_id": np.array(names)[u]})
    table["event_id"] = np.array(group)[e] if world.events_span_units else [f"{names[a]}-e{b:02d}" for a, b in zip(u, e, strict=True)]
    table["policy_id"] = np.array([q.name for q in policies])[p]
    table["resident_id"] = [f"{names[a]}-e{b:02d}-r{c:03d}" for a, b, c in zip(u, e, r, strict=True)]
    table["run_status"] = np.where(crashed, "crashed", "completed")
    table["action"] = np.array(ACTIONS)[rng.integers(0, 4, len(u))]
    table["mission_success"], table["loss"] = success, loss
    table["travel_time"] = np.maximum(0, 15 + 0.5 * loss + rng.normal(0, 1, len(u)))
    table["resource_use"] = np.maximum(0, 1 + 0.05 * loss + rng.normal(0, 0.3, len(u)))
    table["responder_exposure"] = np.maximum(0, 0.05 * loss + rng.normal(0, 0.1, len(u)))
    table["failure_reason"] = np.where((success == 0) & ~crashed, reason, None)
    outcome = ["action", "mission_success", "loss", "travel_time", "resource_use", "responder_exposure"]
    table.loc[crashed, outcome] = None
    for k, values in levels.items():
        table[k] = values[u]
    table["stratum"] = ["|".join(f"{k}={levels[k][a]}" for k in sorted(levels)) or "all" for a in u]
    return table


def hardest_units(table: pd.DataFrame, n: int, policy: str | None = None) -> list[str]:
    rows = table if policy is None else table[table["policy_id"] == policy]
    means = rows.groupby("world_id")["loss"].mean()
    return sorted(means.sort_values(ascending=False).index[:n])


def drop_records(table: pd.DataFrame, policy: str, units: Sequence[str]) -> pd.DataFrame:
    return table[~((table["policy_id"] == policy) & table["world_id"].isin(units))].reset_index(drop=True)


def mark_status(table: pd.DataFrame, policy: str, units: Sequence[str], status: str = "crashed") -> pd.DataFrame:
    """Runs of a policy on some units end otherwise: no outcomes."""
    out = table.copy()
    hit = (out["policy_id"] == policy) & out["world_id"].isin(units)
    out.loc[hit, "run_status"] = status
    out.loc[hit, ["action", "mission_success", "loss", "travel_time", "resource_use", "responder_exposure", "failure_reason"]] = None
    return out


def to_spark(spark: SparkSession, table: pd.DataFrame) -> DataFrame:
    from stratafold.schema import record_schema, spark_type
    from pyspark.sql.types import StringType, StructField, StructType

    known = {f.name: f for f in record_schema().fields}
    schema = StructType([known.get(c, StructField(c, spark_type(c) or StringType())) for c in table.columns])
    return spark.createDataFrame(table.astype(object).where(table.notna(), None), schema)


def scaled(spark: SparkSession, n_units: int, n_events: int = 3, n_observations: int = 10, shift: float = 0.5, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """A large experiment made on the executors: normals from hashes of row numbers, the same on any cluster."""

    def normal(*what: str):  # noqa: ANN202
        share = lambda salt: (F.pmod(F.xxhash64(*(F.col(w) for w in what), F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        return F.sqrt(-2 * F.log(share(1))) * F.cos(2 * np.pi * share(2))

    rows = spark.range(0, n_units * n_events * n_observations * 2, 1, partitions or spark.sparkContext.defaultParallelism)
    rows = rows.select("id", (F.col("id") % 2).alias("p"), (F.floor(F.col("id") / 2) % n_observations).alias("r"), (F.floor(F.col("id") / (2 * n_observations)) % n_events).alias("e"), F.floor(F.col("id") / (2 * n_observations * n_events)).alias("u"))
    loss = 12 + 3 * normal("u") + 0.8 * normal("u", "p") + normal("u", "e") + 2 * normal("id") + shift * F.col("p")
    unit = F.concat(F.lit("u"), F.col("u"))
    return rows.select(unit.alias("world_id"), F.concat(unit, F.lit("-e"), F.col("e")).alias("event_id"), F.when(F.col("p") == 0, "policy_a").otherwise("policy_b").alias("policy_id"), F.concat(unit, F.lit("-e"), F.col("e"), F.lit("-r"), F.col("r")).alias("resident_id"), F.greatest(F.lit(0.0), loss).alias("loss"))
