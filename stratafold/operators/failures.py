"""Why observations fail, and how a policy shifts the reasons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.jobs import together

UNSPECIFIED = "unspecified"


def _failed(df: DataFrame, success: str, reason: str) -> Column:
    """Success is 0 (null is not a failure); without that column, a reason is given."""
    return F.coalesce(F.col(success) == 0, F.lit(False)) if success in df.columns else F.col(reason).isNotNull()


def _reason(df: DataFrame, reason: str) -> Column:
    if reason not in df.columns:
        return F.lit(UNSPECIFIED)
    return F.when(F.length(F.trim(reason)) > 0, F.col(reason)).otherwise(F.lit(UNSPECIFIED))


def failure_totals(df: DataFrame, success: str = "mission_success", reason: str = "failure_reason", keys: Sequence[str] = ()) -> DataFrame:
    """Per policy (of each group by keys): observations and failures."""
    return df.groupBy(*keys, "policy_id").agg(F.count("*").alias("observations"), F.count_if(_failed(df, success, reason)).alias("failures"))


def failure_table(df: DataFrame, success: str = "mission_success", reason: str = "failure_reason", keys: Sequence[str] = ()) -> DataFrame:
    """Per policy and reason (of each group by keys): failures, share of the policy's failures, rate of its observations."""
    marked = df.select(*keys, "policy_id", _failed(df, success, reason).alias("failed"), _reason(df, reason).alias("reason"))
    counts = marked.groupBy(*keys, "policy_id", "reason").agg(F.count("*").alias("all"), F.count_if("failed").alias("failures"))
    policy = Window.partitionBy(*keys, "policy_id")
    made = counts.withColumns({"observations": F.sum("all").over(policy), "total": F.sum("failures").over(policy)}).where("failures > 0")
    return made.select(*keys, "policy_id", "reason", "failures", (F.col("failures") / F.col("total")).alias("share_of_failures"), (F.col("failures") / F.col("observations")).alias("rate"))


def failure_shifts(df: DataFrame, unit: str, baseline: str, candidate: str, success: str = "mission_success", reason: str = "failure_reason", keys: Sequence[str] = ()) -> DataFrame:
    """Per reason (of each group by keys): mean over shared units of the rates under both policies and their difference.

    A unit's rate is its failures of the reason over all its observations.  The dense grid
    of units, policies and reasons is never built: a unit without a failure of the reason
    adds 0, so sums of rates over the number of shared units are enough.
    """
    own = df.where(F.col("policy_id").isin(baseline, candidate)).select(*keys, F.col(unit).alias("unit"), "policy_id", _failed(df, success, reason).alias("failed"), _reason(df, reason).alias("reason"))
    sizes = own.groupBy(*keys, "unit", "policy_id").agg(F.count("*").alias("n"))
    both = sizes.groupBy(*keys, "unit").agg(F.count("*").alias("arms")).where("arms = 2").select(*keys, "unit")
    rates = own.where("failed").groupBy(*keys, "unit", "policy_id", "reason").agg(F.count("*").alias("k")).join(sizes, [*keys, "unit", "policy_id"]).join(both, [*keys, "unit"], "left_semi")
    rate = F.col("k") / F.col("n")
    sums = rates.groupBy(*keys, "reason").agg(*(F.coalesce(F.sum(F.when(F.col("policy_id") == p, rate)), F.lit(0.0)).alias(name) for p, name in ((baseline, "base"), (candidate, "cand"))))
    n = both.groupBy(*keys).agg(F.count("*").alias("n_units"))
    joined = sums.join(n, list(keys)) if keys else sums.crossJoin(F.broadcast(n))
    return joined.select(*keys, "reason", (F.col("base") / F.col("n_units")).alias("baseline_rate"), (F.col("cand") / F.col("n_units")).alias("candidate_rate"), ((F.col("cand") - F.col("base")) / F.col("n_units")).alias("shift"), "n_units")


@dataclass
class FailureSummary:
    totals: list[dict]
    table: list[dict]
    shifts: dict[str, list[dict]]

    def worst(self, candidate: str) -> str | None:
        """Reason that the candidate raises most."""
        rows = [r for r in self.shifts.get(candidate, []) if r["shift"] > 0]
        return max(rows, key=lambda r: (r["shift"], r["reason"]))["reason"] if rows else None


def summarize_failures(df: DataFrame, unit: str, baseline: str, candidates: list[str], reason: str = "failure_reason", success: str = "mission_success") -> FailureSummary | None:
    """All three tables, shifts for every candidate; None if the records tell nothing of failures."""
    found = failure_summaries(df.withColumn("__all", F.lit("all")), unit, baseline, candidates, "__all", reason, success)
    return None if found is None else found.get("all", FailureSummary([], [], {c: [] for c in candidates}))


def failure_summaries(df: DataFrame, unit: str, baseline: str, candidates: list[str], key: str, reason: str = "failure_reason", success: str = "mission_success") -> dict[str, FailureSummary] | None:
    """``summarize_failures`` of every group, in as many jobs as for one."""
    if success not in df.columns and reason not in df.columns:
        return None
    rows = lambda t, *order: t.orderBy(key, *order).collect()
    totals, table, *shifts = together(
        lambda: rows(failure_totals(df, success, reason, [key]), "policy_id"),
        lambda: rows(failure_table(df, success, reason, [key]), "policy_id", F.col("failures").desc(), "reason"),
        *(lambda c=c: rows(failure_shifts(df, unit, baseline, c, success, reason, [key]), F.col("shift").desc(), "reason") for c in candidates),
    )
    out = {r[key]: FailureSummary([], [], {c: [] for c in candidates}) for r in totals}
    plain = lambda r: {k: v for k, v in r.asDict().items() if k != key}
    for r in totals:
        out[r[key]].totals.append(plain(r))
    for r in table:
        out[r[key]].table.append(plain(r))
    for c, found in zip(candidates, shifts, strict=True):
        for r in found:
            out[r[key]].shifts[c].append(plain(r))
    return out
