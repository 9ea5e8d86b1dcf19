"""Policies side by side on the units they share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.functions.estimators import estimate_by, finite

#: Absolute standardised difference above which shared units are not typical.
TYPICAL = 0.2
NAMED_UNITS = 10


class PairingError(ValueError):
    """The policies cannot be compared on these records."""


@dataclass
class PairedPanel:
    """A metric's rows (unit, policy_id, value, sub) of two or more policies, and which units they cover."""

    rows: DataFrame
    policies: tuple[str, ...]
    paired: bool
    n_units: int
    n_shared: int
    n_union: int
    dropped: dict[str, int] = field(default_factory=dict)

    @property
    def coverage(self) -> float:
        """Share of all units that every policy covers."""
        return self.n_shared / self.n_union if self.n_union else 0.0

    def estimand(self) -> str:
        if self.n_shared == self.n_union:
            return "all units; every policy covers each of them"
        if self.paired:
            return f"the {self.n_shared} of {self.n_union} units that every policy covers; the others are left out, which changes the estimand"
        return f"UNPAIRED: all {self.n_union} units, of which {self.n_shared} are covered by every policy"


def shared_units(rows: DataFrame, policies: Sequence[str], unit: str = "unit") -> DataFrame:
    """Units with rows of every given policy."""
    own = rows.where(F.col("policy_id").isin(list(policies)))
    return own.groupBy(unit).agg(F.countDistinct("policy_id").alias("n")).where(F.col("n") == len(set(policies))).select(unit)


def dropped_units(rows: DataFrame, policies: Sequence[str], unit: str = "unit") -> DataFrame:
    """(policy_id, unit) of units that other policies cover and this one does not."""
    own = rows.where(F.col("policy_id").isin(list(policies))).select("policy_id", unit).distinct()
    return own.select(unit).distinct().crossJoin(own.sparkSession.createDataFrame([(p,) for p in sorted(set(policies))], "policy_id string")).join(own, ["policy_id", unit], "left_anti").select("policy_id", unit)


def build_paired_panel(panel: DataFrame, policies: Sequence[str], require_common_units: bool = True) -> PairedPanel:
    """The panel's finite values of the policies, restricted to shared units unless all units are asked for."""
    found = paired_panels(panel.withColumn("__all", F.lit("all")), policies, "__all", require_common_units).get("all", PairingError(f"policy {policies[0]} has no finite value"))
    if isinstance(found, PairingError):
        raise found
    return replace(found, rows=found.rows.drop("__all"))


def paired_panels(panel: DataFrame, policies: Sequence[str], key: str, require_common_units: bool = True) -> dict[str, PairedPanel | PairingError]:
    """``build_paired_panel`` of every group, by one job for all; the panels' rows are those of all groups together."""
    if len(set(policies)) < 2:
        raise PairingError("a comparison needs two policies")
    rows = panel.where(F.col("policy_id").isin(list(policies)) & finite(F.col("value")).isNotNull())
    arms = rows.groupBy(key, "unit").agg(F.collect_set("policy_id").alias("arms"))
    every = F.size("arms") == len(set(policies))
    facts = arms.groupBy(key).agg(F.count("*").alias("all"), F.count_if(every).alias("shared"), *(F.count_if(~F.array_contains("arms", p)).alias(f"without_{k}") for k, p in enumerate(policies)))
    if require_common_units:
        rows = rows.join(arms.where(every).select(key, "unit"), [key, "unit"], "left_semi")
    out: dict[str, PairedPanel | PairingError] = {}
    for f in facts.collect():  # a row for each group
        lost = [p for k, p in enumerate(policies) if f["all"] == f[f"without_{k}"]]
        if lost:
            out[f[key]] = PairingError(f"policy {lost[0]} has no finite value")
        elif require_common_units and not f["shared"]:
            out[f[key]] = PairingError("the policies share no unit")
        else:
            kept = f["shared"] if require_common_units else f["all"]
            out[f[key]] = PairedPanel(rows, tuple(policies), require_common_units or f["shared"] == f["all"], kept, f["shared"], f["all"], {p: f[f"without_{k}"] for k, p in enumerate(policies)})
    return out


def single_policy_values(panel: DataFrame, policy: str) -> DataFrame:
    """Finite rows of one policy."""
    return panel.where((F.col("policy_id") == policy) & finite(F.col("value")).isNotNull())


def per_unit_statistics(panel: DataFrame, estimator: str = "mean", **params: object) -> DataFrame:
    """Estimator per unit and policy."""
    return estimate_by(panel, ["unit", "policy_id"], "value", estimator, **params)


per_cluster_statistics = per_unit_statistics


def imbalance(panel: DataFrame, policies: Sequence[str], threshold: float = 0.2, keys: Sequence[str] = ()) -> DataFrame:
    """Per unit the least and largest number of values of a policy, their relative gap and whether it exceeds the threshold."""
    counts = panel.groupBy(*keys, "unit").agg(*(F.count_if(F.col("policy_id") == p).alias(f"n{k}") for k, p in enumerate(policies)))
    columns = [F.col(f"n{k}") for k in range(len(policies))]
    counts = counts.select(*keys, "unit", F.least(*columns).alias("low"), F.greatest(*columns).alias("high"))
    gap = (F.col("high") - F.col("low")) / F.col("high")
    return counts.where("high > 0").select(*keys, "unit", "low", "high", gap.alias("gap"), (gap > threshold).alias("flagged"))


def imbalance_reports(panel: DataFrame, policies: Sequence[str], key: str, threshold: float = 0.2) -> dict[str, dict[str, object]]:
    """By group: the largest gap, how many units exceed the threshold, and the first of them."""
    found = imbalance(panel, policies, threshold, [key])
    place = F.row_number().over(Window.partitionBy(key).orderBy("unit"))
    named = found.where("flagged").withColumn("place", place).where(F.col("place") <= NAMED_UNITS).groupBy(key).agg(F.sort_array(F.collect_list("unit")).alias("units"))
    tops = found.groupBy(key).agg(F.max("gap").alias("max"), F.count_if("flagged").alias("n_flagged"))
    rows = tops.join(named, key, "left").collect()  # a row for each group
    return {r[key]: {"threshold": threshold, "max": r["max"] or 0.0, "n_flagged": r["n_flagged"], "units": list(r["units"] or [])} for r in rows}


def imbalance_report(panel: DataFrame, policies: Sequence[str], threshold: float = 0.2) -> dict[str, object]:
    found = imbalance_reports(panel.withColumn("__all", F.lit("all")), policies, "__all", threshold)
    return found.get("all", {"threshold": threshold, "max": 0.0, "n_flagged": 0, "units": []})


def overlap(panel: DataFrame, policies: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per policy (of each group by keys), whether the shared units look like its others: standardised shift of the unit means."""
    own = panel.where(F.col("policy_id").isin(list(policies)) & finite(F.col("value")).isNotNull())
    means = own.groupBy(*keys, "policy_id", "unit").agg(F.avg("value").alias("m"))
    every = means.groupBy(*keys, "unit").agg(F.count("*").alias("arms")).where(F.col("arms") == len(set(policies)))
    marked = means.join(every.select(*keys, "unit", F.lit(True).alias("shared")), [*keys, "unit"], "left")
    inside, outside = F.when(F.col("shared"), F.col("m")), F.when(F.col("shared").isNull(), F.col("m"))
    facts = marked.groupBy(*keys, "policy_id").agg(F.count(inside).alias("n_shared"), F.count(outside).alias("n_other"), F.avg(inside).alias("mean_shared"), F.avg(outside).alias("mean_other"), F.var_samp(inside).alias("v_in"), F.var_samp(outside).alias("v_out"))
    spread = F.sqrt((F.col("v_in") + F.col("v_out")) / 2)
    enough = (F.col("n_shared") >= 2) & (F.col("n_other") >= 2) & (spread > 0)
    shift = F.when(enough, F.try_divide(F.col("mean_other") - F.col("mean_shared"), spread))
    return facts.select(*keys, "policy_id", "n_shared", "n_other", "mean_shared", "mean_other", shift.alias("shift"), (F.abs(shift) > TYPICAL).alias("flagged"))


overlap_representativeness = overlap


def chosen_policies(have: Sequence[str], baseline: str | None, candidates: Sequence[str] = ()) -> tuple[str, list[str]]:
    """Baseline (default: first by name) and candidates (default: all others) among the policies there are."""
    have = sorted(have)
    unknown = [p for p in ([baseline] if baseline else []) + list(candidates) if p not in have]
    if unknown:
        raise PairingError(f"policy not in the records: {', '.join(unknown)}; there are {', '.join(have)}")
    if len(have) < 2:
        raise PairingError("the records have fewer than two policies")
    base = baseline or have[0]
    return base, list(candidates) or [p for p in have if p != base]


def resolve_policies(records: DataFrame, baseline: str | None, candidates: Sequence[str] = ()) -> tuple[str, list[str]]:
    """``chosen_policies`` of the records."""
    return chosen_policies([r[0] for r in records.select("policy_id").where("policy_id is not null").distinct().collect()], baseline, candidates)
