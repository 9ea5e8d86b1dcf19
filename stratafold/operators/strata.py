"""Strata of units, how arms are allocated to them, and what they repeat of each other."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.issues import Issue
from stratafold.operators.dependencies import dependencies, distinct_counts
from stratafold.operators.pairing import shared_units
from stratafold.schema import NON_STRATUM_COLUMNS
from stratafold.scratch import materialize

MISSING = "__missing__"
#: Fewer units make a thin cell.
THIN_CELL = 5
#: Allocation gap that is pointed out.
WIDE_GAP = 0.10


def unit_strata(records: DataFrame, unit: str, column: str) -> DataFrame:
    """(unit, stratum): the commonest value of each unit, the smaller of equally common ones; null is a value."""
    counted = records.groupBy(F.col(unit).alias("unit"), F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("stratum")).agg(F.count("*").alias("n"))
    # The least (-n, value) of each unit: combinable, so a unit's rows need not meet.
    return counted.groupBy("unit").agg(F.min(F.struct((-F.col("n")).alias("order"), "stratum"))["stratum"].alias("stratum"))


def allocation(records: DataFrame, unit: str, column: str) -> DataFrame:
    """Units per policy and stratum, and their share of the policy's units."""
    pairs = records.select(F.col(unit).alias("unit"), "policy_id").distinct().join(unit_strata(records, unit, column), "unit", "left")
    counts = pairs.groupBy("policy_id", "stratum").agg(F.count("*").alias("units"))
    return counts.withColumn("share", F.col("units") / F.sum("units").over(Window.partitionBy("policy_id")))


def allocation_balance(records: DataFrame, unit: str, column: str) -> DataFrame:
    """Per stratum the gap between the largest and the smallest share of a policy (0 where it has none)."""
    table = allocation(records, unit, column)
    policies = table.select(F.countDistinct("policy_id").alias("n_policies"))
    by = table.groupBy("stratum").agg(F.max("share").alias("high"), F.min("share").alias("low"), F.count("*").alias("n"))
    low = F.when(F.col("n") == F.col("n_policies"), F.col("low")).otherwise(0.0)
    return by.crossJoin(F.broadcast(policies)).select("stratum", (F.col("high") - low).alias("gap"))


def allocation_ledger(records: DataFrame, unit: str, policies: Sequence[str], nested: Sequence[str] = (), success: str = "mission_success") -> DataFrame:
    """Per policy: units, shared and unique units, rows, distinct nested identifiers, failures."""
    own = records.where(F.col("policy_id").isin(list(policies))).withColumn("unit", F.col(unit))
    marked = own.join(shared_units(own, policies).withColumn("shared", F.lit(True)), "unit", "left")
    failed = {"failures": F.coalesce((F.col(success) == 0).cast("bigint"), F.lit(0))} if success in records.columns else {}
    per = distinct_counts(marked, ["policy_id"], ["unit", *nested], failed, F.coalesce("shared", F.lit(False)))
    names = [F.col(f"n{k + 1}").alias(f"n_{c}") for k, c in enumerate(nested)]
    return per.select("policy_id", F.col("n0").alias("units"), F.col("flagged").alias("shared_units"), "rows", *names, *(F.col(f"f_{n}").alias(n) for n in failed), (F.col("n0") - F.col("flagged")).alias("unshared_units"))


def composition_shift(records: DataFrame, unit: str, column: str, policies: Sequence[str]) -> DataFrame:
    """Per policy and stratum: share among all its units and among the shared ones, and the shift to six places."""
    own = records.where(F.col("policy_id").isin(list(policies))).withColumn("unit", F.col(unit))
    pairs = own.select("unit", "policy_id").distinct().join(unit_strata(records, unit, column), "unit", "left").join(shared_units(own, policies).withColumn("shared", F.lit(True)), "unit", "left")
    counts = pairs.groupBy("policy_id", "stratum").agg(F.count("*").alias("units"), F.count("shared").alias("shared"))
    policy = Window.partitionBy("policy_id")
    every, common = F.col("units") / F.sum("units").over(policy), F.try_divide(F.col("shared").cast("double"), F.sum("shared").over(policy))
    return counts.select("policy_id", "stratum", F.round(every, 6).alias("share_all"), F.round(common, 6).alias("share_shared"), F.round(common - every, 6).alias("shift"))


def unit_table(records: DataFrame, unit: str, columns: Sequence[str]) -> DataFrame:
    """(unit, s0, s1, ..., first_policy, last_policy): ``unit_strata`` of all columns side by side, and the extremes of the unit's policies."""
    values = F.array(*(F.struct(F.lit(k).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("stratum")) for k, c in enumerate(columns)))
    each = records.select(F.col(unit).alias("unit"), "policy_id", F.explode(values).alias("s"))
    counted = each.groupBy("unit", "s.column", "s.stratum").agg(F.count("*").alias("n"), F.min("policy_id").alias("low"), F.max("policy_id").alias("high"))
    order = F.struct((-F.col("n")).alias("order"), "stratum")
    modes = [F.min(F.when(F.col("column") == k, order))["stratum"].alias(f"s{k}") for k in range(len(columns))]
    return counted.groupBy("unit").agg(*modes, F.min("low").alias("first_policy"), F.max("high").alias("last_policy"))


def stratum_redundancy(records: DataFrame, unit: str, columns: Sequence[str]) -> list[Issue]:
    """Strata that say nothing, too little, or the same as another or as the policy: two jobs for any number of columns."""
    have = [c for c in columns if c in records.columns]
    if not have:
        return []
    units = materialize(unit_table(records, unit, have), "unit-strata")
    names = [f"s{k}" for k in range(len(have))]
    known = dependencies(units, names, {"policy": ("first_policy", "last_policy")})
    several = units.agg(F.min("first_policy") != F.max("last_policy")).first()[0]
    issues = []
    for c, s in zip(have, names, strict=True):
        if known[s].values <= 1:
            issues.append(Issue("warning", "single_level_stratum", f"{c} has one level", c))
            continue
        if known[s].least < THIN_CELL:
            issues.append(Issue("warning", "thin_stratum_cell", f"{c} has a level with {known[s].least} unit(s)", c, known[s].least))
        if several and known[s].by["policy"]:
            issues.append(Issue("warning", "stratum_confounded_with_policy", f"each level of {c} has one policy only", c))
    for (a, x), (b, y) in combinations(zip(have, names, strict=True), 2):
        ab, ba = known[x].by[y], known[y].by[x]
        if ab and ba:
            issues.append(Issue("warning", "identical_strata", f"{a} and {b} split the units alike", a))
        elif ab or ba:
            issues.append(Issue("warning", "nested_strata", f"{a if ab else b} is nested in {b if ab else a}", a))
    return issues


def stratum_issues(records: DataFrame, unit: str, columns: Sequence[str]) -> list[Issue]:
    """Issues of declared strata: kind, presence, constancy within units, nulls, redundancy."""
    issues = []
    usable = []
    for c in columns:
        if c in NON_STRATUM_COLUMNS:
            issues.append(Issue("error", "outcome_used_as_stratum", f"{c} is a key, an outcome or a description of the run", c))
        elif c not in records.columns:
            issues.append(Issue("error", "missing_stratum_column", f"{c} is not in the records", c))
        else:
            usable.append(c)
    if usable:
        value = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in usable}
        per = records.groupBy(unit).agg(*((F.min(v) != F.max(v)).alias(f"v{k}") for k, v in enumerate(value.values())), *(F.count_if(F.col(c).isNull()).alias(f"z{k}") for k, c in enumerate(usable)))
        facts = per.agg(*(F.count_if(f"v{k}").alias(f"v{k}") for k in range(len(usable))), *(F.sum(f"z{k}").alias(f"z{k}") for k in range(len(usable)))).first()
        for k, c in enumerate(usable):
            if facts[f"v{k}"]:
                issues.append(Issue("warning", "stratum_varies_within_unit", f"{c} varies within {facts[f'v{k}']} unit(s); each unit gets its commonest value", c, facts[f"v{k}"]))
            if facts[f"z{k}"]:
                issues.append(Issue("warning", "null_stratum", f"{c} is null in {facts[f'z{k}']} row(s)", c, facts[f"z{k}"]))
        issues += stratum_redundancy(records, unit, usable)
    return issues
