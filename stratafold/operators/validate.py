"""Checks of a record table.  All column checks are one aggregate; keys and nesting are one each."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from stratafold.config import DEFAULT_HANDLING, AnalysisConfig
from stratafold.hierarchy import DEFAULT_ORDER, InferenceSpec, check_structure, infer_default
from stratafold.issues import ValidationReport
from stratafold.operators.strata import stratum_issues
from stratafold.schema import BY_NAME, CORE_COLUMNS, NUMERIC_COLUMNS, REQUIRED_COLUMNS, WEIGHT_LIKE_COLUMNS

FEW_UNITS = 20


def column_facts(records: DataFrame, columns: Sequence[str] = CORE_COLUMNS) -> DataFrame:
    """One row per known column: rows, nulls, infinities, values that are neither 0 nor 1, least and largest finite value."""
    have = [c for c in columns if c in records.columns]
    numeric = {c for c in have if isinstance(records.schema[c].dataType, NumericType)}
    parts = [F.count("*").alias("rows")]
    for k, c in enumerate(have):
        v = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        nothing = F.col(c).isNull() | (F.isnan(v) if c in numeric else F.lit(False))
        fine = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        parts += [F.count_if(nothing).alias(f"z{k}"), F.count_if(F.abs(v) == float("inf")).alias(f"i{k}"), F.count_if(fine.isNotNull() & ~fine.isin(0.0, 1.0)).alias(f"b{k}"), F.min(fine).alias(f"lo{k}"), F.max(fine).alias(f"hi{k}")]
    wide = records.agg(*parts)
    rows = [F.struct(F.lit(c).alias("column"), F.col("rows"), *(F.col(f"{p}{k}").alias(n) for p, n in (("z", "nulls"), ("i", "infinite"), ("b", "non_binary"), ("lo", "least"), ("hi", "largest")))) for k, c in enumerate(have)]
    return wide.select(F.inline(F.array(*rows)))


def duplicates(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return records.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def broken_nesting(records: DataFrame, finer: str, coarser: str) -> DataFrame:
    """Identifiers of a finer level that occur under several of the coarser one."""
    return records.where(F.col(finer).isNotNull()).groupBy(finer).agg(F.countDistinct(coarser).alias("n")).where("n > 1")


def policy_coverage(records: DataFrame, unit: str) -> DataFrame:
    """One row: units, units with every policy, policies."""
    pairs = records.select(F.col(unit).alias("unit"), "policy_id").where("unit is not null and policy_id is not null").distinct()
    n = pairs.select(F.countDistinct("policy_id").alias("policies"))
    per = pairs.groupBy("unit").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n))
    return per.agg(F.count("*").alias("units"), F.count_if(F.col("k") == F.col("policies")).alias("common"), F.max("policies").alias("policies"))


def validate_records(records: DataFrame, spec: InferenceSpec | None = None, strata: Sequence[str] = ()) -> ValidationReport:
    """All findings that need no configuration beyond the structure."""
    report = ValidationReport()
    add = report.add
    missing = [c for c in REQUIRED_COLUMNS if c not in records.columns]
    if missing:
        add("error", "missing_required_columns", f"not in the records: {', '.join(missing)}")
        return report
    facts = {r["column"]: r for r in column_facts(records).collect()}
    report.n_rows = n = facts[REQUIRED_COLUMNS[0]]["rows"]
    if not n:
        add("error", "empty_table", "the records have no rows")
        return report
    spec = spec or infer_default(records)
    extra = [c for c in records.columns if c not in CORE_COLUMNS]
    if extra:
        add("info", "extra_columns", f"carried through: {', '.join(extra)}")
    absent = [c for c in CORE_COLUMNS if c not in records.columns]
    if absent:
        add("info", "absent_optional_columns", f"not in the records: {', '.join(absent)}")
    for c in sorted(WEIGHT_LIKE_COLUMNS.intersection(records.columns)):
        add("warning", "weight_column_ignored", f"{c} looks like a weight; weights are not applied", c)
    for c in REQUIRED_COLUMNS:
        if facts[c]["nulls"]:
            add("error", "null_key", f"{c} is null in {facts[c]['nulls']} row(s)", c, facts[c]["nulls"])
    again = duplicates(records, REQUIRED_COLUMNS).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    if again:
        add("error", "duplicate_records", f"{again} row(s) repeat the identifiers of another", count=again)
    structure = check_structure(records, spec)
    report.issues += structure
    if spec.levels == DEFAULT_ORDER and "inverted_nesting" not in {i.code for i in structure}:
        for coarser, finer in zip(spec.levels, spec.levels[1:], strict=False):
            k = broken_nesting(records, finer, coarser).count()
            if k:
                add("error", "broken_nesting", f"{k} {finer} value(s) occur under more than one {coarser}", finer, k)
    for c in NUMERIC_COLUMNS:
        if c not in facts:
            continue
        f = facts[c]
        if not isinstance(records.schema[c].dataType, NumericType):
            add("error", "non_numeric_column", f"{c} is not numeric", c)
            continue
        if BY_NAME[c].kind == "boolean" and f["non_binary"]:
            add("error", "non_binary_outcome", f"{c} has {f['non_binary']} value(s) other than 0 and 1", c, f["non_binary"])
        if f["infinite"]:
            add("error", "non_finite_value", f"{c} is infinite in {f['infinite']} row(s)", c, f["infinite"])
        if BY_NAME[c].least is not None and f["least"] is not None and f["least"] < BY_NAME[c].least:
            add("warning", "implausible_value", f"{c} goes down to {f['least']:g}", c)
        if f["nulls"]:
            add("warning", "missing_outcome", f"{c} is missing in {f['nulls']} of {n} row(s)", c, f["nulls"])
    if "run_status" in records.columns:
        by_arm = [r.asDict() for r in records.groupBy("run_status", "policy_id").count().collect()]
        counts, late = Counter(), Counter()
        for r in by_arm:
            counts[r["run_status"]] += r["count"]
            if r["run_status"] != "completed":
                late[r["policy_id"]] += r["count"]
        add("info", "run_status_present", ", ".join(f"{k or 'unspecified'}: {v}" for k, v in sorted(counts.items(), key=lambda x: x[0] or "")))
        strange = sorted(k for k in counts if k is not None and k not in DEFAULT_HANDLING)
        if strange:
            add("warning", "unknown_run_status", f"unknown run status: {', '.join(strange)}", "run_status")
        if late:
            shares = ", ".join(f"{k if k is not None else 'no policy'}: {v}" for k, v in sorted(late.items(), key=lambda x: x[0] or ""))
            add("warning", "incomplete_runs", f"{late.total()} row(s) come from runs that did not complete ({shares})", "run_status", late.total())
    if "failure_reason" in records.columns and "mission_success" in records.columns and isinstance(records.schema["mission_success"].dataType, NumericType):
        given = F.coalesce(F.length(F.trim(F.col("failure_reason").cast("string"))) > 0, F.lit(False))
        f = records.agg(F.count_if((F.col("mission_success") == 0) & ~given).alias("silent"), F.count_if((F.col("mission_success") == 1) & given).alias("odd")).first()
        if f["silent"]:
            add("warning", "failure_without_reason", f"{f['silent']} failure(s) give no reason", "failure_reason", f["silent"])
        if f["odd"]:
            add("warning", "success_with_failure_reason", f"{f['odd']} success(es) give a failure reason", "failure_reason", f["odd"])
    if spec.primary_unit in records.columns:
        report.issues += stratum_issues(records, spec.primary_unit, strata)
        c = policy_coverage(records, spec.primary_unit).first()
        if 2 <= c["units"] < FEW_UNITS:
            add("warning", "few_units", f"{c['units']} units are few", count=c["units"])
        if c["policies"] == 1:
            add("warning", "single_policy", "there is one policy; nothing can be compared")
        add("info", "nesting_ratio", f"{n / max(1, c['units']):.1f} rows in a unit on average; rows are not replicates")
        if c["policies"] and c["policies"] > 1:
            if not c["common"]:
                add("error", "no_common_units", "no unit has every policy")
            elif c["common"] < c["units"]:
                add("warning", "unbalanced_policy_coverage", f"{c['units'] - c['common']} of {c['units']} units lack a policy", count=c["units"] - c["common"])
    return report


def validate_for_config(records: DataFrame, config: AnalysisConfig) -> ValidationReport:
    """Findings for an analysis: the table's, declared strata, bounds, orientation, status."""
    report = validate_records(records, config.inference, config.strata)
    if not report.n_rows:
        return report
    bounded = [m for m in config.metrics if m.column in records.columns and (m.bounds.lower is not None or m.bounds.upper is not None)]
    for m, f in ((m, column_facts(records.select(F.col(m.column).cast(DoubleType()).alias(m.column)), [m.column]).first()) for m in bounded):
        beyond = f["least"] is not None and ((m.bounds.lower is not None and f["least"] < m.bounds.lower) or (m.bounds.upper is not None and f["largest"] > m.bounds.upper))
        if beyond:
            report.add("error", "value_outside_declared_bounds", f"{m.column} goes from {f['least']:g} to {f['largest']:g}, beyond the bounds of {m.name}", m.column)
    for m in config.metrics:
        for text in m.orientation_warnings():
            report.add("warning", "metric_orientation", text, m.column)
        margin = config.margin_for(m)
        if margin is not None and not margin.source:
            report.add("warning", "undocumented_margin", f"the margin of {m.name} names no source", m.column)
    if not any(m.role == "primary" for m in config.metrics):
        report.add("warning", "no_primary_metric", "no metric is primary")
    if config.protocol.analysis_status == "unspecified":
        report.add("info", "analysis_status_unspecified", "say whether the analysis is exploratory or preregistered")
    return report


