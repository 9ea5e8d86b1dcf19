"""From raw records to analysable rows: filters, run status, missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stratafold.config import DEFAULT_HANDLING, FilterSpec, MissingDataSpec
from stratafold.jobs import together
from stratafold.functions.estimators import finite

UNSPECIFIED = "unspecified"
#: Excluded units that a log names at most.
NAMED_UNITS = 20


@dataclass
class PreparationLog:
    """What the preparation removed and why."""

    steps: list[dict[str, Any]] = field(default_factory=list)
    counters: dict[str, int] = field(default_factory=dict)
    excluded_units: list[str] = field(default_factory=list)
    unknown_statuses: list[str] = field(default_factory=list)
    missing_by_policy: dict[str, int] = field(default_factory=dict)


def _as_text(df: DataFrame, column: str) -> Column:
    """The column as a string; no cast where it is one, so that a filter still reaches the scan."""
    return F.col(column) if isinstance(df.schema[column].dataType, StringType) else F.col(column).cast("string")


def _conditions(df: DataFrame, spec: FilterSpec) -> list[tuple[str, Column]]:
    """Named conditions under which a row stays, in order."""
    unknown = [c for c in (*spec.include, *spec.exclude) if c not in df.columns]
    if unknown:
        raise KeyError(f"filter column(s) not in the records: {', '.join(unknown)}")
    found = [(f"include {c}", F.coalesce(_as_text(df, c).isin(list(values)), F.lit(False))) for c, values in spec.include.items()]
    found += [(f"exclude {c}", ~F.coalesce(_as_text(df, c).isin(list(values)), F.lit(False))) for c, values in spec.exclude.items()]
    found += [(name, ~F.coalesce(F.expr(text), F.lit(False))) for name, text in spec.exclusions.items()]
    return found


def filtered(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """Rows that pass all filters; a null never matches a value list."""
    for _, stays in _conditions(df, spec):
        df = df.where(stays)
    return df


def filter_log(df: DataFrame, spec: FilterSpec, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per filter step (of each group by keys): step (from 1), filter, rows and units before and after.

    One pass over the rows finds the first step that each fails; one aggregate by unit
    finds the last step that each survives.
    """
    named = _conditions(df, spec)
    fails = F.lit(len(named) + 1)
    for k in range(len(named), 0, -1):
        fails = F.when(~named[k - 1][1], F.lit(k)).otherwise(fails)
    marked = df.select(*keys, F.col(unit).alias("unit"), fails.alias("fails"))
    by_unit = marked.groupBy(*keys, "unit").agg(F.max("fails").alias("last"), *(F.count_if(F.col("fails") > k).alias(f"r{k}") for k in range(len(named) + 1)))
    totals = by_unit.groupBy(*keys).agg(*(F.coalesce(F.sum(f"r{k}"), F.lit(0)).alias(f"r{k}") for k in range(len(named) + 1)), *(F.count_if((F.col("last") > k) & F.col("unit").isNotNull()).alias(f"u{k}") for k in range(len(named) + 1)))
    rows = [F.struct(F.lit(k + 1).alias("step"), F.lit(named[k][0]).alias("filter"), F.col(f"r{k}").alias("rows_before"), F.col(f"r{k + 1}").alias("rows_after"), F.col(f"u{k}").alias("units_before"), F.col(f"u{k + 1}").alias("units_after")) for k in range(len(named))]
    empty = "array<struct<step:int,filter:string,rows_before:bigint,rows_after:bigint,units_before:bigint,units_after:bigint>>"
    return totals.select(*keys, F.inline(F.array(*rows).cast(empty) if rows else F.array().cast(empty)))


def apply_filters(df: DataFrame, spec: FilterSpec, unit: str) -> tuple[DataFrame, PreparationLog]:
    log = PreparationLog([r.asDict() for r in filter_log(df, spec, unit).orderBy("step").collect()])
    return filtered(df, spec), log


def _lookup(mapping: Mapping[str, str], key: Column) -> Column:
    if not mapping:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for item in sorted(mapping.items()) for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def handling_of(spec: MissingDataSpec) -> Column:
    """Handling of a row by its status: declared, else the default, else missing."""
    status = F.coalesce(F.col(spec.status_column), F.lit(UNSPECIFIED))
    return F.coalesce(_lookup(spec.status_handling, status), _lookup(DEFAULT_HANDLING, status), F.lit("missing"))


def run_status_ledger(df: DataFrame, spec: MissingDataSpec, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and units per policy and status, with the handling, before anything is dropped."""
    status = F.coalesce(F.col(spec.status_column), F.lit(UNSPECIFIED)).alias("status")
    return df.select(*keys, "policy_id", status, handling_of(spec).alias("handling"), F.col(unit).alias("unit")).groupBy(*keys, "policy_id", "status", "handling").agg(F.count("*").alias("rows"), F.countDistinct("unit").alias("units"))


def with_status(df: DataFrame, spec: MissingDataSpec, success: str = "mission_success", reason: str = "failure_reason") -> DataFrame:
    """Rows after run-status handling.

    Documented exclusions go.  A run handled as a failure has no success and, if it gives
    no reason, the reason ``run_<status>``; other outcomes stay as they are.
    """
    if spec.status_column not in df.columns:
        return df
    handled = df.withColumn("__handling", handling_of(spec)).where("__handling != 'excluded_documented'")
    failed = F.col("__handling") == "failure"
    if success in df.columns:
        handled = handled.withColumn(success, F.when(failed, F.lit(0.0)).otherwise(F.col(success)))
    if reason in df.columns:
        blank = F.coalesce(F.length(F.trim(reason)) == 0, F.lit(True))
        named = F.concat(F.lit("run_"), F.coalesce(F.col(spec.status_column), F.lit(UNSPECIFIED)))
        handled = handled.withColumn(reason, F.when(failed & blank, named).otherwise(F.col(reason)))
    return handled.drop("__handling")


def status_counts(df: DataFrame, spec: MissingDataSpec, keys: Sequence[str] = ()) -> DataFrame:
    """One row (of each group by keys): n_completed, n_failure, n_missing, n_excluded."""
    h = df.select(*keys, handling_of(spec).alias("h"))
    return h.groupBy(*keys).agg(*(F.count_if(F.col("h") == kind).alias(f"n_{name}") for kind, name in (("completed", "completed"), ("failure", "failure"), ("missing", "missing"), ("excluded_documented", "excluded"))))


def _first_of(named: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """At most ``NAMED_UNITS`` of the distinct values of each group, in order."""
    place = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(column))
    return named.select(*keys, column).distinct().withColumn("place", place).where(F.col("place") <= NAMED_UNITS)


def status_logs(df: DataFrame, spec: MissingDataSpec, unit: str, key: str) -> dict[str, dict[str, Any]]:
    """What ``apply_run_status`` logs of each group, in as many jobs as for one."""
    if spec.status_column not in df.columns:
        return {}
    gone = df.where(handling_of(spec) == "excluded_documented").select(key, F.col(unit).cast("string").alias("u"))
    known = [*DEFAULT_HANDLING, *spec.status_handling]
    strange = df.where(F.col(spec.status_column).isNotNull() & ~F.col(spec.status_column).isin(known)).select(key, F.col(spec.status_column).alias("u"))
    counts, excluded, unknown = together(
        lambda: status_counts(df, spec, [key]).collect(), lambda: _first_of(gone, "u", [key]).orderBy("place").collect(), lambda: _first_of(strange, "u", [key]).orderBy("place").collect()
    )
    out = {r[key]: {"counters": {k: v for k, v in r.asDict().items() if k != key}, "excluded_units": [], "unknown_statuses": []} for r in counts}
    for name, rows in (("excluded_units", excluded), ("unknown_statuses", unknown)):
        for r in rows:
            out[r[key]][name].append(r["u"])
    return out


def apply_run_status(df: DataFrame, spec: MissingDataSpec, unit: str, log: PreparationLog | None = None) -> tuple[DataFrame, PreparationLog]:
    log = log or PreparationLog()
    if spec.status_column not in df.columns:
        return df, log
    found = status_logs(df.withColumn("__all", F.lit("all")), spec, unit, "__all").get("all")
    if found is None:
        found = {"counters": status_counts(df, spec).first().asDict(), "excluded_units": [], "unknown_statuses": []}
    log.counters |= found["counters"]
    log.excluded_units, log.unknown_statuses = found["excluded_units"], found["unknown_statuses"]
    return with_status(df, spec), log


def missing_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Non-finite values of a column per policy (of each group by keys)."""
    return df.groupBy(*keys, "policy_id").agg(F.count_if(finite(F.col(value)).isNull()).alias("missing"), F.count("*").alias("rows"))


class MissingValues(ValueError):
    """Values are missing and the policy is to fail."""


def with_missing_policy(df: DataFrame, value: str, policy: str, lower_is_better: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Rows after the missing-value policy; NaN and infinite values count as missing.

    Imputation takes the worst (best) value observed under any policy, in the group if there are keys (never null).
    """
    clean = df.withColumn(value, finite(F.col(value)))
    if policy == "drop_record":
        return clean.where(F.col(value).isNotNull())
    if policy == "fail":
        n = clean.where(F.col(value).isNull()).count()
        if n:
            raise MissingValues(f"{n} row(s) have no finite {value}")
        return clean
    highest = lower_is_better == (policy == "impute_worst")
    extreme = clean.groupBy(*keys).agg((F.max if highest else F.min)(value).alias("__extreme"))
    if keys:
        return clean.join(extreme, list(keys)).withColumn(value, F.coalesce(value, "__extreme")).select(df.columns)
    return clean.crossJoin(F.broadcast(extreme)).withColumn(value, F.coalesce(value, "__extreme")).drop("__extreme")


def apply_missing_policy(df: DataFrame, value: str, spec: MissingDataSpec, lower_is_better: bool, log: PreparationLog | None = None) -> tuple[DataFrame, PreparationLog]:
    log = log or PreparationLog()
    log.missing_by_policy = {r["policy_id"]: r["missing"] for r in missing_counts(df, value).collect()}
    return with_missing_policy(df, value, spec.policy, lower_is_better), log
