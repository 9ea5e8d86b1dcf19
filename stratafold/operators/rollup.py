"""Roll-up of observations through the declared levels, one level at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.config import AggregationSpec
from stratafold.functions.estimators import finite
from stratafold.hierarchy import InferenceSpec, resolve_unit, unit_label
from stratafold.operators.dependencies import distinct_counts
from stratafold.operators.ranks import ranked


def _rule(rule: str, value: str, order: str) -> Column:
    v = F.col(value)
    return {
        "mean": F.avg(v),
        "sum": F.coalesce(F.sum(v), F.lit(0.0)),
        "median": F.percentile(v, 0.5),  # values of one group at one level, not of a whole arm
        "max": F.max(v),
        "any": F.max(v),
        "min": F.min(v),
        "all": F.min(v),
        "first": F.min_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), F.col(order))),
    }[rule]


def aggregate_to_level(df: DataFrame, spec: InferenceSpec, values: Sequence[str], level: str, rules: AggregationSpec = AggregationSpec(), carried: Sequence[str] = ()) -> DataFrame:
    """Values at a level: keys down to it, policy_id, carried columns, values.

    Columns that share a level are rolled up together, one aggregate per step.  ``first``
    takes the value of the least identifier of the finer level.  Null keys form groups.
    """
    level = resolve_unit(level)
    keys = spec.keys_for(spec.finest)
    rows = df.select(*keys, "policy_id", *carried, *(finite(F.col(v)).alias(v) for v in values))
    for finer, coarser in spec.steps():
        if spec.depth(level) >= spec.depth(finer):
            break
        keys = spec.keys_for(coarser)
        rows = rows.groupBy(*keys, "policy_id", *carried).agg(*(_rule(rules.rule(finer, coarser, v), v, finer).alias(v) for v in values))
    return rows


def panel(df: DataFrame, spec: InferenceSpec, value: str, level: str, rules: AggregationSpec = AggregationSpec(), carried: Sequence[str] = ()) -> DataFrame:
    """One metric's values at its level: unit (primary), policy_id, value, the label at the level, carried columns."""
    rolled = aggregate_to_level(df, spec, [value], level, rules, carried)
    below = spec.below_primary()
    sub = F.col(below) if below and below in rolled.columns else F.lit(None)
    return rolled.select(
        F.col(spec.primary_unit).cast("string").alias("unit"), "policy_id", F.col(value).cast("double").alias("value"), sub.cast("string").alias("sub"), unit_label(spec.keys_for(level)).alias("label"), *carried
    )


def nesting_counts(df: DataFrame, spec: InferenceSpec) -> DataFrame:
    """Per unit and policy: distinct identifiers at each nested level and rows."""
    counted = distinct_counts(df.withColumn("unit", F.col(spec.primary_unit)), ["unit", "policy_id"], spec.nested_units or [spec.primary_unit])
    return counted.select("unit", "policy_id", *(F.col(f"n{k}").alias(f"n_{c}") for k, c in enumerate(spec.nested_units)), F.col("rows").alias("n_rows"))


observation_counts = nesting_counts
__all__ = ["aggregate_to_level", "nesting_counts", "observation_counts", "panel", "ranked"]
