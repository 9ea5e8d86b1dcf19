"""Exact ranks within groups without gathering a group in one task.

Rows are range-partitioned by (group, value, tie); each task ranks its own rows and only row
counts per (task, group) are added up.  A group that holds most rows spreads over many
tasks, and so do its equal values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.scratch import materialize


def ranked(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str] = ()) -> DataFrame:
    """df with __rank (1 for the least value of the group) and __n (rows of the group).

    ties: columns that order equal values; without them equal values are ordered arbitrarily.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    order = [*keys, value, *ties, "__tie"]
    placed = materialize(tied.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranks")
    counts = placed.groupBy("__part", *keys).agg(F.count("*").alias("__rows"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"__ahead": F.coalesce(F.sum("__rows").over(before), F.lit(0)), "__n": F.sum("__rows").over(group)})
    rows, facts = placed.alias("r"), counts.drop("__rows").alias("c")
    on: Column = F.col("r.__part") == F.col("c.__part")
    for k in keys:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    local = Window.partitionBy("r.__part", *(f"r.{k}" for k in keys)).orderBy(f"r.{value}", *(f"r.{t}" for t in ties), "r.__tie")
    joined = rows.join(facts, on)
    return joined.select(*(f"r.{c}" for c in df.columns), (F.row_number().over(local) + F.col("__ahead")).alias("__rank"), F.col("__n"))
