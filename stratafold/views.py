"""Record views over the driver's tables.  The select lists are plain SQL that any engine reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Runs end in several ways, reasons and outcomes are missing: all by arithmetic on ids.
EVENT_COLUMNS = {
    "world_id": "'u' || CAST(user_id AS STRING)",
    "event_id": "'u' || CAST(user_id AS STRING) || '-' || CAST(event_id % 7 AS STRING)",
    "policy_id": "event_type",
    "resident_id": "'r' || CAST(event_id AS STRING)",
    "run_status": "CASE event_id % 19 WHEN 0 THEN 'crashed' WHEN 1 THEN 'timeout' WHEN 2 THEN 'infeasible' WHEN 3 THEN 'not_evaluated' WHEN 4 THEN NULL ELSE 'completed' END",
    "mission_success": "CASE WHEN event_id % 19 < 4 THEN NULL WHEN value < 60 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "loss": "CASE WHEN event_id % 19 < 4 THEN NULL ELSE value END",
    "travel_time": "CASE WHEN event_id % 19 < 4 THEN NULL ELSE value * 2 + CAST(event_id % 5 AS DOUBLE) END",
    "failure_reason": "CASE WHEN event_id % 19 >= 4 AND value >= 60 THEN CASE event_id % 3 WHEN 0 THEN 'late' WHEN 1 THEN 'lost' ELSE '' END END",
    "stratum": "'s' || CAST(user_id % 4 AS STRING)",
    "regime": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'g' || CAST((user_id + event_id % 2) % 3 AS STRING) END",
}
#: One arm misses a fifth of the units, for the operators whose subject is which units arms share.
EVENT_ROWS = "NOT (event_type = 'purchase' AND user_id % 5 = 0)"
LINE_COLUMNS = {
    "world_id": "'c' || CAST(o_custkey AS STRING)",
    "event_id": "'o' || CAST(o_orderkey AS STRING)",
    "policy_id": "l_linestatus",
    "loss": "l_extendedprice * l_discount",
    "resource_use": "l_quantity",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


RECORDS_SQL = f"records AS (SELECT {_select(EVENT_COLUMNS)} FROM events)"
INCOMPLETE_SQL = f"records AS (SELECT {_select(EVENT_COLUMNS)} FROM events WHERE {EVENT_ROWS})"
LINES_SQL = f"lines AS (SELECT {_select(LINE_COLUMNS)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as experiment records: users as units, event types as policies."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*(f"{e} AS {c}" for c, e in EVENT_COLUMNS.items()))


def incomplete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_records`` in which one arm misses units: for operators that say which units arms share."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(EVENT_ROWS).selectExpr(*(f"{e} AS {c}" for c, e in EVENT_COLUMNS.items()))


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its orders as records without observation ids: customers as units, line status as policy."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linestatus", "l_extendedprice", "l_discount", "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(*(f"{e} AS {c}" for c, e in LINE_COLUMNS.items()))
