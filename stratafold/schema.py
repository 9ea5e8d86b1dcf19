"""Columns of an experiment-record table and what they mean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import DoubleType, StringType, StructField, StructType


@dataclass(frozen=True)
class Column:
    """One known column; ``least`` is the smallest plausible value of a numeric one."""

    name: str
    kind: str
    required: bool = False
    least: float | None = None
    about: str = ""


# Names, kinds and plausible ranges of the record format.
SCHEMA = (
    Column("world_id", "id", True, about="experimental unit; the default unit of inference"),
    Column("event_id", "id", True, about="grouping between the unit and the observation"),
    Column("policy_id", "id", True, about="treatment arm"),
    Column("resident_id", "id", True, about="one nested observation; not a replicate"),
    Column("action", "categorical", about="action taken; descriptive only"),
    Column("mission_success", "boolean", about="binary outcome, 0 or 1"),
    Column("loss", "numeric", least=0.0, about="cost outcome, lower is better by convention"),
    Column("travel_time", "numeric", least=0.0, about="time cost"),
    Column("resource_use", "numeric", least=0.0, about="resources consumed"),
    Column("responder_exposure", "numeric", least=0.0, about="risk borne on this observation"),
    Column("failure_reason", "categorical", about="why the observation failed; null when it did not"),
    Column("stratum", "categorical", about="default stratum of the unit"),
    Column("run_status", "categorical", about="how the run of this row ended"),
)
BY_NAME = {c.name: c for c in SCHEMA}
CORE_COLUMNS = tuple(BY_NAME)
ID_COLUMNS = tuple(c.name for c in SCHEMA if c.kind == "id")
REQUIRED_COLUMNS = tuple(c.name for c in SCHEMA if c.required)
NUMERIC_COLUMNS = tuple(c.name for c in SCHEMA if c.kind in ("numeric", "boolean"))
OUTCOME_COLUMNS = NUMERIC_COLUMNS
#: Keys, outcomes and descriptions of the run are no strata.
NON_STRATUM_COLUMNS = frozenset((*ID_COLUMNS, *OUTCOME_COLUMNS, "failure_reason", "action", "run_status"))
#: Reported and ignored.
WEIGHT_LIKE_COLUMNS = frozenset(("weight", "weights", "unit_weight", "sample_weight", "sampling_weight"))


def spark_type(name: str) -> StringType | DoubleType | None:
    """Type a known column is coerced to; None for columns that are left alone."""
    column = BY_NAME.get(name)
    return None if column is None else DoubleType() if column.kind in ("numeric", "boolean") else StringType()


def record_schema() -> StructType:
    """All known columns as a Spark schema."""
    return StructType([StructField(c.name, spark_type(c.name), not c.required) for c in SCHEMA])


def describe() -> str:
    """The schema as a text table."""
    width = max(map(len, CORE_COLUMNS))
    rows = [f"{c.name:<{width}}  {c.kind:<11}  {'required' if c.required else 'optional'}  {c.about}" for c in SCHEMA]
    return "\n".join([f"{'column':<{width}}  kind         presence  meaning", *rows])
