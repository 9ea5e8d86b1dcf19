"""Deliberate faults and the checks that must notice them.

Each mutant replaces one function of the engine while a detector runs.  A detector returns
True if the behaviour is right; a mutant counts as found only if the detector says True
without it and False with it.  An exception is an error of the audit, never a detection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.config import MetricSpec, config_from_mapping
from stratafold.functions import decisions, estimators
from stratafold.hierarchy import InferenceSpec
from stratafold.operators import pairing, prepare, resample, rollup, strata
from stratafold.plans import compare
from stratafold.synth.generate import Policy, World, generate_experiment, to_spark


@contextmanager
def replaced(owner: Any, name: str, value: Any) -> Iterator[None]:
    held = getattr(owner, name)
    setattr(owner, name, value)
    try:
        yield
    finally:
        setattr(owner, name, held)


@dataclass(frozen=True)
class Mutant:
    name: str
    owner: Any
    attribute: str
    make: Callable[[Any], Any]
    detect: Callable[[SparkSession], bool]


def _table(spark: SparkSession, **world: Any) -> DataFrame:
    design = {"n_units": 24, "n_events": 3, "n_observations": 8, "interaction_sd": 2.0, **world}
    return to_spark(spark, generate_experiment(World(**design), [Policy("policy_a"), Policy("policy_b", shift=0.8, crash_rate=0.15)], 11))


def _panel(df: DataFrame) -> pairing.PairedPanel:
    rows = rollup.panel(prepare.with_missing_policy(df, "loss", "drop_record"), InferenceSpec(), "loss", "event_id")
    return pairing.build_paired_panel(rows, ["policy_a", "policy_b"])


def _width(df: DataFrame, **options: Any) -> float:
    d = resample.paired_cluster_bootstrap(_panel(df), n_resamples=200, seed=3, **options)["difference"]
    return d.high - d.low


def _unit_level(spark: SparkSession) -> bool:
    """One value per unit and resampling of units: the same interval whether or not events are averaged first."""
    df = _table(spark)
    rows = _panel(df)
    coarse = replace(rows, rows=rows.rows.groupBy("unit", "policy_id").agg(F.avg("value").alias("value")).withColumn("sub", F.lit(None).cast("string")))
    a, b = (resample.paired_cluster_bootstrap(p, n_resamples=200, seed=3)["difference"] for p in (rows, coarse))
    return 0.7 < (a.high - a.low) / (b.high - b.low) < 1.4


def _paired(spark: SparkSession) -> bool:
    return _width(_table(spark, unit_sd=8.0, interaction_sd=0.5)) < 3


def _no_margin(_: SparkSession) -> bool:
    import numpy as np

    try:
        decisions.tost(np.zeros(200), None)
    except decisions.MarginRequired:
        return True
    return False


def _not_equivalent(_: SparkSession) -> bool:
    return decisions.classify_difference(0.1, -2.0, 2.2, MetricSpec("m", "loss"), None)[0] == "inconclusive"


def _orientation(_: SparkSession) -> bool:
    return decisions.classify_difference(-1.0, -2.0, -0.5, MetricSpec("m", "loss"), None)[0] == "superior"


def _tail(spark: SparkSession) -> bool:
    rows = spark.createDataFrame([("a", float(x)) for x in range(1, 11)], "g string, v double")
    return estimators.estimate("cvar", range(1, 11), alpha=0.8, tail="upper") == 9.5 and estimators.estimate_by(rows, ["g"], "v", "cvar", alpha=0.8, tail="upper").first()["estimate"] == 9.5


def _config() -> Any:
    return config_from_mapping({"metrics": [{"name": "loss", "column": "loss", "level": "event_id", "role": "secondary"}, {"name": "time", "column": "travel_time", "level": "event_id", "role": "secondary"}], "bootstrap": {"n_resamples": 100}, "multiplicity": {"secondary_correction": "bonferroni"}})


def _ledger(spark: SparkSession) -> bool:
    return any(r["status"] == "crashed" and r["rows"] for r in compare.compare_policies(_table(spark, n_units=12), _config(), validate=False).ledger)


def _uneven(spark: SparkSession) -> bool:
    rows = spark.createDataFrame([("u1", "a", 1.0)] * 9 + [("u1", "b", 1.0)], "unit string, policy_id string, value double")
    return pairing.imbalance_report(rows, ["a", "b"])["n_flagged"] == 1


def _family(spark: SparkSession) -> bool:
    r = compare.compare_policies(_table(spark, n_units=12), _config(), validate=False)
    return all(c.p_adjusted == min(1.0, 2 * c.difference.p_value) for c in r.comparisons)


def _strata(spark: SparkSession) -> bool:
    return strata.unit_strata(_table(spark, strata=("difficulty",)), "world_id", "difficulty").select("stratum").distinct().count() == 2


def _structure(spark: SparkSession) -> bool:
    try:
        compare.compare_policies(_table(spark, events_span_units=True), _config(), validate=False)
    except ValueError:
        return True
    return False


def _by_rows(original: Callable) -> Callable:
    def run(panel: pairing.PairedPanel, *args: Any, **options: Any) -> Any:
        rows = panel.rows.withColumn("unit", F.concat_ws("-", "unit", "sub"))
        return original(replace(panel, rows=rows, n_units=rows.select("unit").distinct().count()), *args, **options)

    return run


MUTANTS = (
    Mutant("observation_bootstrap", resample, "paired_cluster_bootstrap", _by_rows, _unit_level),
    Mutant("unpaired_analysis_of_paired_data", resample, "paired_cluster_bootstrap", lambda f: lambda *a, **k: f(*a, **{**k, "paired": False}), _paired),
    Mutant("equivalence_without_a_margin", decisions, "tost", lambda f: lambda r, m, alpha=0.05: f(r, m or decisions.Margin(1.0, 1.0), alpha), _no_margin),
    Mutant("p_value_read_as_equivalence", decisions, "classify_difference", lambda f: lambda *a, **k: ("statistically_equivalent", None) if f(*a, **k)[0] == "inconclusive" else f(*a, **k), _not_equivalent),
    Mutant("reversed_metric_orientation", MetricSpec, "better", lambda _: lambda self, d: d > 0 if self.direction == "lower_is_better" else d < 0, _orientation),
    Mutant("cvar_wrong_tail", estimators, "_taken", lambda f: lambda x, w, skip, take: f(-x, w, skip, take) * -1, _tail),
    Mutant("failed_runs_dropped_silently", compare, "run_status_ledger", lambda f: lambda df, *a: f(df.where(F.col(a[0].status_column) == "completed"), *a), _ledger),
    Mutant("uneven_unit_reuse_unreported", pairing, "imbalance", lambda f: lambda *a, **k: f(*a, **k).withColumn("flagged", F.lit(False)), _uneven),
    Mutant("multiplicity_family_ignored", decisions, "adjust", lambda _: lambda p, method: dict(p), _family),
    Mutant("strata_incorrectly_merged", strata, "unit_strata", lambda f: lambda *a: f(*a).withColumn("stratum", F.lit("all")), _strata),
    Mutant("inference_structure_unchecked", compare, "require_valid_structure", lambda _: lambda *a: [], _structure),
)


def audit(spark: SparkSession, names: list[str] | None = None) -> dict[str, bool]:
    """By mutant whether its detector tells right from wrong."""
    found = {}
    for m in MUTANTS:
        if names and m.name not in names:
            continue
        right = m.detect(spark)
        with replaced(m.owner, m.attribute, m.make(getattr(m.owner, m.attribute))):
            wrong = m.detect(spark)
        found[m.name] = right and not wrong
    return found
