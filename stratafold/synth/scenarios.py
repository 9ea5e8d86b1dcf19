"""Sixteen designs on which a careless analysis goes wrong, and what this engine does about it.

Each scenario returns two truth values: the trap fires (the careless analysis misleads) and
the defence holds (the engine's analysis does not), with the figures behind them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.config import AnalysisConfig, ConfigError, Margin, config_from_mapping
from stratafold.functions import decisions, estimators, intervals
from stratafold.operators import pairing, prepare, resample, rollup, strata
from stratafold.plans.compare import compare_policies
from stratafold.scratch import materialize
from stratafold.synth.generate import Policy, World, drop_records, generate_experiment, hardest_units, mark_status, to_spark

SEED = 20260919
A, B = Policy("policy_a"), Policy("policy_b")


@dataclass
class Outcome:
    trap: bool
    defence: bool
    facts: dict[str, Any] = field(default_factory=dict)


SCENARIOS: dict[str, Callable[[SparkSession, int], Outcome]] = {}


def scenario(f: Callable[[SparkSession, int], Outcome]) -> Callable[[SparkSession, int], Outcome]:
    SCENARIOS[f.__name__] = f
    return f


def _config(n: int = 400, **blocks: Any) -> AnalysisConfig:
    base = {
        "metrics": [{"name": "mean_loss", "column": "loss", "level": "event_id", "role": "primary"}],
        "comparison": {"baseline": "policy_a", "candidates": ["policy_b"]},
        "bootstrap": {"n_resamples": n, "seed": 7},
    }
    return config_from_mapping({**base, **blocks})


def _panel(df: DataFrame, config: AnalysisConfig, level: str = "event_id") -> DataFrame:
    clean = prepare.with_missing_policy(df, "loss", "drop_record")
    return rollup.panel(clean, config.inference, "loss", level, config.aggregation)


def _difference(df: DataFrame, config: AnalysisConfig, **options: Any) -> resample.BootstrapResult:
    own = pairing.build_paired_panel(_panel(df, config), ["policy_a", "policy_b"], options.pop("common", True))
    return resample.paired_cluster_bootstrap(own, n_resamples=config.bootstrap.n_resamples, seed=7, **options)["difference"]


def coverage_study(spark: SparkSession, world: World, policies: tuple[Policy, Policy], truth: float, replications: int, seed: int, cluster: str = "world_id", resamples: int = 200) -> decisions.CoverageEstimate:
    """How often the percentile interval of the engine's bootstrap holds the truth.

    All replications are one table of units: a replication's draws stay within its own units.
    cluster: ``world_id`` draws paired units, ``row`` draws the rows of each policy on their own.
    """
    names, alone = tuple(p.name for p in policies), cluster == "row"

    def made(key: pd.DataFrame) -> pd.DataFrame:
        r = int(key["r"].iloc[0])
        table = generate_experiment(world, policies, seed + 7919 * r)
        unit = table.groupby("policy_id").cumcount().map("{:09d}".format) if alone else table[cluster]
        return pd.DataFrame({"r": r, "unit": unit, "policy_id": table["policy_id"], "value": table["loss"]})

    numbers = spark.range(replications).withColumnRenamed("id", "r").repartition(min(replications, 32), "r")
    rows = materialize(numbers.groupBy("r").applyInPandas(made, "r bigint, unit string, policy_id string, value double"), "coverage-rows")
    streams = (resample.BASE, resample.CANDIDATE) if alone else (resample.BASE,)
    leaves = resample.wide(rows, names, keys=["r"])
    made = resample.algebraic_replicates(leaves, names, "mean", seed, resamples, streams, ["r"], apart=True).where(F.col("b") >= 0)
    ends = made.groupBy("r").agg(F.percentile(F.col("e1") - F.col("e0"), F.array(F.lit(0.025), F.lit(0.975))).alias("ends"))
    hits, n = ends.agg(F.count_if((F.col("ends")[0] <= truth) & (F.col("ends")[1] >= truth)), F.count("*")).first()
    return decisions.CoverageEstimate(hits, n)


@scenario
def observation_bootstrap_false_precision(spark: SparkSession, seed: int) -> Outcome:
    table = generate_experiment(World(20, 3, 20, interaction_sd=2.0), [A, replace(B, shift=0.6)], seed)
    config = _config()
    df = to_spark(spark, table)
    unit = _difference(df, config)
    # Pairs are kept; only the level of resampling is wrong.
    gap = table.pivot_table(index=["world_id", "event_id", "resident_id"], columns="policy_id", values="loss")
    gap = (gap["policy_b"] - gap["policy_a"]).to_numpy()
    rng = np.random.default_rng(seed)
    low, high = intervals.percentile(gap[rng.integers(0, len(gap), (400, len(gap)))].mean(axis=1), 0.95)
    return Outcome(high - low < 0.6 * (unit.high - unit.low), unit.low <= 0.6 <= unit.high, {"naive_width": high - low, "unit_width": unit.high - unit.low})


@scenario
def unit_bootstrap_calibration(spark: SparkSession, seed: int) -> Outcome:
    few = coverage_study(spark, World(20, 3, 10, interaction_sd=2.0), (A, replace(B, shift=0.6)), 0.6, 150, seed)
    many = coverage_study(spark, World(60, 3, 10, interaction_sd=2.0), (A, replace(B, shift=0.6)), 0.6, 150, seed)
    naive = coverage_study(spark, World(20, 3, 10, interaction_sd=2.0), (A, replace(B, shift=0.6)), 0.6, 150, seed, cluster="row", resamples=60)
    return Outcome(naive.interval[1] < 0.95, many.consistent and few.rate > naive.rate, {"units_20": few.rate, "units_60": many.rate, "rows": naive.rate})


@scenario
def tail_risk_disagreement(spark: SparkSession, seed: int) -> Outcome:
    table = generate_experiment(World(40, 4, 15), [replace(A, catastrophe_rate=0.04, catastrophe_size=40.0), replace(B, shift=1.9)], seed)
    config = _config(metrics=[{"name": "median_loss", "column": "loss", "estimator": "median", "role": "primary"}, {"name": "cvar95_loss", "column": "loss", "estimator": "cvar", "params": {"alpha": 0.95}}])
    r = compare_policies(to_spark(spark, table), config, validate=False)
    centre, tail = (next(c for c in r.comparisons if c.metric.name == n) for n in ("median_loss", "cvar95_loss"))
    return Outcome(centre.favours == "policy_a" and tail.favours == "policy_b", any(d["kind"] == "central_vs_tail" for d in r.disagreements), {"median": centre.difference.estimate, "cvar95": tail.difference.estimate})


@scenario
def practical_equivalence(spark: SparkSession, seed: int) -> Outcome:
    df = to_spark(spark, generate_experiment(World(120, 3, 12, interaction_sd=0.4), [A, replace(B, shift=0.15)], seed))
    d = _difference(df, _config())
    wide, tight = (decisions.tost(d.replicates, Margin(m, m)) for m in (0.6, 0.05))
    try:
        decisions.tost(d.replicates, None)
        refused = False
    except decisions.MarginRequired:
        refused = True
    return Outcome(tight.conclusion != "equivalent", wide.conclusion == "equivalent" and refused, {"difference": d.estimate})


@scenario
def missing_units_reverse_ranking(spark: SparkSession, seed: int) -> Outcome:
    table = generate_experiment(World(60, 2, 10, unit_sd=5.0), [A, replace(B, shift=1.2)], seed)
    table = drop_records(table, "policy_b", hardest_units(table, 22))
    means = table.groupby("policy_id")["loss"].mean()
    paired = _difference(to_spark(spark, table), _config())
    return Outcome(means["policy_b"] < means["policy_a"], paired.estimate > 0, {"unpaired": means["policy_b"] - means["policy_a"], "paired": paired.estimate})


@scenario
def easier_units_confound(spark: SparkSession, seed: int) -> Outcome:
    table = generate_experiment(World(48, 2, 10, strata=("difficulty",), stratum_effects={"difficulty": 6.0}), [A, B], seed)
    hard = table[table["difficulty"] == "hard"]["world_id"].unique()
    table = drop_records(table, "policy_b", list(hard[: len(hard) * 3 // 4]))
    df = to_spark(spark, table)
    means = table.groupby("policy_id")["loss"].mean()
    paired = _difference(df, _config())
    gap = strata.allocation_balance(df, "world_id", "difficulty").agg(F.max("gap")).first()[0]
    return Outcome(means["policy_b"] < means["policy_a"] - 1, gap > 0.1 and not paired.excludes_zero, {"unpaired": means["policy_b"] - means["policy_a"], "paired": paired.estimate, "gap": gap})


@scenario
def dependence_above_declared_unit(spark: SparkSession, seed: int) -> Outcome:
    from stratafold.hierarchy import check_structure

    df = to_spark(spark, generate_experiment(World(30, 8, 6, shared_shock_sd=3.0, events_span_units=True), [A, B], seed)).withColumn("site_id", F.concat(F.lit("s"), F.substring("world_id", 2, 3)))
    wrong = check_structure(df, _config().inference)
    return Outcome({"crossed_levels", "inverted_nesting"} & {i.code for i in wrong} != set(), "undeclared_coarser_grouping" in {i.code for i in wrong}, {"codes": [i.code for i in wrong]})


@scenario
def outcome_dependent_missingness(spark: SparkSession, seed: int) -> Outcome:
    table = generate_experiment(World(40, 3, 12), [A, replace(B, shift=0.8)], seed)
    lost = (table["policy_id"] == "policy_b") & (table["loss"] > table["loss"].quantile(0.7))
    table.loc[lost, "loss"] = None
    df, config = to_spark(spark, table), _config()
    dropped = _difference(df, config)
    filled = prepare.with_missing_policy(df, "loss", "impute_worst")
    worst = _difference(filled, config)
    counts = {r["policy_id"]: r["missing"] for r in prepare.missing_counts(df, "loss").collect()}
    return Outcome(dropped.estimate < 0.2, worst.estimate > dropped.estimate and counts["policy_b"] > counts["policy_a"], {"dropped": dropped.estimate, "worst_case": worst.estimate, "missing": counts})


@scenario
def too_few_units(spark: SparkSession, seed: int) -> Outcome:
    df = to_spark(spark, generate_experiment(World(4, 5, 60), [A, replace(B, shift=0.5)], seed))
    d = _difference(df, _config())
    return Outcome(df.count() > 1000, any("few" in n for n in d.notes) and not estimators.credibility("mean", 4)[0], {"notes": d.notes})


@scenario
def wrong_cvar_tail(spark: SparkSession, seed: int) -> Outcome:
    table = generate_experiment(World(40, 3, 12), [A, replace(B, catastrophe_rate=0.05, catastrophe_size=30.0)], seed)
    asked = {s: [estimators.estimate("cvar", table[table["policy_id"] == p]["loss"], alpha=0.9, tail=s) for p in ("policy_a", "policy_b")] for s in ("upper", "lower")}
    side = _config(metrics=[{"name": "c", "column": "loss", "estimator": "cvar"}]).metrics[0].parameters["tail"]
    try:
        _config(metrics=[{"name": "c", "column": "loss", "estimator": "cvar", "tail": "upper", "params": {"tail": "lower"}}])
        refused = False
    except ConfigError:
        refused = True
    return Outcome(abs(asked["lower"][1] - asked["lower"][0]) < 1.5 < asked["upper"][1] - asked["upper"][0], side == "upper" and refused, asked)


@scenario
def asymmetric_margin(spark: SparkSession, seed: int) -> Outcome:
    df = to_spark(spark, generate_experiment(World(120, 4, 12, interaction_sd=0.5), [A, replace(B, shift=0.7)], seed))
    d = _difference(df, _config())
    wide, real = decisions.tost(d.replicates, Margin(1.5, 1.5)), decisions.tost(d.replicates, Margin(1.5, 0.3))
    return Outcome(wide.conclusion == "equivalent", real.conclusion != "equivalent", {"symmetric": wide.conclusion, "asymmetric": real.conclusion})


@scenario
def bounded_outcome_interval(spark: SparkSession, seed: int) -> Outcome:
    rng = np.random.default_rng(seed)
    values = (rng.random((12, 10)) < 0.97).mean(axis=1)
    draws = values[rng.integers(0, 12, (400, 12))].mean(axis=1)
    low, high = intervals.basic(float(values.mean()), draws, 0.95)
    plain = intervals.percentile(draws, 0.95)
    skewed = float(values.mean()) + 0.03, high + 0.03
    return Outcome(bool(intervals.outside(low, max(high, skewed[1]), (0.0, 1.0))) or high > plain[1], not intervals.outside(*plain, (0.0, 1.0)), {"basic": [low, high], "percentile": list(plain)})


@scenario
def uncorrected_family(spark: SparkSession, seed: int) -> Outcome:
    rng = np.random.default_rng(seed)
    hits = [rng.random(20) for _ in range(400)]
    raw = float(np.mean([(p < 0.05).any() for p in hits]))
    fixed = float(np.mean([min(decisions.holm(p.tolist())) < 0.05 for p in hits]))
    return Outcome(raw > 0.5, fixed < 0.08, {"raw": raw, "holm": fixed})


@scenario
def failed_runs_as_missing(spark: SparkSession, seed: int) -> Outcome:
    table = generate_experiment(World(45, 2, 10, unit_sd=4.0), [A, B], seed)
    df = to_spark(spark, mark_status(table, "policy_b", hardest_units(table, 12)))
    metric = [{"name": "success", "column": "mission_success", "direction": "higher_is_better", "role": "primary"}]
    rate = lambda handling: compare_policies(df, _config(metrics=metric, comparison={"baseline": "policy_a", "candidates": ["policy_b"], "require_common_units": False, "paired": False}, missing_data={"status_handling": {"crashed": handling}}), validate=False)
    dropped, counted = rate("missing"), rate("failure")
    return Outcome(dropped.comparisons[0].difference.estimate > counted.comparisons[0].difference.estimate + 0.05, any(r["status"] == "crashed" and r["rows"] for r in counted.ledger), {"dropped": dropped.comparisons[0].difference.estimate, "counted": counted.comparisons[0].difference.estimate})


@scenario
def paired_data_analysed_unpaired(spark: SparkSession, seed: int) -> Outcome:
    df, config = to_spark(spark, generate_experiment(World(30, 3, 10, unit_sd=6.0), [A, replace(B, shift=0.8)], seed)), _config()
    paired, apart = _difference(df, config), _difference(df, config, paired=False)
    return Outcome(not apart.excludes_zero and apart.high - apart.low > 3 * (paired.high - paired.low), paired.excludes_zero, {"paired": paired.high - paired.low, "unpaired": apart.high - apart.low})


@scenario
def metric_selected_after_the_fact(spark: SparkSession, seed: int) -> Outcome:
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=(24, 40))
    draws = rng.integers(0, 40, (400, 40))
    p = [intervals.p_two_sided(row[draws].mean(axis=1)) for row in noise]
    kept = decisions.adjust({str(i): x for i, x in enumerate(p)}, "holm")
    try:
        _config(metrics=[{"name": "a", "column": "loss", "role": "primary"}, {"name": "b", "column": "loss", "role": "primary"}])
        refused = False
    except ConfigError:
        refused = True
    return Outcome(min(p) < 0.1, min(kept.values()) > 0.05 and refused, {"least_p": min(p), "least_adjusted": min(kept.values())})


def run(spark: SparkSession, names: list[str] | None = None, seed: int = SEED) -> dict[str, Outcome]:
    unknown = sorted(set(names or ()) - set(SCENARIOS))
    if unknown:
        raise KeyError(f"unknown scenario: {', '.join(unknown)}; known: {', '.join(SCENARIOS)}")
    return {n: SCENARIOS[n](spark, seed) for n in names or SCENARIOS}


def example_records(name: str, seed: int = SEED) -> pd.DataFrame:
    """A record table to try the tools on."""
    if name not in SCENARIOS:
        raise KeyError(f"unknown scenario: {name}; known: {', '.join(SCENARIOS)}")
    return generate_experiment(World(40, 3, 10, strata=("difficulty", "scale")), [A, replace(B, shift=0.6)], seed)
