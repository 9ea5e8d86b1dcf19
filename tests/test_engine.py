"""The evaluation engine: hand-computed values, invariances, refusals, round trips."""

import json
import math
import os
import uuid
from contextvars import ContextVar
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import stratafold as sf
from stratafold import cli, mutation, queries, report, views
from stratafold.config import FilterSpec, MissingDataSpec
from stratafold.functions import decisions, estimators, intervals
from stratafold.hierarchy import infer_default, nesting_relation, nesting_relations
from stratafold.operators import failures, histogram, leave_out, multiplicity, pairing, prepare, resample, rollup, strata, validate
from stratafold.operators.dependencies import dependencies
from stratafold.operators.ranks import ranked
from stratafold.plans.compare import stratified_estimate
from stratafold.jobs import together
from stratafold.scratch import materialize, remove, save, scope
from stratafold.sources.records import coerce_types, load_records, scan, write_records
from stratafold.synth import scenarios
from stratafold.synth.generate import Policy, World, generate_experiment, scaled, to_spark

CONFIG = {
    "inference": {"primary_unit": "world_id", "nested_units": ["event_id", "resident_id"]},
    "metrics": [
        {"name": "mean_loss", "column": "loss", "level": "event_id", "role": "primary"},
        {"name": "cvar90_loss", "column": "loss", "estimator": "cvar", "params": {"alpha": 0.9}},
        {"name": "success", "column": "mission_success", "direction": "higher_is_better", "bounds": {"lower": 0, "upper": 1}},
    ],
    "comparison": {"baseline": "policy_a", "candidates": ["policy_b"]},
    "bootstrap": {"n_resamples": 120, "seed": 7},
    "equivalence": {"margins": {"mean_loss": {"lower": 2.0, "upper": 2.0, "source": "test"}}, "non_inferiority": ["mean_loss"]},
    "multiplicity": {"secondary_correction": "holm"},
}


def config(**blocks):
    return sf.config_from_mapping({**CONFIG, **blocks})


@pytest.fixture(scope="module")
def table():
    return generate_experiment(World(32, 3, 8, strata=("difficulty", "scale")), [Policy("policy_a"), Policy("policy_b", shift=0.8, crash_rate=0.05)], 11)


@pytest.fixture(scope="module")
def records(spark, table, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('r')}/records.parquet"
    to_spark(spark, table).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def compared(records):
    return sf.compare_policies(records, config())


def panel_of(records, level="event_id"):
    return rollup.panel(prepare.with_missing_policy(records, "loss", "drop_record"), sf.InferenceSpec(), "loss", level)


# Estimators


@pytest.mark.parametrize(
    ("name", "params", "expected"),
    [("mean", {}, 5.5), ("median", {}, 5.5), ("quantile", {"q": 0.9}, 9.1), ("cvar", {"alpha": 0.8}, 9.5), ("cvar", {"alpha": 0.8, "tail": "lower"}, 1.5), ("cvar", {"alpha": 0.7}, 9.0), ("trimmed_mean", {"trim": 0.1}, 5.5), ("sum", {}, 55.0), ("count", {}, 10.0), ("p_exceed", {"threshold": 7}, 0.3), ("max", {}, 10.0), ("min", {}, 1.0), ("std", {}, np.std(range(1, 11), ddof=1))],
)
def test_hand_values(spark, name, params, expected):
    assert estimators.estimate(name, [*range(1, 11), math.nan, math.inf], **params) == pytest.approx(expected)
    rows = spark.createDataFrame([("g", float(x)) for x in [*range(1, 11), math.nan, math.inf]] + [("empty", None)], "g string, v double")
    got = {r["g"]: r["estimate"] for r in estimators.estimate_by(rows, ["g"], "v", name, **params).collect()}
    assert got["g"] == pytest.approx(expected)
    assert got["empty"] == (0.0 if name in ("sum", "count") else None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(0, 3)), min_size=1, max_size=20), st.sampled_from(["mean", "median", "quantile", "cvar", "trimmed_mean", "std", "max", "min", "sum"]))
def test_weighing_is_repeating(pairs, name):
    x, w = (np.array(c) for c in zip(*pairs, strict=True))
    if not w.sum():
        return
    kernel = estimators.build(name)
    full = np.repeat(x.astype(float), w)
    a, b = kernel(x.astype(float), w), kernel(full, np.ones(len(full), np.int64))
    assert a == pytest.approx(b, nan_ok=True)


def test_quantile_is_linear():
    rng = np.random.default_rng(0)
    x = rng.normal(size=41)
    for q in (0, 0.1, 0.33, 0.5, 0.9, 1):
        assert estimators.estimate("quantile", x, q=q) == pytest.approx(np.quantile(x, q))


@pytest.mark.parametrize(("name", "params"), [("quantile", {"q": 1.5}), ("cvar", {"alpha": 1.0}), ("cvar", {"tail": "side"}), ("trimmed_mean", {"trim": 0.5}), ("nothing", {})])
def test_bad_parameters(name, params):
    with pytest.raises(ValueError):
        estimators.build(name, **params)


def test_ranks_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 5 else "b", float(v)) for i, v in enumerate(rng.integers(0, 9, 300))] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for parts in (1, 5):
        got = ranked(df.repartition(parts), ["g"], "v").collect()
        for g in ("a", "b", None):
            mine = sorted((r["__rank"], r["v"]) for r in got if r["g"] == g)
            assert [r for r, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted(v for _, v in mine)


def test_custom_estimator(spark):
    estimators.register_estimator("range_", definition="largest minus least")(lambda: lambda x, w: float(np.ptp(x[w > 0])))
    rows = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0)], "g string, v double")
    assert {r["g"]: r["estimate"] for r in sf.estimate_by(rows, ["g"], "v", "range_").collect()} == {"a": 3.0, "b": 0.0}
    del estimators.REGISTRY["range_"]


def test_custom_estimator_of_any_size(spark, monkeypatch):
    """Plain: no group passes through Python.  States: no more than a chunk does.  A kernel alone: each distinct value once."""
    from stratafold import queries

    small = "/root/testdata/sf0.001"
    if os.path.isdir(small):
        plan = queries.QUERIES["e13_custom_estimator"](spark, small)._jdf.queryExecution().toString()
        assert "InPandas" not in plan and "HashAggregate" in plan
    rows = spark.createDataFrame([(g, float(i % 9 + 1)) for i in range(400) for g in ("a", None)] + [("b", 2.0), ("c", None), ("d", math.nan)], "g string, v double")
    monkeypatch.setattr(estimators, "CHUNK_BITS", 4)

    def few(x, w):
        assert len(x) <= 16
        return [float(np.dot(np.log(x), w)), float(w.sum())]

    def distinct(x, w):
        assert len(x) <= 9
        return float(np.exp(np.dot(np.log(x), w) / w.sum()))

    monkeypatch.setitem(estimators.REGISTRY, "geometric", None)
    monkeypatch.setitem(estimators.REGISTRY, "geometric_kernel", None)
    estimators.register_estimator("geometric", states=lambda: (few, lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda s: math.exp(s[0] / s[1])))(lambda: distinct)
    estimators.register_estimator("geometric_kernel")(lambda: distinct)
    mean = math.exp(sum(math.log(i % 9 + 1) for i in range(400)) / 400)
    for name in ("geometric", "geometric_kernel"):
        got = {r["g"]: r["estimate"] for r in sf.estimate_by(rows, ["g"], "v", name).collect()}
        assert got == {"a": pytest.approx(mean), None: pytest.approx(mean), "b": pytest.approx(2.0), "c": None, "d": None}
        assert sf.estimate_by(rows.where("g = 'a'"), [], "v", name).first()["estimate"] == pytest.approx(mean)


def test_credibility():
    assert not sf.credibility("max", 29)[0] and sf.credibility("max", 30)[0]
    assert not sf.credibility("std", 10, 1)[0]
    assert "alpha=0.9" in estimators.definition("cvar")


# Preparation


def test_queries_read_every_event(spark):
    """Base forms read the whole table; only queries about shared units see an incomplete arm."""
    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("needs the driver's tables")
    total = spark.read.parquet(f"{small}/events.parquet").count()
    assert queries.QUERIES["s1_scan_parquet"](spark, small).count() == total == views.event_records(spark, small).count()
    assert views.incomplete_records(spark, small).count() < total
    part = [n for n, sql in queries.SQL.items() if views.INCOMPLETE_SQL in sql]
    assert sorted(part) == ["j1_shared_units", "j2_dropped_units", "p1_paired_panel", "p7_overlap", "t4_allocation_ledger", "t4_composition_shift"]


def test_filters_and_log(spark):
    df = spark.createDataFrame([("u1", "a", 1.0), ("u1", None, 5.0), ("u2", "b", 9.0), ("u3", "c", None)], "world_id string, g string, loss double")
    spec = FilterSpec({"g": ("a", "b", "c")}, {"g": ("c",)}, {"big": "loss > 8"})
    kept, log = sf.apply_filters(df, spec, "world_id")
    assert [r["g"] for r in kept.collect()] == ["a"]
    assert [(s["rows_before"], s["rows_after"], s["units_before"], s["units_after"]) for s in log.steps] == [(4, 3, 3, 3), (3, 2, 3, 2), (2, 1, 2, 1)]
    assert prepare.filtered(df, FilterSpec(exclude={"g": ("a",)})).count() == 3  # a null is not excluded
    with pytest.raises(KeyError):
        prepare.filtered(df, FilterSpec(include={"nowhere": ("x",)}))


def test_run_status(spark):
    rows = [("u1", "p", "completed", 1.0, 2.0, None), ("u1", "p", "crashed", None, None, None), ("u2", "p", "excluded", 1.0, 1.0, None), ("u3", "p", None, 0.0, 3.0, "why"), ("u3", "p", "odd", 0.0, 3.0, " ")]
    df = spark.createDataFrame(rows, "world_id string, policy_id string, run_status string, mission_success double, loss double, failure_reason string")
    done, log = sf.apply_run_status(df, MissingDataSpec(status_handling={"crashed": "failure"}), "world_id")
    got = {(r["world_id"], r["run_status"]): (r["mission_success"], r["loss"], r["failure_reason"]) for r in done.collect()}
    assert got[("u1", "crashed")] == (0.0, None, "run_crashed") and ("u2", "excluded") not in got and got[("u3", None)] == (0.0, 3.0, "why")
    assert log.counters == {"n_completed": 1, "n_failure": 1, "n_missing": 2, "n_excluded": 1} and log.excluded_units == ["u2"] and log.unknown_statuses == ["odd"]


def test_missing_policies(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", None), ("q", math.nan), ("q", math.inf), ("q", 9.0)], "policy_id string, loss double")
    total = lambda policy, lower=True: prepare.with_missing_policy(df, "loss", policy, lower).agg(F.sum("loss")).first()[0]
    assert (total("drop_record"), total("impute_worst"), total("impute_best"), total("impute_worst", False)) == (10.0, 37.0, 13.0, 13.0)
    with pytest.raises(prepare.MissingValues):
        total("fail")
    assert {r["policy_id"]: r["missing"] for r in prepare.missing_counts(df, "loss").collect()} == {"p": 1, "q": 2}


def test_two_steps_are_not_one(spark):
    rows = [("u", "e1", "p", f"r{i}", v) for i, v in enumerate([10.0, 10.0, 10.0, 15.0, 15.0])]
    rows = [(u, "e1" if i < 3 else "e2", p, r, v) for i, (u, _, p, r, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "world_id string, event_id string, policy_id string, resident_id string, loss double")
    spec = sf.InferenceSpec()
    assert sf.aggregate_to_level(df, spec, ["loss"], "world_id").first()["loss"] == 12.5
    nothing = df.withColumn("loss", F.lit(None).cast("double"))
    assert sf.aggregate_to_level(nothing, spec, ["loss"], "event_id", sf.config_from_mapping({**CONFIG, "aggregation": {"default_rule": "sum"}}).aggregation).first()["loss"] == 0.0


# Pairing and resampling


def test_paired_mean_by_hand(spark):
    rows = [(u, p, float(v), None) for u, a, b in (("u1", 1, 2), ("u2", 3, 5), ("u3", 8, 8)) for p, v in (("a", a), ("b", b))]
    df = spark.createDataFrame(rows, "unit string, policy_id string, value double, sub string")
    got = resample.paired_cluster_bootstrap(pairing.build_paired_panel(df, ["a", "b"]), n_resamples=200, seed=1)
    assert got["difference"].estimate == pytest.approx(1.0)
    assert set(np.round(got["difference"].replicates * 3).astype(int)) <= set(range(0, 7))


def test_shared_units(spark):
    df = spark.createDataFrame([("u1", "a", 1.0, None), ("u1", "b", 1.0, None), ("u2", "a", 1.0, None), ("u3", "b", math.nan, None)], "unit string, policy_id string, value double, sub string")
    own = sf.build_paired_panel(df, ["a", "b"])
    assert (own.n_units, own.n_shared, own.n_union, own.paired) == (1, 1, 2, True) and own.dropped == {"a": 0, "b": 1} and own.coverage == 0.5
    every = sf.build_paired_panel(df, ["a", "b"], require_common_units=False)
    assert every.n_units == 2 and not every.paired and every.estimand().startswith("UNPAIRED")
    with pytest.raises(pairing.PairingError):
        sf.build_paired_panel(df, ["a"])
    with pytest.raises(pairing.PairingError):
        sf.build_paired_panel(df, ["a", "c"])


def test_results_do_not_depend_on_partitions_or_order(records):
    a, b = (resample.paired_cluster_bootstrap(pairing.build_paired_panel(panel_of(r), ["policy_a", "policy_b"]), n_resamples=150, seed=5)["difference"] for r in (records.coalesce(1), records.repartition(7, "resident_id")))
    assert np.allclose(a.replicates, b.replicates) and (a.low, a.high) == pytest.approx((b.low, b.high))


def test_algebraic_equals_kernel(records):
    own = pairing.build_paired_panel(panel_of(records), ["policy_a", "policy_b"])
    placed = own.rows.join(resample.unit_index(own.rows), "unit")
    for name in ("mean", "std", "sum", "p_exceed"):
        params = {"threshold": 12.0} if name == "p_exceed" else {}
        for streams in ((0,), (0, 1)):
            a = resample.replicates(own.rows, own.policies, name, params, seed=3, n_resamples=120, streams=streams).toPandas().sort_values("b")
            b = resample.order_replicates(placed, own.policies, name, params, 3, 120, streams).toPandas().sort_values("b")
            assert a["b"].tolist() == list(range(-1, 120)) and np.allclose(a[["e0", "e1"]], b[["e0", "e1"]])


def test_draws_are_multinomial(spark):
    """Every replicate draws as often as there are units; few units of a tree give the same counts as all; moments are right."""
    drawn = resample.draws(spark, 3, 400, 23).toPandas()
    assert (drawn.groupby("b")["w"].sum() == 23).all() and set(drawn["b"]) == set(range(-1, 400))
    leaves = pd.DataFrame({"unit_ix": np.arange(23), "k": 23})
    w = multiplicity.weights(3, 0, np.arange(20_000), leaves)
    assert (w[:400][drawn["b"].to_numpy()[drawn["b"] >= 0], drawn["unit_ix"][drawn["b"] >= 0]] == drawn["w"][drawn["b"] >= 0]).all()
    assert (multiplicity.weights(3, 0, np.arange(50), leaves.iloc[[20, 4]]) == w[:50, [20, 4]]).all()
    assert np.abs(w.mean(axis=0) - 1).max() < 0.03
    covariance = np.cov(w.T)
    assert np.abs(np.diag(covariance) - 22 / 23).max() < 0.05 and np.abs(covariance - np.diag(np.diag(covariance)) + (1 - np.eye(23)) / 23).max() < 0.04
    chances = [math.comb(23, k) * (1 / 23) ** k * (22 / 23) ** (23 - k) for k in range(5)]
    assert np.abs(np.bincount(w.ravel(), minlength=5)[:5] / w.size - chances).max() < 0.005


def test_binomial_quantiles():
    """Against exact distribution functions, split sizes of every kind, large counts by their moments."""
    for n, c in ((2, 9), (3, 14), (7, 40)):
        p = Fraction(n // 2, n)
        exact, total = [], Fraction(0)
        for k in range(c + 1):
            total += math.comb(c, k) * p**k * (1 - p) ** (c - k)
            exact.append(total)
        u = np.random.default_rng(1).random(300)
        want = [min(sum(f < Fraction(x) for f in exact), c) for x in u.tolist()]
        assert multiplicity.binomial_quantile(u, np.full(300, c), n // 2, n).tolist() == want
    u = (np.arange(20_000) + 0.5) / 20_000
    big = multiplicity.binomial_quantile(u, np.full(20_000, 4_000_001), 500_000, 1_000_001)
    p = 500_000 / 1_000_001
    assert abs(big.mean() - 4_000_001 * p) < 2 and abs(big.std() / (4_000_001 * p * (1 - p)) ** 0.5 - 1) < 1e-3
    assert multiplicity.binomial_quantile(np.array([0.5, 0.9]), np.array([0, 1]), 1, 2).tolist() == [0, 1]


def test_groups_draw_as_they_would_alone(records):
    rows = panel_of(records).withColumn("g", F.when(F.col("unit") < "u0012", "x"))  # the other group's name is null
    both = resample.algebraic_replicates(resample.wide(rows, ("policy_a", "policy_b"), keys=["g"]), ("policy_a", "policy_b"), "mean", 5, 40, keys=["g"]).toPandas()
    for name, own in (("x", rows.where("g = 'x'")), (None, rows.where("g is null"))):
        alone = resample.replicates(own, ("policy_a", "policy_b"), seed=5, n_resamples=40).toPandas().sort_values("b")
        mine = both[both["g"] == name] if name else both[both["g"].isna()]
        assert np.allclose(mine.sort_values("b")[["e0", "e1"]], alone[["e0", "e1"]])


@pytest.mark.parametrize("two_stage", [False, True])
def test_large_panels_by_histograms(records, monkeypatch, two_stage):
    """Panels beyond the broadcast: the same order statistics from histograms, custom estimators from repeated rows."""
    monkeypatch.setattr(histogram, "CELLS", 7)
    own = pairing.build_paired_panel(panel_of(records), ["policy_a", "policy_b"])
    cases = [("cvar", {"alpha": 0.8, "tail": "upper"}), ("quantile", {"q": 0.83})] if two_stage else [("cvar", {"alpha": 0.9, "tail": "lower"}), ("median", {}), ("trimmed_mean", {"trim": 0.2}), ("max", {})]
    for k, (name, params) in enumerate(cases):
        streams = (0,) if two_stage or k % 2 else (0, 1)
        run = lambda: resample.replicates(own.rows, own.policies, name, params, seed=2, n_resamples=30, streams=streams, two_stage=two_stage).toPandas().sort_values("b")  # noqa: B023, E731
        monkeypatch.setattr(resample, "BROADCAST_ROWS", 1000)
        small = run()
        monkeypatch.setattr(resample, "BROADCAST_ROWS", 0)
        large = run()
        assert large["b"].tolist() == list(range(-1, 30)) and np.allclose(small[["e0", "e1"]], large[["e0", "e1"]]), name


def test_histograms_of_awkward_panels(spark, monkeypatch):
    """Ties, a unit with most rows, a policy with one value and one without any, null and infinite values."""
    monkeypatch.setattr(histogram, "CELLS", 5)
    rng = np.random.default_rng(4)
    rows = [(f"u{k}", "a", float(round(x))) for k, x in zip(rng.integers(0, 9, 60), rng.normal(size=60) * 2, strict=True)] + [("u3", "a", float(x)) for x in rng.normal(size=90)]
    rows += [("u1", "a", None), ("u2", "a", float("inf")), ("u2", "b", 4.0), ("u4", "c", float("nan"))]
    df = spark.createDataFrame(rows, "unit string, policy_id string, value double")
    for name in ("median", "cvar"):
        monkeypatch.setattr(resample, "BROADCAST_ROWS", 1000)
        small = resample.replicates(df, ("a", "b", "c"), name, seed=1, n_resamples=25).toPandas().sort_values("b")
        monkeypatch.setattr(resample, "BROADCAST_ROWS", 0)
        large = resample.replicates(df, ("a", "b", "c"), name, seed=1, n_resamples=25).toPandas().sort_values("b")
        assert np.allclose(small[["e0", "e1", "e2"]].astype(float), large[["e0", "e1", "e2"]].astype(float), equal_nan=True)
        assert small["e1"].isna().any() and small["e2"].isna().all()


def test_custom_estimators_of_large_panels(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(f"u{k % 7}", p, float(x)) for p in "ab" for k, x in enumerate(rng.normal(size=40))], "unit string, policy_id string, value double")
    placed = df.join(resample.unit_index(df), "unit").select("unit_ix", "k", "policy_id", "value")
    small = resample.order_replicates(placed, ("a", "b"), "median", {}, 1, 15).toPandas().sort_values("b")
    large = resample._joined_replicates(placed, ("a", "b"), "median", {}, 1, 15, (0,)).toPandas().sort_values("b")
    assert np.allclose(small[["e0", "e1"]], large[["e0", "e1"]])


def test_pairing_narrows_and_methods_agree(records):
    own = pairing.build_paired_panel(panel_of(records), ["policy_a", "policy_b"])
    run = lambda **k: resample.paired_cluster_bootstrap(own, n_resamples=150, seed=4, **k)["difference"]
    p, apart, basic, bca = run(), run(paired=False), run(method="basic"), run(method="bca")
    assert apart.high - apart.low > p.high - p.low
    assert basic.low == pytest.approx(2 * p.estimate - p.high) and bca.method == "bca" and abs(bca.low - p.low) < p.high - p.low
    both = run(hierarchical=True)
    assert 0.5 < (both.high - both.low) / (p.high - p.low) < 2.5
    one = sf.cluster_bootstrap(pairing.single_policy_values(panel_of(records), "policy_a"), n_resamples=120, seed=4)
    assert one.low < one.estimate < one.high and one.p_value is None
    naive = sf.naive_iid_bootstrap(pairing.single_policy_values(panel_of(records, "resident_id"), "policy_a"), n_resamples=120, seed=4)
    assert naive.high - naive.low < one.high - one.low


def test_leaving_units_out_by_ranks(spark, monkeypatch):
    """Ties, a unit with half of the rows, units without rows of a policy, a unit that is a policy's only one, no finite value."""
    monkeypatch.setattr(leave_out, "CHUNK_BITS", 4)
    rng = np.random.default_rng(8)
    rows = [(int(u), p, float(round(x, 1))) for p, n in (("a", 150), ("b", 90)) for u, x in zip(rng.integers(0, 12, n), rng.normal(size=n), strict=True)]
    rows += [(12, "a", float(x)) for x in rng.normal(size=150)] + [(13, "a", float("nan")), (14, "c", 1.0), (14, "c", 3.0)]
    df = spark.createDataFrame([(f"{u:02d}", p, v) for u, p, v in rows], "unit string, policy_id string, value double")
    for name, params in (("median", {}), ("quantile", {"q": 0.83}), ("cvar", {"alpha": 0.8, "tail": "upper"}), ("cvar", {"alpha": 0.9, "tail": "lower"}), ("trimmed_mean", {"trim": 0.2}), ("min", {}), ("max", {})):
        made = resample.leave_one_out(df, ("a", "b", "c"), name, params).toPandas().sort_values("unit_ix")
        assert made["unit_ix"].tolist() == list(range(15))
        for k, p in enumerate("abc"):
            for u, e in zip(made["unit_ix"], made[f"e{k}"], strict=True):
                left = [v for i, q, v in rows if q == p and i != u and np.isfinite(v)]
                want = estimators.estimate(name, left, **params) if left else np.nan
                assert e == pytest.approx(want, abs=1e-9, nan_ok=True), (name, p, u)


@pytest.mark.parametrize("name", ["mean", "median"])
def test_two_stages(spark, name):
    """Units, then sub-units within unit and policy: against the counts' definition, null sub-units and several rows included."""
    rng = np.random.default_rng(5)
    rows = [(f"u{u}", p, None if s == 0 else f"s{s}", float(rng.normal())) for u in range(6) for p in "ab" for s in range(int(rng.integers(1, 5))) for _ in range(int(rng.integers(1, 3)))]
    df = spark.createDataFrame(rows, "unit string, policy_id string, sub string, value double")
    got = resample.replicates(df, ("a", "b"), name, seed=3, n_resamples=20, two_stage=True).toPandas().set_index("b")
    one = lambda k, n: pd.DataFrame({"unit_ix": np.arange(n), "k": n}).assign(**k)
    numbers = np.arange(20)
    units = multiplicity.weights(3, 0, numbers, one({}, 6))
    for k, p in enumerate("ab"):
        for b in range(20):
            taken = []
            for u in range(6):
                subs = sorted({r[2] for r in rows if r[:2] == (f"u{u}", p)}, key=lambda s: (s is not None, s or ""))
                n = len(subs)
                inner = multiplicity.split(3, 2, numbers[b : b + 1], units[b : b + 1, [u]] * n, np.array([1 + 2 * u + k]), np.array([n]), np.zeros(n, int), np.arange(n))[0]
                assert inner.sum() == units[b, u] * n
                for sub, w in zip(subs, inner.tolist(), strict=True):
                    taken += [r[3] for r in rows if r[:3] == (f"u{u}", p, sub)] * w
            assert got.loc[b, f"e{k}"] == pytest.approx(estimators.estimate(name, taken)) if taken else np.isnan(got.loc[b, f"e{k}"])
    assert got.loc[resample.ITSELF, "e0"] == pytest.approx(estimators.estimate(name, [r[3] for r in rows if r[1] == "a"]))


def test_refusals_of_the_bootstrap(spark):
    one = spark.createDataFrame([("u", "a", 1.0, None), ("u", "b", 2.0, None)], "unit string, policy_id string, value double, sub string")
    with pytest.raises(resample.BootstrapError):
        resample.paired_cluster_bootstrap(pairing.build_paired_panel(one, ["a", "b"]))
    flat = spark.createDataFrame([(f"u{i}", p, float(i), None) for i in range(5) for p in "ab"], "unit string, policy_id string, value double, sub string")
    with pytest.raises(resample.BootstrapError):
        resample.paired_cluster_bootstrap(pairing.build_paired_panel(flat, ["a", "b"]), hierarchical=True)


def test_design_effect(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{i}", float(m + rng.normal())) for i, m in enumerate(rng.normal(0, 3, 60)) for _ in range(10)]
    r = resample.design_effect(spark.createDataFrame(rows, "unit string, value double")).first()
    assert 0.8 < r["icc"] < 0.97 and r["n_units"] == 60 and r["effective_n"] == pytest.approx(600 / r["design_effect"])
    lone = resample.design_effect(spark.createDataFrame([("u", 1.0)], "unit string, value double")).first()
    assert lone["icc"] is None


def test_intervals():
    rng = np.random.default_rng(0)
    x = rng.normal(1, 1, 4000)
    assert intervals.p_two_sided(np.ones(99)) == 0.01 and intervals.p_two_sided(np.array([-1.0, 1.0])) == 1.0
    assert intervals.interval(1.0, x, 0.95, "bca", intervals.Influence(2, 2, 0.0))[2] == "percentile"
    assert intervals.interval(99.0, x, 0.95, "bca", intervals.Influence(9, 9, 0.1))[3]
    assert intervals.outside(-0.1, 1.2, (0.0, 1.0)) and not intervals.outside(0.1, 0.9, (0.0, 1.0))
    with pytest.raises(ValueError):
        intervals.interval(1.0, x, 0.95, "other")


# Decisions


def test_equivalence_and_verdicts():
    x = np.linspace(-0.5, 0.5, 1001)
    assert sf.tost(x, sf.Margin(1, 1)).conclusion == "equivalent" and sf.tost(x, sf.Margin(1, 0.2)).conclusion == "inconclusive" and sf.tost(x + 5, sf.Margin(1, 1)).conclusion == "outside_margin"
    assert sf.tost(x, sf.Margin(1, 1)).p_value == pytest.approx(1 / 1002)
    assert sf.non_inferiority(x, sf.Margin(0.1, 1), "lower_is_better").holds and not sf.non_inferiority(x, sf.Margin(0.1, 1), "higher_is_better").holds
    m = sf.MetricSpec("m", "loss")
    e = sf.tost(x, sf.Margin(1, 1))
    assert sf.classify_difference(0.3, 0.1, 0.5, m, e) == ("statistically_different_within_margin", None)
    assert sf.classify_difference(0.3, 0.1, 0.5, m) == ("worse", "baseline") and sf.classify_difference(-0.3, -0.5, -0.1, m) == ("superior", "candidate")
    assert sf.classify_difference(0.0, -1, 1, m, e) == ("statistically_equivalent", None) and sf.classify_difference(0.0, -1, 1, m) == ("inconclusive", None)


def test_multiplicity(spark):
    assert sf.holm([0.01, 0.04, 0.03, 0.005]) == pytest.approx([0.03, 0.06, 0.06, 0.02]) and sf.bonferroni([0.5, 0.01]) == [1.0, 0.02]
    assert sf.adjust({"a": 0.01, "b": None, "c": 0.04}, "holm") == {"a": 0.02, "b": None, "c": 0.04}
    rows = spark.createDataFrame([("f", str(i), p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, None])], "family string, test string, p_value double")
    got = [r["p_adjusted"] for r in decisions.adjusted(rows, "holm").orderBy("test").collect()]
    assert got[:4] == pytest.approx([0.03, 0.06, 0.06, 0.02]) and got[4] is None


def test_coverage():
    assert sf.wilson_interval(95, 100) == pytest.approx((0.8882, 0.9785), abs=1e-4) and sf.wilson_interval(0, 0) == (0.0, 1.0)
    assert decisions.replications_for(0.02) == 457
    c = sf.estimate_coverage([0, 0, 2], [1, 1, 3], 0.5)
    assert c.hits == 2 and c.n == 3
    assert decisions.compare_coverage(sf.CoverageEstimate(95, 100), sf.CoverageEstimate(50, 100))["distinct"]


# Configuration


@pytest.mark.parametrize(
    "change",
    [
        {"weights": "w"}, {"inference": {"primary_unit": "resident_id"}}, {"metrics": []}, {"metrics": [{"name": "x"}]}, {"metrics": [{"column": "loss", "estimator": "nothing"}]},
        {"metrics": [{"name": "a", "column": "loss", "role": "primary"}, {"name": "b", "column": "loss", "role": "primary"}]}, {"metrics": [{"column": "loss", "level": "policy_id"}]}, {"bootstrap": {"n_resamples": 50}},
        {"bootstrap": {"method": "studentized"}}, {"bootstrap": {"confidence_level": 1.0}}, {"equivalence": {"alpha": 0.6}}, {"equivalence": {"margins": {"nothing": 1}}}, {"equivalence": {"margins": {"mean_loss": 0}}},
        {"equivalence": {"margins": {"mean_loss": {"lower": 1, "upper": 1, "scale": "standardized"}}}}, {"missing_data": {"policy": "guess"}}, {"aggregation": {"nonsense": {"loss": "mean"}}},
        {"aggregation": {"resident_id->event_id": {"loss": "mode"}}}, {"analysis_status": "preregistered"}, {"analysis_role": {"primary": ["nothing"]}}, {"metrics": [{"column": "loss", "bounds": {"lower": 1, "upper": 0}}]},
        {"inference": {"primary_unit": "policy_id"}},
    ],
)
def test_configurations_that_are_refused(change):
    with pytest.raises((sf.ConfigError, sf.InferenceStructureError)):
        config(**change)


def test_configuration():
    both = config(analysis_role={"primary": ["success", "mean_loss"], "secondary": ["mean_loss"]})
    assert {m.name: m.role for m in both.metrics}["mean_loss"] == "secondary"  # of lists that overlap the later one
    c = config(analysis_role={"primary": "success", "exploratory": ["mean_loss"]}, aggregation={"resident_to_event": {"loss": "sum"}})
    assert {m.name: m.role for m in c.metrics} == {"mean_loss": "exploratory", "cvar90_loss": "secondary", "success": "primary"}
    assert c.aggregation.rule("resident_id", "event_id", "loss") == "sum" and c.aggregation.rule("event_id", "world_id", "loss") == "mean"
    assert c.metric("cvar90_loss").parameters == {"alpha": 0.9, "tail": "upper"} and c.metric("success").tail_side == "lower"
    assert sf.config_from_mapping(__import__("yaml").safe_load(c.to_yaml())).metrics == c.metrics
    odd = sf.MetricSpec("q", "loss", "quantile", params={"q": 0.1})
    assert odd.orientation_warnings() and not sf.MetricSpec("q", "loss", "quantile", params={"q": 0.9}).orientation_warnings()
    assert config(equivalence={"margins": {"mean_loss": 0.5}}).margin_for(c.metrics[0]) == sf.Margin(0.5, 0.5)


def test_tails_follow_the_direction():
    tail = lambda **more: sf.MetricSpec("m", "loss", "cvar", **more)
    with pytest.raises(sf.ConfigError, match="contradicts"):
        tail(params={"alpha": 0.9, "tail": "lower"})
    with pytest.raises(sf.ConfigError, match="contradicts"):
        tail(params={"tail": "upper"}, tail="beneficial")
    assert tail(params={"tail": "lower"}, tail="lower").parameters["tail"] == "lower"
    assert tail(direction="higher_is_better").parameters["tail"] == "lower"
    quantile = lambda **more: sf.MetricSpec("m", "gain", "quantile", **more).orientation_warnings()
    assert quantile(direction="higher_is_better") and not quantile() and not quantile(direction="higher_is_better", params={"q": 0.1})
    assert not quantile(direction="higher_is_better", tail="beneficial") and not quantile(params={"q": 0.5})
    for mechanism in ("MCAR", "MAR", "MNAR", "unknown"):
        assert config(missing_data={"assumed_mechanism": mechanism}).missing_data.assumed_mechanism == mechanism
    with pytest.raises(sf.ConfigError):
        config(missing_data={"assumed_mechanism": "mnar"})
    with pytest.raises(sf.ConfigError):
        config(analysis_role={"primary": "nothing"})


def test_together(spark):
    assert together(lambda: 1, lambda: spark.range(5).count(), lambda: 3) == [1, 5, 3] and together() == []
    with pytest.raises(KeyError):
        together(lambda: {}["x"], lambda: 1)
    told = ContextVar("told", default=0)
    told.set(4)
    assert together(told.get, told.get) == [4, 4]


def _jobs(spark, call) -> int:
    """Spark jobs that the call starts, in all its threads."""
    name = f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(name, "counted")
    try:
        call()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_follow_levels_or_columns(spark):
    """All levels of a stratum, all pairs of columns and all strata are keys of the same jobs."""
    table = generate_experiment(World(48, 2, 4), [Policy("policy_a"), Policy("policy_b", shift=0.5)], 3)
    table["few"] = [f"l{int(u[1:]) % 2}" for u in table["world_id"]]
    table["many"] = [f"l{int(u[1:]) % 8}" for u in table["world_id"]]
    for k in range(4):
        table[f"c{k}"] = [f"v{int(u[1:]) // 2**k % 3}" for u in table["world_id"]]
    df = to_spark(spark, table).cache()
    config = sf.config_from_mapping({**CONFIG, "metrics": CONFIG["metrics"][:2], "equivalence": {}})
    by = {}
    two, eight = (_jobs(spark, lambda c=c: by.update({c: sf.compare_by_stratum(df, config, c, min_units=3)})) for c in ("few", "many"))
    assert sorted(by["many"].strata) == [f"l{k}" for k in range(8)] and eight <= two + 4
    level = by["many"].strata["l3"]
    alone = sf.compare_policies(df.where("many = 'l3'"), config, validate=False)
    assert level.summary_table().drop(columns="p_adjusted").equals(alone.summary_table().drop(columns="p_adjusted")) or np.allclose(level.summary_table()[["difference", "ci_low", "ci_high"]], alone.summary_table()[["difference", "ci_low", "ci_high"]])
    assert level.log.counters == alone.log.counters and level.ledger == alone.ledger and level.failures == alone.failures
    assert [c.diagnostics["imbalance"] for c in level.comparisons] == [c.diagnostics["imbalance"] for c in alone.comparisons]
    assert _jobs(spark, lambda: nesting_relations(df, [("world_id", "event_id")])) == _jobs(spark, lambda: nesting_relations(df, [("world_id", c) for c in ("event_id", "few", "many", "c0", "c1")]))
    assert _jobs(spark, lambda: strata.stratum_redundancy(df, "world_id", ["few", "c0"])) == _jobs(spark, lambda: strata.stratum_redundancy(df, "world_id", ["few", "many", "c0", "c1", "c2", "c3"]))


def test_dependencies_against_counts(spark):
    rng = np.random.default_rng(2)
    rows = [(None if k % 11 == 0 else f"a{k % 6}", f"b{k % 3}", int(rng.integers(0, 4)), f"d{k}", None) for k in range(60)]
    df = spark.createDataFrame(rows, "a string, b string, c int, d string, e string")
    names = list("abcde")
    got = dependencies(df, names)
    for i, x in enumerate(names):
        values = {r[i] for r in rows if r[i] is not None}
        assert got[x].values == len(values) and got[x].least == min((sum(r[i] == v for r in rows) for v in values), default=None)
        for j, y in enumerate(names):
            met = [{r[j] for r in rows if r[i] == v and r[j] is not None} for v in values]
            assert got[x].by[y] == (None if not any(met) else all(len(m) <= 1 for m in met)), (x, y)


def test_distinct_counts_copy_no_row(spark):
    """Several exact distinct counts at once, without the plan node that copies each row for each of them."""
    rows = [("p" if k % 3 else "q", f"u{k % 5}", f"u{k % 5}-e{k % 7}" if k % 8 else None, float(k % 2) if k % 9 else None) for k in range(70)]
    df = spark.createDataFrame(rows, "policy_id string, world_id string, event_id string, mission_success double")
    got = strata.allocation_ledger(df, "world_id", ["p", "q"], ["event_id"])
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        own = [x for x in rows if x[0] == r["policy_id"]]
        shared = {x[1] for x in rows if x[0] == "p"} & {x[1] for x in rows if x[0] == "q"}
        units = {x[1] for x in own}
        assert (r["rows"], r["units"], r["shared_units"], r["unshared_units"], r["n_event_id"], r["failures"]) == (len(own), len(units), len(units & shared), len(units - shared), len({x[2] for x in own if x[2]}), sum(x[3] == 0 for x in own))
    counts = rollup.nesting_counts(df, sf.InferenceSpec("world_id", ("event_id",)))
    assert "Expand" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r["unit"], r["policy_id"]): (r["n_event_id"], r["n_rows"]) for r in counts.collect()} == {(u, p): (len({x[2] for x in rows if x[:2] == (p, u) and x[2]}), sum(x[:2] == (p, u) for x in rows)) for p, u in {x[:2] for x in rows}}


def test_scratch_scope(spark):
    with scope() as written:
        kept, path = save(spark.range(3), "scope")
        materialize(spark.range(2), "scope")
    materialize(spark.range(1), "scope")
    assert len(written) == 2 and written[0] == path
    remove(spark, written[1])
    assert kept.count() == 3
    with pytest.raises(Exception):  # noqa: B017, PT011
        spark.read.parquet(written[1]).count()


def test_delimited_files_are_split(spark, tmp_path):
    """One large file gives many tasks; files with line breaks inside quotes are read whole, beside files that are not."""
    plain = tmp_path / "plain.csv"
    plain.write_text("world_id,loss,note\n" + "".join(f"u{k},{k}.5,\"a, \"\"quoted\"\" {k}\"\n" for k in range(4000)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        df = scan(spark, f"file://{plain}", "csv")
        assert df.rdd.getNumPartitions() > 4
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert len(rows) == 4000 and {r["note"] for r in rows} == {f'a, "quoted" {k}' for k in range(4000)} and rows[0]["loss"].endswith(".5")
    several = tmp_path / "several.csv"
    several.mkdir()
    (several / "a.csv").write_text('world_id,loss,note\nu1,1,"one\nline, ""and"" another"\nu2,2,NA\n')
    (several / "b.csv").write_text('world_id,loss,note\nu3,3,"plain"\n0004,,x\n')
    got = {r["world_id"]: (r["loss"], r["note"]) for r in scan(spark, f"file://{several}", "csv").collect()}
    assert got == {"u1": ("1", 'one\nline, "and" another'), "u2": ("2", None), "u3": ("3", "plain"), "0004": (None, "x")}
    tabbed = tmp_path / "t.tsv"
    tabbed.write_text("world_id\tnote\nu1\ta,b\n")
    assert [tuple(r) for r in scan(spark, f"file://{tabbed}", "tsv").collect()] == [("u1", "a,b")]


# Structure and validation


def test_nesting(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "a string, b string")
    assert nesting_relation(make(("1", "x"), ("2", "y")), "a", "b") == "one_to_one"
    assert nesting_relation(make(("1", "x"), ("2", "x")), "a", "b") == "a_within_b"
    assert nesting_relation(make(("1", "x"), ("1", "y")), "a", "b") == "b_within_a"
    assert nesting_relation(make(("1", "x"), ("1", "y"), ("2", "x")), "a", "b") == "crossed"
    assert nesting_relation(make((None, "x")), "a", "b") == "crossed"


def test_structure(spark, records):
    assert {i.severity for i in sf.check_structure(records, sf.InferenceSpec())} <= {"warning"} and infer_default(records) == sf.InferenceSpec()
    inverted = sf.InferenceSpec("event_id", ("world_id", "resident_id"))
    assert "inverted_nesting" in {i.code for i in sf.check_structure(records, inverted)}
    with pytest.raises(sf.InferenceStructureError):
        sf.require_valid_structure(records, inverted)
    wider = records.withColumn("site_id", F.substring("world_id", 1, 4))
    assert "undeclared_coarser_grouping" in {i.code for i in sf.check_structure(wider, sf.InferenceSpec())}
    assert "undeclared_unit_column_missing" in {i.code for i in sf.check_structure(records.drop("event_id"), sf.InferenceSpec())}
    assert "single_primary_unit" in {i.code for i in sf.check_structure(records.where("world_id = 'u0000'"), sf.InferenceSpec())}


def test_validation_codes(spark, records):
    codes = lambda df, **k: sf.validate_records(df, **k).codes()
    assert sf.validate_records(records).ok
    assert codes(records.drop("policy_id")) == {"missing_required_columns"} and codes(records.where("false")) == {"empty_table"}
    first = records.limit(1)
    assert "duplicate_records" in codes(records.unionByName(first))
    assert "null_key" in codes(records.unionByName(first.withColumn("event_id", F.lit(None).cast("string"))))
    assert "non_binary_outcome" in codes(records.withColumn("mission_success", F.col("mission_success") * 5))
    assert {"non_finite_value"} <= codes(records.withColumn("loss", F.lit(float("inf"))))
    assert {"implausible_value", "missing_outcome"} <= codes(records.withColumn("loss", F.col("loss") - 50))
    assert "non_numeric_column" in codes(records.withColumn("loss", F.lit("x")))
    assert "broken_nesting" in codes(records.unionByName(first.withColumns({"world_id": F.lit("u0031"), "resident_id": F.lit("new")})))
    assert "no_common_units" in codes(records.where("(policy_id = 'policy_a') = (world_id < 'u0016')"))
    assert {"unbalanced_policy_coverage"} <= codes(records.where("policy_id = 'policy_a' or world_id < 'u0016'"))
    assert "single_policy" in codes(records.where("policy_id = 'policy_a'")) and "few_units" in codes(records.where("world_id < 'u0010'"))
    assert {"weight_column_ignored", "extra_columns"} <= codes(records.withColumn("weight", F.lit(1.0)))
    strange = sf.validate_records(records.withColumn("run_status", F.lit("strange")))
    assert {"unknown_run_status", "incomplete_runs", "run_status_present"} <= strange.codes()
    assert [f"policy_a: {records.where(F.col('policy_id') == 'policy_a').count()}" in i.message for i in strange.issues if i.code == "incomplete_runs"] == [True]
    assert "failure_without_reason" in codes(records.withColumn("failure_reason", F.lit(None).cast("string"))) and "success_with_failure_reason" in codes(records.withColumn("failure_reason", F.lit("x")))
    odd = records.withColumns({"same": F.col("difficulty"), "one": F.lit("x"), "varies": F.col("resident_id"), "holes": F.lit(None).cast("string"), "arm": F.col("policy_id")})
    found = codes(odd, strata=["difficulty", "same", "one", "varies", "holes", "loss", "nowhere"])
    assert {"identical_strata", "single_level_stratum", "stratum_varies_within_unit", "null_stratum", "outcome_used_as_stratum", "missing_stratum_column", "thin_stratum_cell", "nested_strata"} <= found
    report_ = sf.validate_for_config(records, config(metrics=[{"name": "m", "column": "loss", "bounds": {"upper": 1.0}, "margin": 0.1}, {"name": "q", "column": "loss", "estimator": "min"}], equivalence={}))
    assert {"value_outside_declared_bounds", "undocumented_margin", "no_primary_metric", "analysis_status_unspecified", "metric_orientation"} <= report_.codes()
    assert validate.policy_coverage(records, "world_id").first()["common"] == 32


# Strata and failures


def test_strata_and_failures(spark, records):
    df = spark.createDataFrame([("u", "p", "b"), ("u", "p", "a"), ("v", "p", None), ("v", "q", None), ("v", "q", "z")], "world_id string, policy_id string, g string")
    assert {r["unit"]: r["stratum"] for r in strata.unit_strata(df, "world_id", "g").collect()} == {"u": "a", "v": "__missing__"}
    assert {r["stratum"]: r["gap"] for r in strata.allocation_balance(df, "world_id", "g").collect()} == {"a": 0.5, "__missing__": 0.5}
    rows = [("u", "p", 0.0, "x"), ("u", "p", 1.0, None), ("u", "q", 0.0, ""), ("v", "p", 0.0, "x"), ("w", "q", None, None), ("w", "p", 1.0, None)]
    f = spark.createDataFrame(rows, "world_id string, policy_id string, mission_success double, failure_reason string")
    shifts = {r["reason"]: (r["baseline_rate"], r["candidate_rate"], r["shift"]) for r in failures.failure_shifts(f, "world_id", "p", "q").collect()}
    assert shifts == {"x": (0.25, 0.0, -0.25), "unspecified": (0.0, 0.5, 0.5)}
    summary = sf.summarize_failures(f, "world_id", "p", ["q"])
    assert summary.worst("q") == "unspecified" and sf.summarize_failures(f.select("world_id", "policy_id"), "world_id", "p", ["q"]) is None


# Whole analyses


def test_comparison(compared, records):
    t = compared.summary_table()
    assert list(t["metric"]) == ["mean_loss", "cvar90_loss", "success"] and t["n_units"].eq(32).all()
    assert (t["ci_low"] < t["difference"]).all() and (t["difference"] < t["ci_high"]).all()
    swapped = sf.compare_policies(records, config(comparison={"baseline": "policy_b", "candidates": ["policy_a"]}), metrics=["mean_loss"], validate=False).comparisons[0]
    assert swapped.difference.estimate == pytest.approx(-compared.comparisons[0].difference.estimate) and swapped.difference.low == pytest.approx(-compared.comparisons[0].difference.high)
    assert compared.ledger and compared.failures.table and compared.comparisons[0].non_inferiority is not None
    first = compared.comparisons[0].provenance
    again = sf.provenance_for(config(label="other"), compared.config.metrics[0], "policy_a", "policy_b", None, "percentile")
    other = sf.provenance_for(config(bootstrap={"n_resamples": 120, "seed": 8}), compared.config.metrics[0], "policy_a", "policy_b", None, "percentile")
    elsewhere = sf.provenance_for(config(protocol={"path": "here.md"}), compared.config.metrics[0], "policy_a", "policy_b", None, "percentile")
    moved = sf.provenance_for(config(protocol={"path": "there.md"}), compared.config.metrics[0], "policy_a", "policy_b", None, "percentile")
    assert elsewhere.scientific_fingerprint() == moved.scientific_fingerprint() and elsewhere.full_fingerprint() != moved.full_fingerprint()
    assert first.scientific_fingerprint() == again.scientific_fingerprint() != other.scientific_fingerprint()


def test_by_stratum(records):
    one = config(metrics=[CONFIG["metrics"][0]])
    got = sf.compare_by_stratum(records, one, "difficulty")
    assert set(got.strata) == {"easy", "hard"} and set(got.summary_table()["stratum"]) == {"__all__", "easy", "hard"}
    inside = [r.comparisons[0].difference.estimate for r in got.strata.values()]
    assert min(inside) <= stratified_estimate(got, "mean_loss") <= max(inside)
    few = sf.compare_by_stratum(records, one, "difficulty", min_units=30)
    assert set(few.skipped) == {"easy", "hard"} and not few.strata


def test_reports(compared, tmp_path):
    paths = sf.write_report(compared, tmp_path, title="T")
    assert paths["markdown"].read_text().startswith("# T") and json.loads(paths["json"].read_text())["baseline"] == "policy_a"
    assert sf.audit_wording("A proves it\nfine") == ["line 1: 'proves'"] and not sf.audit_wording(paths["markdown"].read_text())
    with pytest.raises(report.WordingError):
        sf.write_report(compared, tmp_path, title="this proves it")
    for claim in ("no significant difference", "A beats B", "better overall", "the overall winner", "it is safe", "they are the same"):
        assert sf.audit_wording(claim), claim
    assert report.reproducibility_manifest(compared).report_generator == sf.REPORT_GENERATOR_VERSION
    assert report.plain({"a": math.nan, "b": (1, np.float64(2))}) == {"a": None, "b": [1, 2.0]}


def test_files(spark, records, tmp_path):
    for suffix in (".parquet", ".csv", ".jsonl"):
        path = tmp_path / f"r{suffix}"
        write_records(records, path, single=True)
        back, source = load_records(spark, path)
        assert source.rows == records.count() and source.sha256 == sf.file_checksum(path)
        assert back.agg(F.round(F.sum("loss"), 6)).first() == records.agg(F.round(F.sum("loss"), 6)).first()
    write_records(records, tmp_path / "many.parquet")
    back, source = load_records(spark, f"file://{tmp_path}/many.parquet")
    assert back.count() == source.rows == records.count() and source.sha256 == sf.file_checksum(tmp_path / "many.parquet")
    (tmp_path / "x.tsv").write_text("world_id\tloss\tother\n0001\t 2.5\tNA\nb\tno\tq\n")
    df, _ = load_records(spark, tmp_path / "x.tsv")
    assert [tuple(r) for r in df.collect()] == [("0001", 2.5, None), ("b", None, "q")]
    assert coerce_types(spark.createDataFrame([(True, 1)], "mission_success boolean, world_id int")).first() == (1.0, "1")
    for name, error in (("x.xlsx", ValueError), ("none.csv", FileNotFoundError)):
        with pytest.raises(error):
            load_records(spark, tmp_path / name)
    with pytest.raises(ValueError):
        write_records(records, tmp_path / "y.tsv")


def test_command_line(records, tmp_path, capsys):
    data, conf = tmp_path / "r.parquet", tmp_path / "c.yaml"
    write_records(records, data, single=True)
    conf.write_text(config(metrics=[CONFIG["metrics"][0]]).to_yaml())
    assert cli.main(["validate-results", str(data)]) == 0 and cli.main(["validate-results", str(data), "--strict", "--json"]) in (0, 1)
    assert cli.main(["compare", str(data), str(conf), "--json"]) == 0
    assert cli.main(["bootstrap", str(data), str(conf)]) == 0 and cli.main(["ledger", str(data), str(conf)]) == 0
    assert cli.main(["report", str(data), str(conf), "--out", str(tmp_path / "o")]) == 0 and (tmp_path / "o" / "report.md").exists()
    assert cli.main(["schema"]) == cli.main(["metrics"]) == 0
    assert cli.main(["init-config", "--out", str(tmp_path / "a.yaml")]) == 0 and cli.main(["init-config", "--out", str(tmp_path / "a.yaml")]) == 1
    assert sf.load_config(tmp_path / "a.yaml").metrics[0].name == "mean_loss"
    assert cli.main(["synth", "--out", str(tmp_path / "s.csv")]) == 0 and cli.main(["synth", "--scenario", "none"]) == 2
    assert cli.main(["compare", str(tmp_path / "missing.csv"), str(conf)]) == 2 and cli.main(["nothing"]) == 2
    assert cli.main(["redteam", "--scenario", "uncorrected_family"]) == 0
    capsys.readouterr()


def test_scaled_source(spark):
    df = scaled(spark, 40, shift=1.0)
    assert df.count() == 40 * 3 * 10 * 2 and sf.validate_records(df).ok
    assert df.repartition(3).agg(F.round(F.sum("loss"), 6)).first() == scaled(spark, 40, shift=1.0, partitions=2).agg(F.round(F.sum("loss"), 6)).first()


@pytest.mark.parametrize("name", list(scenarios.SCENARIOS))
def test_scenarios(spark, name):
    found = scenarios.SCENARIOS[name](spark, scenarios.SEED)
    assert found.trap and found.defence, found.facts


@pytest.mark.parametrize("name", [m.name for m in mutation.MUTANTS])
def test_mutants(spark, name):
    assert mutation.audit(spark, [name]) == {name: True}
