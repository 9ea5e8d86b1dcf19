"""Registered queries of the evaluation engine, each with the SQL that says the same.

Doubles are rounded to six places on both sides: sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stratafold.config import AggregationSpec, FilterSpec, Margin, MetricSpec, MissingDataSpec, config_from_mapping
from stratafold.functions import decisions, estimators
from stratafold.hierarchy import InferenceSpec, nesting_relations
from stratafold.operators import failures, pairing, prepare, resample, rollup, strata, validate
from stratafold.operators.multiplicity import multiplicity_sql
from stratafold.plans.compare import compare_by_stratum, compare_policies
from stratafold.scratch import shared_root
from stratafold.sources.records import coerce_types, scan
from stratafold.views import INCOMPLETE_SQL, LINES_SQL, RECORDS_SQL, event_records, incomplete_records, line_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SPEC = InferenceSpec()
LINES = InferenceSpec("world_id", ("event_id",))
BASE, CAND = "click", "view"
SEED, RESAMPLES = 7, 200
STATUS = MissingDataSpec(status_handling={"crashed": "failure", "timeout": "failure"})


def query(sql: str, source: str = RECORDS_SQL) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH RECURSIVE {source}{sql}" if sql.startswith(",") else f"WITH RECURSIVE {source} {sql}"
        return f

    return add


def rounded(df: DataFrame, places: int = 6, nudge: float = 0.0) -> DataFrame:
    """nudge: added before rounding where values may lie just between two roundings."""
    return df.select(*(F.round(F.col(c) + nudge, places).alias(c) if isinstance(df.schema[c].dataType, DoubleType) else F.col(c) for c in df.columns))


# Scans and sinks


def _copied(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = event_records(spark, sf_dir).select("world_id", "policy_id", "resident_id", "loss", "failure_reason")
    path = f"{shared_root(spark)}/copy-{kind}-{abs(hash(sf_dir))}"
    out = rows.write.mode("overwrite")
    if kind in ("csv", "tsv"):
        out.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    elif kind == "jsonl":
        out.json(path)
    else:
        out.parquet(path)
    back = coerce_types(scan(spark, path, kind))
    return rounded(back.select("world_id", "policy_id", "resident_id", "loss", F.nullif("failure_reason", F.lit("")).alias("failure_reason")))


_COPY = "SELECT world_id, policy_id, resident_id, round(loss, 6) AS loss, nullif(failure_reason, '') AS failure_reason FROM records"


@query(_COPY)
def s1_scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copied(spark, sf_dir, "parquet")


@query(_COPY)
def s2_scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copied(spark, sf_dir, "csv")


@query(_COPY)
def s3_scan_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copied(spark, sf_dir, "tsv")


@query(_COPY)
def s4_scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copied(spark, sf_dir, "jsonl")


@query("SELECT resident_id, CASE WHEN loss IS NULL THEN NULL WHEN length(resident_id) % 2 = 0 THEN NULL ELSE round(loss, 6) END AS loss FROM records")
def s6_coerce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.length("resident_id") % 2 == 0, F.lit("no number")).otherwise(F.concat(F.lit(" "), F.col("loss").cast("string")))
    return rounded(coerce_types(event_records(spark, sf_dir).select("resident_id", text.alias("loss"))))


# Filters

_FILTERS = FilterSpec({"policy_id": ("click", "view", "purchase")}, {"regime": ("g1",)}, {"high loss": "loss > 90"})


@query("SELECT count(*) AS rows, count(DISTINCT world_id) AS units, round(sum(loss), 6) AS total FROM records WHERE policy_id IN ('click', 'view')")
def f1_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prepare.filtered(event_records(spark, sf_dir), FilterSpec(include={"policy_id": ("click", "view")})).agg(F.count("*").alias("rows"), F.countDistinct("world_id").alias("units"), F.sum("loss").alias("total")))


@query("SELECT count(*) AS rows, count(regime) AS known FROM records WHERE regime IS NULL OR regime NOT IN ('g1')")
def f2_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.filtered(event_records(spark, sf_dir), FilterSpec(exclude={"regime": ("g1",)})).agg(F.count("*").alias("rows"), F.count("regime").alias("known"))


@query("SELECT count(*) AS rows FROM records WHERE NOT coalesce(loss > 90, false)")
def f3_named_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.filtered(event_records(spark, sf_dir), FilterSpec(exclusions={"high loss": "loss > 90"})).agg(F.count("*").alias("rows"))


@query(""", a AS (SELECT * FROM records WHERE policy_id IN ('click', 'view', 'purchase')), b AS (SELECT * FROM a WHERE regime IS NULL OR regime <> 'g1'), c AS (SELECT * FROM b WHERE NOT coalesce(loss > 90, false)),
 n AS (SELECT 0 AS k, count(*) AS r, count(DISTINCT world_id) AS u FROM records UNION ALL SELECT 1, count(*), count(DISTINCT world_id) FROM a UNION ALL SELECT 2, count(*), count(DISTINCT world_id) FROM b UNION ALL SELECT 3, count(*), count(DISTINCT world_id) FROM c)
 SELECT y.k AS step, CASE y.k WHEN 1 THEN 'include policy_id' WHEN 2 THEN 'exclude regime' ELSE 'high loss' END AS filter, x.r AS rows_before, y.r AS rows_after, x.u AS units_before, y.u AS units_after FROM n x JOIN n y ON y.k = x.k + 1""")
def f5_filter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.filter_log(event_records(spark, sf_dir), _FILTERS, "world_id")


@query("SELECT policy_id, count(*) AS rows FROM records WHERE loss IS NOT NULL AND loss >= 10 GROUP BY policy_id")
def f7_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_records(spark, sf_dir)
    odd = F.when(F.col("loss") < 10, F.lit(float("inf"))).otherwise(F.col("loss"))
    return rows.where(estimators.finite(odd).isNotNull()).groupBy("policy_id").agg(F.count("*").alias("rows"))


# Run status and missing values

_HANDLING = "CASE coalesce(run_status, 'unspecified') WHEN 'completed' THEN 'completed' WHEN 'crashed' THEN 'failure' WHEN 'timeout' THEN 'failure' WHEN 'infeasible' THEN 'excluded_documented' WHEN 'excluded' THEN 'excluded_documented' ELSE 'missing' END"
_READY = f", handled AS (SELECT *, {_HANDLING} AS h FROM records), ready AS (SELECT * EXCLUDE (h, mission_success, failure_reason), CASE WHEN h = 'failure' THEN 0.0::DOUBLE ELSE mission_success END AS mission_success, CASE WHEN h = 'failure' AND coalesce(trim(failure_reason), '') = '' THEN 'run_' || coalesce(run_status, 'unspecified') ELSE failure_reason END AS failure_reason FROM handled WHERE h <> 'excluded_documented')"


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.with_status(event_records(spark, sf_dir), STATUS)


@query(f"SELECT policy_id, coalesce(run_status, 'unspecified') AS status, {_HANDLING} AS handling, count(*) AS rows, count(DISTINCT world_id) AS units FROM records GROUP BY 1, 2, 3")
def r1_status_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.run_status_ledger(event_records(spark, sf_dir), STATUS, "world_id")


@query(_READY + " SELECT resident_id, run_status, mission_success, failure_reason FROM ready")
def r3_status_handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(spark, sf_dir).select("resident_id", "run_status", "mission_success", "failure_reason")


@query(f"SELECT count(*) FILTER (h = 'completed') AS n_completed, count(*) FILTER (h = 'failure') AS n_failure, count(*) FILTER (h = 'missing') AS n_missing, count(*) FILTER (h = 'excluded_documented') AS n_excluded FROM (SELECT {_HANDLING} AS h FROM records)")
def r5_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.status_counts(event_records(spark, sf_dir), STATUS)


def _missing(policy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = prepare.with_missing_policy(event_records(spark, sf_dir), "loss", policy)
        return rounded(rows.groupBy("policy_id").agg(F.count("*").alias("rows"), F.sum("loss").alias("total")))

    return run


for _name, _policy, _fill in (("r6_drop_record", "drop_record", None), ("r8_impute_worst", "impute_worst", "max"), ("r8_impute_best", "impute_best", "min")):
    QUERIES[_name] = _missing(_policy)
    _value = "loss" if _fill is None else f"coalesce(loss, (SELECT {_fill}(loss) FROM records))"
    SQL[_name] = f"WITH {RECORDS_SQL} SELECT policy_id, count({_value}) AS rows, round(sum({_value}), 6) AS total FROM records GROUP BY policy_id"


@query("SELECT policy_id, count(*) - count(loss) AS missing, count(*) AS rows FROM records GROUP BY policy_id")
def r9_missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.missing_counts(event_records(spark, sf_dir), "loss")


# Roll-up

_RULE_SQL = {"mean": "avg(v)", "sum": "coalesce(sum(v), 0.0)", "median": "quantile_cont(v, 0.5)", "max": "max(v)", "min": "min(v)", "any": "max(v)", "all": "min(v)", "first": "arg_min(v, k) FILTER (v IS NOT NULL)"}


def _rolled(rule: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(rollup.aggregate_to_level(event_records(spark, sf_dir), SPEC, ["loss", "mission_success"], "world_id", AggregationSpec(default_rule=rule)))

    return run


for _rule, _agg in _RULE_SQL.items():
    _name = f"a_rollup_{_rule}"
    QUERIES[_name] = _rolled(_rule)
    _one = {c: _agg.replace("(v", f"({c}").replace("v IS", f"{c} IS").replace("v,", f"{c},") for c in ("loss", "mission_success")}
    _step = lambda k: ", ".join(f"{e.replace(', k)', f', {k})')} AS {c}" for c, e in _one.items())
    SQL[_name] = f"WITH {RECORDS_SQL}, e AS (SELECT world_id, event_id, policy_id, {_step('resident_id')} FROM records GROUP BY ALL), w AS (SELECT world_id, policy_id, {_step('event_id')} FROM e GROUP BY ALL) SELECT world_id, policy_id, round(loss, 6) AS loss, round(mission_success, 6) AS mission_success FROM w"


@query("SELECT world_id, event_id, policy_id, resident_id, round(loss, 6) AS loss FROM records")
def a2_finest_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.aggregate_to_level(event_records(spark, sf_dir), SPEC, ["loss"], "resident_id"))


@query("SELECT world_id AS unit, policy_id, count(DISTINCT event_id) AS n_event_id, count(DISTINCT resident_id) AS n_resident_id, count(*) AS n_rows FROM records GROUP BY 1, 2")
def a9_nesting_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.nesting_counts(event_records(spark, sf_dir), SPEC)


@query("SELECT world_id AS unit, policy_id, round(avg(loss), 6) AS value, event_id AS sub, world_id || chr(31) || event_id AS label, stratum FROM records GROUP BY world_id, event_id, policy_id, stratum")
def a10_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.panel(event_records(spark, sf_dir), SPEC, "loss", "event_id", carried=["stratum"]))


@query(", o AS (SELECT world_id, event_id, policy_id, avg(loss) AS loss, coalesce(sum(resource_use), 0.0) AS resource_use FROM lines GROUP BY ALL) SELECT world_id, policy_id, round(avg(loss) + 3e-8, 6) AS loss, round(avg(resource_use) + 3e-8, 6) AS resource_use FROM o GROUP BY ALL", LINES_SQL)
def a_rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = AggregationSpec({"line->event_id": {"resource_use": "sum"}})
    spec = InferenceSpec("world_id", ("event_id", "line"))
    rows = line_records(spark, sf_dir).withColumn("line", F.lit("l"))
    return rounded(rollup.aggregate_to_level(rows, spec, ["loss", "resource_use"], "world_id", rules), nudge=3e-8)


# Estimators

_ESTIMATOR_SQL = {
    "mean": ({}, "avg(v)"),
    "rate": ({}, "avg(v)"),
    "sum": ({}, "sum(v)"),
    "median": ({}, "quantile_cont(v, 0.5)"),
    "std": ({}, "stddev_samp(v)"),
    "quantile": ({"q": 0.9}, "quantile_cont(v, 0.9)"),
    "cvar": ({"alpha": 0.9, "tail": "upper"}, "avg(v) FILTER (n - rank < greatest(1, ceil(round((1 - 0.9::DOUBLE) * n, 9))))"),
    "trimmed_mean": ({"trim": 0.1}, "avg(v) FILTER (rank > floor(0.1::DOUBLE * n) AND rank <= n - floor(0.1::DOUBLE * n))"),
    "p_exceed": ({"threshold": 50.0}, "avg((v > 50)::INT::DOUBLE)"),
    "max": ({}, "max(v)"),
    "min": ({}, "min(v)"),
    "count": ({}, "count(v)::DOUBLE"),
}


def _estimated(name: str, params: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(estimators.estimate_by(event_records(spark, sf_dir), ["policy_id"], "loss", name, **params))

    return run


for _kind, (_params, _agg) in _ESTIMATOR_SQL.items():
    QUERIES[f"e_{_kind}"] = _estimated(_kind, _params)
    SQL[f"e_{_kind}"] = f"WITH {RECORDS_SQL}, x AS (SELECT policy_id, loss AS v, row_number() OVER (PARTITION BY policy_id ORDER BY loss) AS rank, count(*) OVER (PARTITION BY policy_id) AS n FROM records WHERE loss IS NOT NULL) SELECT policy_id, round({_agg}, 6) AS estimate FROM x GROUP BY policy_id"


def _custom(values, weights) -> float:  # noqa: ANN001
    return float(((values * weights).sum() / weights.sum()) ** 2)


@query("SELECT policy_id, round(avg(loss) * avg(loss), 6) AS estimate FROM records GROUP BY policy_id")
def e13_custom_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    if "squared_mean" not in estimators.REGISTRY:
        estimators.register_estimator("squared_mean", definition="square of the mean", plain=lambda: lambda v: F.pow(F.avg(v), F.lit(2.0)))(lambda: _custom)
    return rounded(estimators.estimate_by(event_records(spark, sf_dir), ["policy_id"], "loss", "squared_mean"))


@query(", x AS (SELECT policy_id, loss AS v, row_number() OVER (PARTITION BY policy_id ORDER BY loss) AS rank, count(*) OVER (PARTITION BY policy_id) AS n FROM lines) SELECT policy_id, round(avg(v) FILTER (n - rank < greatest(1, ceil(round((1 - 0.95::DOUBLE) * n, 9)))), 4) AS estimate FROM x GROUP BY policy_id", LINES_SQL)
def e7_cvar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.estimate_by(line_records(spark, sf_dir), ["policy_id"], "loss", "cvar", alpha=0.95), 4)


# Pairing

_BOTH = f", both_arms AS (SELECT world_id FROM records WHERE policy_id IN ('{BASE}', 'purchase') AND loss IS NOT NULL GROUP BY world_id HAVING count(DISTINCT policy_id) = 2)"


def _panel(spark: SparkSession, sf_dir: str, level: str = "event_id", records: Callable[[SparkSession, str], DataFrame] = event_records) -> DataFrame:
    return rollup.panel(prepare.with_missing_policy(records(spark, sf_dir), "loss", "drop_record"), SPEC, "loss", level)


@query(_BOTH + " SELECT world_id AS unit FROM both_arms", INCOMPLETE_SQL)
def j1_shared_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.shared_units(_panel(spark, sf_dir, records=incomplete_records), [BASE, "purchase"])


@query(f", own AS (SELECT DISTINCT policy_id, world_id FROM records WHERE policy_id IN ('{BASE}', 'purchase') AND loss IS NOT NULL) SELECT p.policy_id, u.world_id AS unit FROM (SELECT DISTINCT world_id FROM own) u CROSS JOIN (SELECT DISTINCT policy_id FROM own) p ANTI JOIN own o ON o.policy_id = p.policy_id AND o.world_id = u.world_id", INCOMPLETE_SQL)
def j2_dropped_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.dropped_units(_panel(spark, sf_dir, records=incomplete_records), [BASE, "purchase"])


@query(_BOTH + f" SELECT world_id AS unit, policy_id, round(avg(loss), 6) AS value, event_id AS sub FROM records WHERE world_id IN (SELECT world_id FROM both_arms) AND policy_id IN ('{BASE}', 'purchase') AND loss IS NOT NULL GROUP BY world_id, event_id, policy_id", INCOMPLETE_SQL)
def p1_paired_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairing.build_paired_panel(_panel(spark, sf_dir, records=incomplete_records), [BASE, "purchase"]).rows.select("unit", "policy_id", "value", "sub"))


@query("SELECT world_id AS unit, policy_id, round(avg(loss), 6) AS estimate FROM records WHERE loss IS NOT NULL GROUP BY 1, 2")
def p4_per_unit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairing.per_unit_statistics(_panel(spark, sf_dir, "resident_id")))


@query(f", c AS (SELECT world_id AS unit, count(*) FILTER (policy_id = '{BASE}') AS a, count(*) FILTER (policy_id = '{CAND}') AS b FROM records WHERE loss IS NOT NULL GROUP BY 1) SELECT unit, least(a, b) AS low, greatest(a, b) AS high, round((greatest(a, b) - least(a, b)) / greatest(a, b)::DOUBLE, 6) AS gap, (greatest(a, b) - least(a, b)) / greatest(a, b)::DOUBLE > 0.2::DOUBLE AS flagged FROM c WHERE greatest(a, b) > 0")
def p5_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairing.imbalance(_panel(spark, sf_dir, "resident_id"), [BASE, CAND]))


@query(_BOTH + f", m AS (SELECT policy_id, world_id, avg(loss) AS m FROM records WHERE policy_id IN ('{BASE}', 'purchase') AND loss IS NOT NULL GROUP BY 1, 2), t AS (SELECT m.*, b.world_id IS NOT NULL AS shared FROM m LEFT JOIN both_arms b USING (world_id)), g AS (SELECT policy_id, count(*) FILTER (shared) AS n_shared, count(*) FILTER (NOT shared) AS n_other, avg(m) FILTER (shared) AS mi, avg(m) FILTER (NOT shared) AS mo, var_samp(m) FILTER (shared) AS vi, var_samp(m) FILTER (NOT shared) AS vo FROM t GROUP BY 1) SELECT policy_id, n_shared, n_other, round(mi, 6) AS mean_shared, round(mo, 6) AS mean_other, round(CASE WHEN n_shared >= 2 AND n_other >= 2 AND vi + vo > 0 THEN (mo - mi) / sqrt((vi + vo) / 2) END, 6) AS shift, CASE WHEN n_shared >= 2 AND n_other >= 2 AND vi + vo > 0 THEN abs((mo - mi) / sqrt((vi + vo) / 2)) > 0.2 END AS flagged FROM g", INCOMPLETE_SQL)
def p7_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairing.overlap(_panel(spark, sf_dir, "resident_id", incomplete_records), [BASE, "purchase"]))


# Resampling

_UNITS = ", v AS (SELECT world_id, policy_id, loss FROM records WHERE loss IS NOT NULL AND policy_id IN ('{a}', '{b}')), s AS (SELECT world_id FROM v GROUP BY 1 HAVING count(DISTINCT policy_id) = 2), ix AS (SELECT world_id, row_number() OVER (ORDER BY world_id) - 1 AS unit_ix FROM s), stats AS (SELECT unit_ix, count(*) FILTER (policy_id = '{a}') AS na, sum(loss) FILTER (policy_id = '{a}') AS sa, count(*) FILTER (policy_id = '{b}') AS nb, sum(loss) FILTER (policy_id = '{b}') AS sb FROM v JOIN ix USING (world_id) GROUP BY 1), k AS (SELECT count(*) AS k FROM ix)".format(a=BASE, b=CAND)


def _drawn(n: int, stream: int = 0, name: str = "draws") -> str:
    """name(b, root, unit_ix, w): how often each of n replicates draws each unit of k."""
    return multiplicity_sql(name, SEED, stream, f"SELECT b, 0 AS root, k AS n, k AS c FROM range({n}) t(b), k")


_REPS = ", reps AS (SELECT b, sum(sa * w) / sum(na * w) AS e0, sum(sb * w) / sum(nb * w) AS e1 FROM draws JOIN stats USING (unit_ix) GROUP BY b)"
_BOOT = _UNITS + _drawn(RESAMPLES) + _REPS


def _pair(spark: SparkSession, sf_dir: str, level: str = "resident_id") -> pairing.PairedPanel:
    return pairing.build_paired_panel(_panel(spark, sf_dir, level), [BASE, CAND])


def _replicates(spark: SparkSession, sf_dir: str, streams: Sequence[int] = (0,), n: int = RESAMPLES, estimator: str = "mean", params: dict | None = None) -> DataFrame:
    rows = _pair(spark, sf_dir).rows
    return resample.replicates(rows, (BASE, CAND), estimator, params, seed=SEED, n_resamples=n, streams=streams).where(F.col("b") >= 0)


@query(_UNITS + _drawn(20) + " SELECT b, unit_ix, w FROM draws")
def b1_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draws(spark, SEED, 20, _pair(spark, sf_dir).n_units).where("b >= 0")


@query(_BOOT + " SELECT b, round(e0 + 3e-8, 6) AS e0 FROM reps")
def b2_one_arm_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_replicates(spark, sf_dir).select("b", "e0"), nudge=3e-8)


@query(_BOOT + " SELECT b, round(e0 + 3e-8, 6) AS e0, round(e1 + 3e-8, 6) AS e1, round(e1 - e0 + 3e-8, 6) AS diff FROM reps")
def b3_paired_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_replicates(spark, sf_dir).withColumn("diff", F.col("e1") - F.col("e0")), nudge=3e-8)


@query(_UNITS + _drawn(RESAMPLES) + _drawn(RESAMPLES, 1, "other") + " SELECT x.b, round(x.e0 + 3e-8, 6) AS e0, round(y.e1 + 3e-8, 6) AS e1 FROM (SELECT b, sum(sa * w) / sum(na * w) AS e0 FROM draws JOIN stats USING (unit_ix) GROUP BY b) x JOIN (SELECT b, sum(sb * w) / sum(nb * w) AS e1 FROM other JOIN stats USING (unit_ix) GROUP BY b) y ON x.b = y.b")
def b4_unpaired_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_replicates(spark, sf_dir, (0, 1)), nudge=3e-8)


@query(_BOOT + " SELECT round(quantile_cont(e1 - e0, 0.025), 6) AS low, round(quantile_cont(e1 - e0, 0.975), 6) AS high, round(stddev_samp(e1 - e0), 6) AS se FROM reps")
def b7_percentile_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("e1") - F.col("e0")
    return rounded(_replicates(spark, sf_dir).agg(F.percentile(d, 0.025).alias("low"), F.percentile(d, 0.975).alias("high"), F.stddev_samp(d).alias("se")))


def _difference(spark: SparkSession, sf_dir: str, **options: object) -> resample.BootstrapResult:
    return resample.paired_cluster_bootstrap(_pair(spark, sf_dir, options.pop("level", "resident_id")), n_resamples=RESAMPLES, seed=SEED, **options)["difference"]


def _interval_row(spark: SparkSession, r: resample.BootstrapResult) -> DataFrame:
    row = (round(float(r.estimate), 6), round(float(r.low), 6), round(float(r.high), 6), r.method, r.n_units, round(float(r.p_value), 6) if r.p_value is not None else None)
    return spark.createDataFrame([row], "estimate double, low double, high double, method string, n_units bigint, p_value double")


_POINT = ", point AS (SELECT sum(sb) / sum(nb) - sum(sa) / sum(na) AS d, count(*) AS n FROM stats), q AS (SELECT quantile_cont(e1 - e0, 0.025) AS lo, quantile_cont(e1 - e0, 0.975) AS hi, least(1.0, greatest(2 * least(avg((e1 - e0 <= 0)::INT), avg((e1 - e0 >= 0)::INT)), 1.0 / (count(*) + 1))) AS p FROM reps)"


@query(_BOOT + _POINT + " SELECT round(d, 6) AS estimate, round(2 * d - hi, 6) AS low, round(2 * d - lo, 6) AS high, 'basic' AS method, n AS n_units, round(p, 6) AS p_value FROM point, q")
def b8_basic_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval_row(spark, _difference(spark, sf_dir, method="basic"))


#: Normal distribution function by its series, and its inverse by Newton's steps from 0.
_PHI = "(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum([pow({x}, 2 * j + 1) * sqrt(pi()) / (pow(2, j + 1) * gamma(j + 1.5)) for j in range(80)]))"
_BCA = (
    ", gaps AS (SELECT (SELECT sum(sb) FROM stats) AS tb, (SELECT sum(nb) FROM stats) AS mb, (SELECT sum(sa) FROM stats) AS ta, (SELECT sum(na) FROM stats) AS ma), left_out AS (SELECT (tb - sb) / (mb - nb) - (ta - sa) / (ma - na) AS e FROM stats, gaps),"
    " speed AS (SELECT sum(pow(m - e, 3)) / (6 * pow(sum(pow(m - e, 2)), 1.5)) AS a FROM left_out, (SELECT avg(e) AS m FROM left_out)),"
    " asked AS (SELECT 'bias' AS name, avg((e1 - e0 < d)::INT) AS p FROM reps, point UNION ALL SELECT 'low', 0.025 UNION ALL SELECT 'high', 0.975),"
    " newton AS (SELECT name, p, 0 AS i, 0.0::DOUBLE AS x FROM asked UNION ALL SELECT name, p, i + 1, x - (" + _PHI.format(x="x") + " - p) * sqrt(2 * pi()) * exp(x * x / 2) FROM newton WHERE i < 20),"
    " normal AS (SELECT max(x) FILTER (name = 'bias') AS z, max(x) FILTER (name = 'low') AS l, max(x) FILTER (name = 'high') AS h FROM newton WHERE i = 20),"
    " shifted AS (SELECT z + (z + l) / (1 - a * (z + l)) AS xl, z + (z + h) / (1 - a * (z + h)) AS xh FROM normal, speed),"
    " ends AS (SELECT " + _PHI.format(x="xl") + " AS pl, " + _PHI.format(x="xh") + " AS ph FROM shifted),"
    " listed AS (SELECT list(e1 - e0 ORDER BY e1 - e0) AS v, count(*) - 1 AS m FROM reps), places AS (SELECT v, pl * m AS kl, ph * m AS kh FROM listed, ends)"
)


@query(_BOOT + _POINT + _BCA + " SELECT round(d, 6) AS estimate, round(v[floor(kl)::INT + 1] + (kl - floor(kl)) * (v[ceil(kl)::INT + 1] - v[floor(kl)::INT + 1]), 6) AS low, round(v[floor(kh)::INT + 1] + (kh - floor(kh)) * (v[ceil(kh)::INT + 1] - v[floor(kh)::INT + 1]), 6) AS high, 'bca' AS method, n AS n_units, round(p, 6) AS p_value FROM point, q, places")
def b9_bca_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval_row(spark, _difference(spark, sf_dir, method="bca"))


@query(_UNITS + " SELECT unit_ix, round((sum(sa) OVER () - sa) / (sum(na) OVER () - na), 6) AS e0, round((sum(sb) OVER () - sb) / (sum(nb) OVER () - nb), 6) AS e1 FROM stats")
def b10_jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.leave_one_out(_pair(spark, sf_dir).rows, (BASE, CAND)))


@query(
    _UNITS + ", ev AS (SELECT unit_ix, policy_id, loss AS x FROM v JOIN ix USING (world_id)), o AS (SELECT ix.unit_ix AS out, policy_id, x, row_number() OVER (PARTITION BY ix.unit_ix, policy_id ORDER BY x) AS rank, count(*) OVER (PARTITION BY ix.unit_ix, policy_id) AS n FROM ix JOIN ev ON ev.unit_ix <> ix.unit_ix), c AS (SELECT out, policy_id, avg(x) FILTER (n - rank < greatest(1, ceil(round((1 - 0.9::DOUBLE) * n, 9)))) AS e FROM o GROUP BY 1, 2) SELECT out AS unit_ix, round(max(e) FILTER (policy_id = '" + BASE + "') + 3e-8, 6) AS e0, round(max(e) FILTER (policy_id = '" + CAND + "') + 3e-8, 6) AS e1 FROM c GROUP BY out"
)
def b10_jackknife_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.leave_one_out(_pair(spark, sf_dir).rows, (BASE, CAND), "cvar", {"alpha": 0.9, "tail": "upper"}), nudge=3e-8)


@query(_BOOT + _POINT + " SELECT round(d, 6) AS estimate, round(lo, 6) AS low, round(hi, 6) AS high, 'percentile' AS method, n AS n_units, round(p, 6) AS p_value FROM point, q")
def b11_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval_row(spark, _difference(spark, sf_dir))


@query(_UNITS + _drawn(50) + ", ev AS (SELECT unit_ix, policy_id, loss FROM v JOIN ix USING (world_id)), d AS (SELECT b, policy_id, loss AS x, row_number() OVER (PARTITION BY b, policy_id ORDER BY loss) AS rank, count(*) OVER (PARTITION BY b, policy_id) AS n FROM draws JOIN ev USING (unit_ix), LATERAL (SELECT unnest(range(w)))), c AS (SELECT b, policy_id, avg(x) FILTER (n - rank < greatest(1, ceil(round((1 - 0.9::DOUBLE) * n, 9)))) AS e FROM d GROUP BY 1, 2) SELECT b, round(max(e) FILTER (policy_id = '" + BASE + "') + 3e-8, 6) AS e0, round(max(e) FILTER (policy_id = '" + CAND + "') + 3e-8, 6) AS e1 FROM c GROUP BY b")
def b11_cvar_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_replicates(spark, sf_dir, n=50, estimator="cvar", params={"alpha": 0.9, "tail": "upper"}), nudge=3e-8)


_SUBS = ", ev AS (SELECT world_id, event_id, policy_id, avg(loss) AS x FROM records WHERE loss IS NOT NULL AND policy_id IN ('{a}', '{b}') GROUP BY 1, 2, 3), sub AS (SELECT unit_ix, policy_id, x, row_number() OVER w - 1 AS sub_ix, count(*) OVER (PARTITION BY unit_ix, policy_id) AS n_subs FROM ev JOIN ix USING (world_id) WINDOW w AS (PARTITION BY unit_ix, policy_id ORDER BY event_id))".format(a=BASE, b=CAND)
_TWO_STAGE = (
    ", lists AS (SELECT unit_ix, policy_id, n_subs, row_number() OVER (ORDER BY unit_ix, policy_id) AS list FROM (SELECT DISTINCT unit_ix, policy_id, n_subs FROM sub))"
    + multiplicity_sql("picked", SEED, 2, "SELECT b, list AS root, n_subs AS n, w * n_subs AS c FROM draws JOIN lists USING (unit_ix)", depth=6)
    + f", reps AS (SELECT b, sum(x * w) FILTER (policy_id = '{BASE}') / sum(w) FILTER (policy_id = '{BASE}') AS e0, sum(x * w) FILTER (policy_id = '{CAND}') / sum(w) FILTER (policy_id = '{CAND}') AS e1 FROM (SELECT b, root AS list, unit_ix AS sub_ix, w FROM picked) JOIN lists USING (list) JOIN sub USING (unit_ix, policy_id, sub_ix) GROUP BY b)"
)
_ENDS = ", q AS (SELECT quantile_cont(e1 - e0, 0.025) AS lo, quantile_cont(e1 - e0, 0.975) AS hi, least(1.0, greatest(2 * least(avg((e1 - e0 <= 0)::INT), avg((e1 - e0 >= 0)::INT)), 1.0 / (count(*) + 1))) AS p FROM reps)"


@query(_UNITS + _SUBS + _drawn(RESAMPLES) + _TWO_STAGE + _ENDS + f" SELECT round((SELECT avg(x) FILTER (policy_id = '{CAND}') - avg(x) FILTER (policy_id = '{BASE}') FROM sub), 6) AS estimate, round(lo, 6) AS low, round(hi, 6) AS high, 'percentile' AS method, k AS n_units, round(p, 6) AS p_value FROM q, k")
def b6_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval_row(spark, _difference(spark, sf_dir, level="event_id", hierarchical=True))


@query(f", r AS (SELECT loss, row_number() OVER (ORDER BY world_id || chr(31) || event_id || chr(31) || resident_id) - 1 AS unit_ix FROM records WHERE loss IS NOT NULL AND policy_id = '{BASE}'), k AS (SELECT count(*) AS k FROM r)" + _drawn(100) + ", reps AS (SELECT b, sum(loss * w) / sum(w) AS e0 FROM draws JOIN r USING (unit_ix) GROUP BY b) SELECT round((SELECT avg(loss) FROM r), 6) AS estimate, round(quantile_cont(e0, 0.025), 6) AS low, round(quantile_cont(e0, 0.975), 6) AS high, 'percentile' AS method, (SELECT k FROM k) AS n_units, NULL::DOUBLE AS p_value FROM reps")
def b15_naive_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairing.single_policy_values(_panel(spark, sf_dir, "resident_id"), BASE)
    return _interval_row(spark, resample.naive_iid_bootstrap(rows, n_resamples=100, seed=SEED))


@query(f", u AS (SELECT count(*)::DOUBLE AS n, avg(loss) AS m, coalesce(var_samp(loss) * (count(*) - 1), 0) AS w FROM records WHERE policy_id = '{BASE}' AND loss IS NOT NULL GROUP BY world_id), t AS (SELECT count(*) AS k, sum(n) AS N, sum(n * n) AS nn, sum(n * m) AS s, sum(n * m * m) AS q, sum(w) AS w FROM u), m AS (SELECT *, (q - s * s / N) / (k - 1) AS msb, w / (N - k) AS msw, (N - nn / N) / (k - 1) AS m0 FROM t), i AS (SELECT *, greatest((msb - msw) / m0, 0) / (greatest((msb - msw) / m0, 0) + msw) AS icc FROM m) SELECT k AS n_units, N::BIGINT AS n, round(icc, 6) AS icc, round(1 + (N / k - 1) * icc, 6) AS design_effect, round(N / (1 + (N / k - 1) * icc), 4) AS effective_n FROM i".replace(" AS N,", " AS total,").replace("/ N)", "/ total)").replace("(N - ", "(total - ").replace("(N / k", "(total / k").replace("N::BIGINT", "total::BIGINT").replace("round(N /", "round(total /"))
def b16_design_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = resample.design_effect(pairing.single_policy_values(_panel(spark, sf_dir, "resident_id"), BASE))
    return made.select("n_units", "n", F.round("icc", 6).alias("icc"), F.round("design_effect", 6).alias("design_effect"), F.round("effective_n", 4).alias("effective_n"))


# Decisions

_MARGIN = Margin(3.0, 4.0, source="fixed for the query")


@query(_BOOT + ", q AS (SELECT quantile_cont(e1 - e0, 0.05) AS lo, quantile_cont(e1 - e0, 0.95) AS hi, greatest(greatest(avg((e1 - e0 <= -3)::INT), 1.0 / (count(*) + 1)), greatest(avg((e1 - e0 >= 4)::INT), 1.0 / (count(*) + 1))) AS p FROM reps) SELECT CASE WHEN lo > -3 AND hi < 4 THEN 'equivalent' WHEN lo >= 4 OR hi <= -3 THEN 'outside_margin' ELSE 'inconclusive' END AS conclusion, round(lo, 6) AS low, round(hi, 6) AS high, round(p, 6) AS p_value FROM q")
def q1_tost(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decisions.tost(_difference(spark, sf_dir).replicates, _MARGIN)
    return spark.createDataFrame([(r.conclusion, round(r.low, 6), round(r.high, 6), round(r.p_value, 6))], "conclusion string, low double, high double, p_value double")


@query(_BOOT + ", q AS (SELECT quantile_cont(e1 - e0, 0.95) AS hi, greatest(avg((e1 - e0 >= 4)::INT), 1.0 / (count(*) + 1)) AS p FROM reps) SELECT CASE WHEN hi < 4 THEN 'non_inferior' ELSE 'not_shown' END AS conclusion, round(hi, 6) AS bound, round(p, 6) AS p_value FROM q")
def q3_non_inferiority(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decisions.non_inferiority(_difference(spark, sf_dir).replicates, _MARGIN, "lower_is_better")
    return spark.createDataFrame([(r.conclusion, round(r.high, 6), round(r.p_value, 6))], "conclusion string, bound double, p_value double")


@query(_BOOT + _POINT + ", t AS (SELECT quantile_cont(e1 - e0, 0.05) > -3 AND quantile_cont(e1 - e0, 0.95) < 4 AS same FROM reps) SELECT CASE WHEN (lo > 0 OR hi < 0) AND same THEN 'statistically_different_within_margin' WHEN lo > 0 OR hi < 0 THEN CASE WHEN d < 0 THEN 'superior' ELSE 'worse' END WHEN same THEN 'statistically_equivalent' ELSE 'inconclusive' END AS verdict FROM point, q, t")
def q5_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _difference(spark, sf_dir)
    verdict, _ = decisions.classify_difference(d.estimate, d.low, d.high, MetricSpec("loss", "loss"), decisions.tost(d.replicates, _MARGIN))
    return spark.createDataFrame([(verdict,)], "verdict string")


_TESTS = "SELECT policy_id AS family, stratum AS test, CASE WHEN stratum = 's3' THEN NULL ELSE round(avg((loss > 50)::INT) * avg((loss > 80)::INT), 9) END AS p_value FROM records GROUP BY 1, 2"


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda x: F.avg((F.col("loss") > x).cast("int"))
    made = event_records(spark, sf_dir).groupBy(F.col("policy_id").alias("family"), F.col("stratum").alias("test")).agg(F.round(share(50) * share(80), 9).alias("p"))
    return made.select("family", "test", F.when(F.col("test") != "s3", F.col("p")).alias("p_value"))


@query(f", t AS ({_TESTS}), r AS (SELECT *, count(p_value) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family, p_value IS NULL ORDER BY p_value, test) - 1 AS k FROM t), s AS (SELECT *, least(1.0, (m - k) * p_value) AS step FROM r) SELECT family, test, p_value, CASE WHEN p_value IS NOT NULL THEN round(max(step) OVER (PARTITION BY family, p_value IS NULL ORDER BY p_value, test ROWS UNBOUNDED PRECEDING), 8) END AS p_adjusted FROM s")
def m1_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decisions.adjusted(_tests(spark, sf_dir), "holm")
    return made.withColumn("p_adjusted", F.round("p_adjusted", 8))


@query(f", t AS ({_TESTS}) SELECT family, test, p_value, round(least(1.0, count(p_value) OVER (PARTITION BY family) * p_value), 8) AS p_adjusted FROM t WHERE p_value IS NOT NULL UNION ALL SELECT family, test, p_value, NULL FROM t WHERE p_value IS NULL")
def m2_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decisions.adjusted(_tests(spark, sf_dir), "bonferroni")
    return made.withColumn("p_adjusted", F.round("p_adjusted", 8))


_Z = 1.959963984540054


@query(f", c AS (SELECT policy_id, count(*) FILTER (mission_success = 1) AS hits, count(mission_success) AS n FROM records GROUP BY 1), w AS (SELECT *, hits / n::DOUBLE AS p FROM c) SELECT policy_id, hits, n, round(greatest(0, (p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 6) AS low, round(least(1, (p + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 6) AS high FROM w")
def c2_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_records(spark, sf_dir).groupBy("policy_id").agg(F.count_if(F.col("mission_success") == 1).alias("hits"), F.count("mission_success").alias("n"))
    low, high = decisions.wilson_columns(F.col("hits"), F.col("n"))
    return rounded(c.select("policy_id", "hits", "n", low.alias("low"), high.alias("high")))


# Strata and failures


@query(", c AS (SELECT world_id AS unit, coalesce(regime, '__missing__') AS stratum, count(*) AS n FROM records GROUP BY 1, 2) SELECT unit, stratum FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, stratum) AS k FROM c) WHERE k = 1")
def t1_unit_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.unit_strata(event_records(spark, sf_dir), "world_id", "regime")


_ALLOCATION = ", p AS (SELECT DISTINCT world_id, policy_id, stratum FROM records), a AS (SELECT policy_id, stratum, count(*) AS units, count(*) / sum(count(*)) OVER (PARTITION BY policy_id)::DOUBLE AS share FROM p GROUP BY 1, 2)"


@query(_ALLOCATION + " SELECT policy_id, stratum, units, round(share, 6) AS share FROM a")
def t2_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strata.allocation(event_records(spark, sf_dir), "world_id", "stratum"))


@query(_ALLOCATION + " SELECT stratum, round(max(share) - CASE WHEN count(*) = (SELECT count(DISTINCT policy_id) FROM a) THEN min(share) ELSE 0 END, 6) AS gap FROM a GROUP BY 1")
def t3_allocation_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strata.allocation_balance(event_records(spark, sf_dir), "world_id", "stratum"))


@query(f", own AS (SELECT * FROM records WHERE policy_id IN ('{BASE}', 'purchase')), s AS (SELECT world_id FROM own GROUP BY 1 HAVING count(DISTINCT policy_id) = 2) SELECT policy_id, count(DISTINCT world_id) AS units, count(DISTINCT world_id) FILTER (world_id IN (SELECT world_id FROM s)) AS shared_units, count(*) AS rows, count(DISTINCT event_id) AS n_event_id, count(*) FILTER (mission_success = 0) AS failures, count(DISTINCT world_id) FILTER (world_id NOT IN (SELECT world_id FROM s)) AS unshared_units FROM own GROUP BY 1", INCOMPLETE_SQL)
def t4_allocation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.allocation_ledger(incomplete_records(spark, sf_dir), "world_id", [BASE, "purchase"], ["event_id"])


@query(f", own AS (SELECT DISTINCT world_id, policy_id, stratum FROM records WHERE policy_id IN ('{BASE}', 'purchase')), s AS (SELECT world_id FROM own GROUP BY 1 HAVING count(DISTINCT policy_id) = 2), c AS (SELECT policy_id, stratum, count(*) AS units, count(*) FILTER (world_id IN (SELECT world_id FROM s)) AS shared FROM own GROUP BY 1, 2), f AS (SELECT *, units / sum(units) OVER w::DOUBLE AS x, shared / sum(shared) OVER w::DOUBLE AS y FROM c WINDOW w AS (PARTITION BY policy_id)) SELECT policy_id, stratum, round(x, 6) AS share_all, round(y, 6) AS share_shared, round(y - x, 6) AS shift FROM f", INCOMPLETE_SQL)
def t4_composition_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.composition_shift(incomplete_records(spark, sf_dir), "world_id", "stratum", [BASE, "purchase"])


#: Strata of which some say the same, or nothing.
_STRATA = {"stratum": "stratum", "regime": "regime", "twin": "'t' || stratum", "half": "CASE WHEN stratum IN ('s0', 's1') THEN 'low' ELSE 'high' END", "one": "'x'"}


def _stratum_maps(columns: dict[str, str]) -> str:
    """m: (column, its place, unit, commonest value)."""
    parts = " UNION ALL ".join(f"SELECT world_id AS unit, '{c}' AS c, {k} AS place, coalesce({e}, '__missing__') AS v FROM records" for k, (c, e) in enumerate(columns.items()))
    return f", m AS (SELECT unit, c, place, v FROM (SELECT *, row_number() OVER (PARTITION BY c, unit ORDER BY n DESC, v) AS r FROM (SELECT unit, c, place, v, count(*) AS n FROM ({parts}) GROUP BY 1, 2, 3, 4)) WHERE r = 1)"


_REDUNDANT = """, cells AS (SELECT c, count(*) AS levels, min(n) AS least FROM (SELECT c, v, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
 both_maps AS (SELECT DISTINCT x.c AS a, y.c AS b, x.v AS va, y.v AS vb FROM m x JOIN m y USING (unit) WHERE x.place < y.place),
 partners AS (SELECT a, b, (SELECT max(n) FROM (SELECT count(*) AS n FROM both_maps i WHERE i.a = o.a AND i.b = o.b GROUP BY va)) AS ab, (SELECT max(n) FROM (SELECT count(*) AS n FROM both_maps i WHERE i.a = o.a AND i.b = o.b GROUP BY vb)) AS ba FROM (SELECT DISTINCT a, b FROM both_maps) o),
 redundant AS (SELECT 'warning' AS severity, 'single_level_stratum' AS code, c AS "column", NULL::BIGINT AS "count" FROM cells WHERE levels <= 1
  UNION ALL SELECT 'warning', 'thin_stratum_cell', c, least FROM cells WHERE levels > 1 AND least < 5
  UNION ALL SELECT 'warning', CASE WHEN ab = 1 AND ba = 1 THEN 'identical_strata' ELSE 'nested_strata' END, a, NULL FROM partners WHERE 1 IN (ab, ba))"""


@query(_stratum_maps(_STRATA) + _REDUNDANT + ' SELECT severity, code, "column" FROM redundant')
def t5_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_records(spark, sf_dir).withColumns({c: F.expr(e) for c, e in _STRATA.items()})
    found = strata.stratum_redundancy(rows, "world_id", list(_STRATA))
    return spark.createDataFrame([(i.severity, i.code, i.column) for i in found], "severity string, code string, column string")


@query(_READY + " SELECT policy_id, count(*) AS observations, count(*) FILTER (mission_success = 0) AS failures FROM ready GROUP BY 1")
def x1_failure_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.failure_totals(_ready(spark, sf_dir))


_REASON = "CASE WHEN length(trim(failure_reason)) > 0 THEN failure_reason ELSE 'unspecified' END"


@query(_READY + f", c AS (SELECT policy_id, {_REASON} AS reason, count(*) FILTER (mission_success = 0) AS failures, count(*) AS n FROM ready GROUP BY 1, 2), t AS (SELECT *, sum(failures) OVER w AS total, sum(n) OVER w AS observations FROM c WINDOW w AS (PARTITION BY policy_id)) SELECT policy_id, reason, failures, round(failures / total::DOUBLE, 6) AS share_of_failures, round(failures / observations::DOUBLE, 6) AS rate FROM t WHERE failures > 0")
def x2_failure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(failures.failure_table(_ready(spark, sf_dir)))


@query(_READY + f", own AS (SELECT world_id, policy_id, mission_success, {_REASON} AS reason FROM ready WHERE policy_id IN ('{BASE}', 'purchase')), n AS (SELECT world_id, policy_id, count(*) AS n FROM own GROUP BY 1, 2), s AS (SELECT world_id FROM n GROUP BY 1 HAVING count(*) = 2), r AS (SELECT DISTINCT reason FROM own JOIN s USING (world_id) WHERE mission_success = 0), g AS (SELECT n.world_id, n.policy_id, r.reason, n.n FROM n JOIN s USING (world_id) CROSS JOIN r), k AS (SELECT world_id, policy_id, reason, count(*) AS k FROM own WHERE mission_success = 0 GROUP BY 1, 2, 3), x AS (SELECT g.*, coalesce(k.k, 0) / g.n::DOUBLE AS rate FROM g LEFT JOIN k USING (world_id, policy_id, reason)) SELECT reason, round(avg(rate) FILTER (policy_id = '{BASE}'), 6) AS baseline_rate, round(avg(rate) FILTER (policy_id = 'purchase'), 6) AS candidate_rate, round(avg(rate) FILTER (policy_id = 'purchase') - avg(rate) FILTER (policy_id = '{BASE}'), 6) AS shift, count(DISTINCT world_id) AS n_units FROM x GROUP BY reason")
def x3_failure_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(failures.failure_shifts(_ready(spark, sf_dir), "world_id", BASE, "purchase"))


# Validation


def _facts_sql(columns: dict[str, bool]) -> str:
    number = lambda c: f"CAST({c} AS DOUBLE)"
    one = lambda c, numeric: f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, 0::BIGINT AS infinite, " + (f"count(*) FILTER ({c} NOT IN (0, 1)) AS non_binary, round(min({number(c)}), 6) AS least, round(max({number(c)}), 6) AS largest" if numeric else "0::BIGINT AS non_binary, NULL::DOUBLE AS least, NULL::DOUBLE AS largest") + " FROM records"
    return " UNION ALL ".join(one(c, n) for c, n in columns.items())


@query(_facts_sql({"world_id": False, "policy_id": False, "mission_success": True, "loss": True, "failure_reason": False}))
def v_column_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validate.column_facts(event_records(spark, sf_dir), ["world_id", "policy_id", "mission_success", "loss", "failure_reason"]))


@query("SELECT world_id, event_id, policy_id, count(*) AS n FROM records GROUP BY 1, 2, 3 HAVING count(*) > 1")
def v_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicates(event_records(spark, sf_dir), ["world_id", "event_id", "policy_id"])


@query("SELECT regime, count(DISTINCT stratum) AS n FROM records WHERE regime IS NOT NULL GROUP BY 1 HAVING count(DISTINCT stratum) > 1")
def v_broken_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.broken_nesting(event_records(spark, sf_dir), "regime", "stratum")


@query(", p AS (SELECT world_id, count(DISTINCT policy_id) AS k FROM records GROUP BY 1), n AS (SELECT count(DISTINCT policy_id) AS n FROM records) SELECT count(*) AS units, count(*) FILTER (k = n) AS common, max(n) AS policies FROM p, n")
def v_policy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.policy_coverage(event_records(spark, sf_dir), "world_id")


_REPORT = """, arms AS (SELECT world_id, count(DISTINCT policy_id) AS n FROM records GROUP BY 1), facts AS (SELECT count(*) AS units, count(*) FILTER (n = (SELECT count(DISTINCT policy_id) FROM records)) AS common FROM arms),
 varying AS (SELECT 'stratum' AS c, count(*) AS n FROM (SELECT world_id FROM records GROUP BY 1 HAVING count(DISTINCT coalesce(stratum, '__missing__')) > 1) UNION ALL SELECT 'regime', count(*) FROM (SELECT world_id FROM records GROUP BY 1 HAVING count(DISTINCT coalesce(regime, '__missing__')) > 1)),
 absent AS (SELECT 'mission_success' AS c, count(*) - count(mission_success) AS n FROM records UNION ALL SELECT 'loss', count(*) - count(loss) FROM records UNION ALL SELECT 'travel_time', count(*) - count(travel_time) FROM records)
 SELECT * FROM redundant
 UNION ALL SELECT 'info', code, NULL, NULL FROM (VALUES ('extra_columns'), ('absent_optional_columns'), ('run_status_present'), ('nesting_ratio')) t(code)
 UNION ALL SELECT 'error', 'outcome_used_as_stratum', 'loss', NULL
 UNION ALL SELECT 'warning', 'missing_outcome', c, n FROM absent WHERE n > 0
 UNION ALL SELECT 'warning', 'incomplete_runs', 'run_status', n FROM (SELECT count(*) FILTER (run_status IS DISTINCT FROM 'completed') AS n FROM records) WHERE n > 0
 UNION ALL SELECT 'warning', 'failure_without_reason', 'failure_reason', n FROM (SELECT count(*) FILTER (mission_success = 0 AND coalesce(trim(failure_reason), '') = '') AS n FROM records) WHERE n > 0
 UNION ALL SELECT 'warning', 'success_with_failure_reason', 'failure_reason', n FROM (SELECT count(*) FILTER (mission_success = 1 AND coalesce(trim(failure_reason), '') <> '') AS n FROM records) WHERE n > 0
 UNION ALL SELECT 'warning', 'stratum_varies_within_unit', c, n FROM varying WHERE n > 0
 UNION ALL SELECT 'warning', 'null_stratum', 'regime', n FROM (SELECT count(*) - count(regime) AS n FROM records) WHERE n > 0
 UNION ALL SELECT 'warning', 'few_units', NULL, units FROM facts WHERE units BETWEEN 2 AND 19
 UNION ALL SELECT 'warning', 'unbalanced_policy_coverage', NULL, units - common FROM facts WHERE common BETWEEN 1 AND units - 1
 UNION ALL SELECT 'error', 'no_common_units', NULL, NULL FROM facts WHERE common = 0"""


@query(_stratum_maps({"stratum": "stratum", "regime": "regime"}) + _REDUNDANT + _REPORT)
def v_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = validate.validate_records(event_records(spark, sf_dir), SPEC, ["stratum", "regime", "loss"])
    return spark.createDataFrame([(i.severity, i.code, i.column, i.count) for i in report.issues], "severity string, code string, column string, count bigint")


# Whole comparisons

_MARGINS = {"mean_loss": {"lower": 3.0, "upper": 4.0, "source": "fixed for the query"}}


def query_config(n_resamples: int = RESAMPLES) -> dict:
    return {
        "inference": {"primary_unit": "world_id", "nested_units": ["event_id", "resident_id"]},
        "metrics": [{"name": "mean_loss", "column": "loss", "level": "resident_id", "role": "primary"}, {"name": "cvar_loss", "column": "loss", "estimator": "cvar", "level": "event_id"}],
        "comparison": {"baseline": BASE, "candidates": [CAND]},
        "bootstrap": {"n_resamples": n_resamples, "seed": SEED},
        "equivalence": {"margins": _MARGINS},
    }


@query(_BOOT + _POINT + f", t AS (SELECT quantile_cont(e1 - e0, 0.05) > -3 AND quantile_cont(e1 - e0, 0.95) < 4 AS same FROM reps), e AS (SELECT sum(sa) / sum(na) AS a, sum(sb) / sum(nb) AS b FROM stats) SELECT 'mean_loss' AS metric, '{BASE}' AS baseline, '{CAND}' AS candidate, n AS n_units, round(a, 6) AS baseline_estimate, round(b, 6) AS candidate_estimate, round(d, 6) AS difference, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(p, 6) AS p_value, CASE WHEN (lo > 0 OR hi < 0) AND same THEN 'statistically_different_within_margin' WHEN lo > 0 OR hi < 0 THEN CASE WHEN d < 0 THEN 'superior' ELSE 'worse' END WHEN same THEN 'statistically_equivalent' ELSE 'inconclusive' END AS verdict FROM point, q, t, e")
def k1_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = config_from_mapping(query_config())
    table = compare_policies(event_records(spark, sf_dir), config, validate=False, metrics=["mean_loss"]).summary_table()
    columns = ["metric", "baseline", "candidate", "n_units", "baseline_estimate", "candidate_estimate", "difference", "ci_low", "ci_high", "p_value", "verdict"]
    return rounded(spark.createDataFrame(table[columns]))


_TAIL = ", tails AS (SELECT b, policy_id, x, row_number() OVER (PARTITION BY b, policy_id ORDER BY x) AS rank, count(*) OVER (PARTITION BY b, policy_id) AS n FROM (SELECT b, unit_ix, w FROM draws UNION ALL SELECT -1, unit_ix, 1 FROM ix) JOIN sub USING (unit_ix), LATERAL (SELECT unnest(range(w)))), means AS (SELECT b, policy_id, avg(x) FILTER (n - rank < greatest(1, ceil(round((1 - 0.9::DOUBLE) * n, 9)))) AS e FROM tails GROUP BY 1, 2), gaps AS (SELECT b, max(e) FILTER (policy_id = '{b}') - max(e) FILTER (policy_id = '{a}') AS gap FROM means GROUP BY b), both_metrics AS (SELECT 'mean_loss' AS metric, d, lo, hi, (SELECT quantile_cont(e1 - e0, 0.05) > -3 AND quantile_cont(e1 - e0, 0.95) < 4 FROM reps) AS same FROM point, q UNION ALL SELECT 'cvar_loss', max(gap) FILTER (b = -1), quantile_cont(gap, 0.025) FILTER (b >= 0), quantile_cont(gap, 0.975) FILTER (b >= 0), false FROM gaps)".format(a=BASE, b=CAND)
_VERDICT = "CASE WHEN (lo > 0 OR hi < 0) AND same THEN 'statistically_different_within_margin' WHEN lo > 0 OR hi < 0 THEN CASE WHEN d < 0 THEN 'superior' ELSE 'worse' END WHEN same THEN 'statistically_equivalent' ELSE 'inconclusive' END"


@query(_UNITS + _SUBS + _drawn(100) + _REPS + _POINT + _TAIL + f" SELECT metric, k AS n_units, round(d, 6) AS difference, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, {_VERDICT} AS verdict, CASE WHEN (lo > 0 OR hi < 0) AND NOT same THEN CASE WHEN d < 0 THEN '{CAND}' ELSE '{BASE}' END ELSE 'neither' END AS favours FROM both_metrics, k")
def k2_compare_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = config_from_mapping(query_config(100))
    table = compare_policies(event_records(spark, sf_dir), config, validate=False).summary_table()
    return rounded(spark.createDataFrame(table[["metric", "n_units", "difference", "ci_low", "ci_high", "verdict", "favours"]]))




# Structure, strata and sources as a whole

_PAIRS = (("world_id", "event_id"), ("world_id", "stratum"), ("event_id", "regime"), ("resident_id", "event_id"))


def _relation_sql(a: str, b: str) -> str:
    most = lambda x, y: f"(SELECT max(n) FROM (SELECT count(DISTINCT {y}) AS n FROM records WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {x}))"
    ab, ba = most(a, b), most(b, a)
    return f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN {ab} = 1 AND {ba} = 1 THEN 'one_to_one' WHEN {ab} = 1 THEN 'a_within_b' WHEN {ba} = 1 THEN 'b_within_a' ELSE 'crossed' END AS relation"


@query(" UNION ALL ".join(_relation_sql(*p) for p in _PAIRS))
def n1_nesting_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nesting_relations(event_records(spark, sf_dir), _PAIRS)
    return spark.createDataFrame([(a, b, found[a, b]) for a, b in _PAIRS], "a string, b string, relation string")


@query("SELECT policy_id, stratum, round(avg(loss), 6) AS mean_loss, count(DISTINCT world_id) AS units FROM records WHERE loss IS NOT NULL GROUP BY 1, 2")
def t6_strata_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.with_missing_policy(event_records(spark, sf_dir), "loss", "drop_record")
    means = estimators.estimate_by(rows, ["policy_id", "stratum"], "loss", "mean").withColumnRenamed("estimate", "mean_loss")
    units = rows.groupBy("policy_id", "stratum").agg(F.countDistinct("world_id").alias("units"))
    return rounded(means.join(units, ["policy_id", "stratum"]))


_STRATIFIED = """, v AS (SELECT g, world_id, policy_id, loss FROM (SELECT '__all__' AS g, world_id, policy_id, loss FROM records UNION ALL SELECT stratum, world_id, policy_id, loss FROM records) WHERE loss IS NOT NULL AND policy_id IN ('{a}', '{b}')),
 s AS (SELECT g, world_id FROM v GROUP BY 1, 2 HAVING count(DISTINCT policy_id) = 2), ix AS (SELECT g, world_id, row_number() OVER (PARTITION BY g ORDER BY world_id) - 1 AS unit_ix FROM s),
 stats AS (SELECT g, unit_ix, count(*) FILTER (policy_id = '{a}') AS na, sum(loss) FILTER (policy_id = '{a}') AS sa, count(*) FILTER (policy_id = '{b}') AS nb, sum(loss) FILTER (policy_id = '{b}') AS sb FROM v JOIN ix USING (g, world_id) GROUP BY 1, 2), k AS (SELECT g, count(*) AS k FROM ix GROUP BY 1)""".format(a=BASE, b=CAND)
_STRATIFIED += multiplicity_sql("draws", SEED, 0, "SELECT g, b, 0 AS root, k AS n, k AS c FROM range(100) t(b), k", "g, b") + """,
 reps AS (SELECT g, b, sum(sb * w) / sum(nb * w) - sum(sa * w) / sum(na * w) AS gap FROM draws JOIN stats USING (g, unit_ix) GROUP BY 1, 2),
 point AS (SELECT g, sum(sb) / sum(nb) - sum(sa) / sum(na) AS d, count(*) AS n FROM stats GROUP BY 1),
 q AS (SELECT g, quantile_cont(gap, 0.025) AS lo, quantile_cont(gap, 0.975) AS hi, quantile_cont(gap, 0.05) > -3 AND quantile_cont(gap, 0.95) < 4 AS same FROM reps GROUP BY 1)"""


@query(_STRATIFIED + f" SELECT g AS stratum, 'mean_loss' AS metric, n AS n_units, round(d, 6) AS difference, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, {_VERDICT} AS verdict FROM point JOIN q USING (g)")
def t6_compare_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = config_from_mapping({**query_config(100), "metrics": query_config()["metrics"][:1]})
    found = compare_by_stratum(event_records(spark, sf_dir), config, "stratum", min_units=2)
    return rounded(spark.createDataFrame(found.summary_table()[["stratum", "metric", "n_units", "difference", "ci_low", "ci_high", "verdict"]]))
