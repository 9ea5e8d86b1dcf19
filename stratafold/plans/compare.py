"""Policy comparison: from records and a configuration to verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.config import AnalysisConfig, Margin, MetricSpec
from stratafold.functions import decisions, estimators, intervals
from stratafold.hierarchy import InferenceStructureError, grouped_structure, require_valid_structure, resolve_unit, without_errors
from stratafold.issues import Issue
from stratafold.jobs import together
from stratafold.operators import pairing, resample
from stratafold.operators.failures import FailureSummary, failure_summaries
from stratafold.operators.prepare import PreparationLog, filter_log, filtered, missing_counts, run_status_ledger, status_logs, with_missing_policy, with_status
from stratafold.operators.rollup import panel
from stratafold.operators.strata import WIDE_GAP, allocation_balance, unit_strata
from stratafold.operators.validate import validate_for_config
from stratafold.provenance import Provenance, provenance_for
from stratafold.scratch import materialize

ROLE_ORDER = {"primary": 0, "secondary": 1, "exploratory": 2}
#: Column that names a row's group; the group of all rows, and what the names of the others begin with.
GROUP = "__group"
WHOLE = "whole"
LEVEL = "level:"
#: Why a group has no comparison.
Refused = InferenceStructureError | pairing.PairingError | resample.BootstrapError
#: Units that every policy shares in a stratum, at least, for a comparison within it.
LEAST_UNITS = 5


@dataclass
class MetricComparison:
    """One metric, one candidate."""

    metric: MetricSpec
    baseline: str
    candidate: str
    base: resample.BootstrapResult
    cand: resample.BootstrapResult
    difference: resample.BootstrapResult
    verdict: str
    favours: str | None
    equivalence: decisions.EquivalenceResult | None
    non_inferiority: decisions.EquivalenceResult | None
    margin: Margin | None
    n_units: int
    coverage: float
    estimand: str
    credible: bool
    notes: list[str] = field(default_factory=list)
    diagnostics: dict[str, Any] = field(default_factory=dict)
    provenance: Provenance | None = None
    p_adjusted: float | None = None

    @property
    def key(self) -> str:
        return f"{self.metric.name}|{self.candidate}_vs_{self.baseline}"

    def row(self) -> dict[str, Any]:
        return {
            "metric": self.metric.name, "role": self.metric.role, "baseline": self.baseline, "candidate": self.candidate, "n_units": self.n_units,
            "baseline_estimate": self.base.estimate, "candidate_estimate": self.cand.estimate, "difference": self.difference.estimate,
            "ci_low": self.difference.low, "ci_high": self.difference.high, "se": self.difference.se, "p_value": self.difference.p_value,
            "p_adjusted": self.p_adjusted, "verdict": self.verdict, "favours": self.favours or "neither",
            "equivalence": self.equivalence.conclusion if self.equivalence else "not tested", "unit_coverage": self.coverage, "credible": self.credible,
        }


@dataclass
class ComparisonResult:
    """All comparisons of an analysis and what led to them."""

    config: AnalysisConfig
    baseline: str
    candidates: list[str]
    comparisons: list[MetricComparison]
    log: PreparationLog
    ledger: list[dict[str, Any]]
    warnings: list[Issue]
    disagreements: list[dict[str, str]] = field(default_factory=list)
    failures: FailureSummary | None = None
    families: dict[str, dict[str, Any]] = field(default_factory=dict)

    def summary_table(self) -> pd.DataFrame:
        rows = sorted(self.comparisons, key=lambda c: ROLE_ORDER[c.metric.role])
        return pd.DataFrame([c.row() for c in rows])


@dataclass
class _Facts:
    """What one metric's comparison of two policies rests on, in one group."""

    panel: pairing.PairedPanel
    made: dict[str, resample.BootstrapResult]
    overlap: list[dict[str, Any]]
    effect: dict[str, dict[str, Any]]
    uneven: dict[str, Any]


def _without(row: dict[str, Any], *names: str) -> dict[str, Any]:
    return {k: v for k, v in row.items() if k not in names}


def _facts(config: AnalysisConfig, metric: MetricSpec, rows: DataFrame, base: str, cand: str) -> dict[str, _Facts | Refused]:
    """By group, all groups in the same jobs.  rows: the metric's panel with the column ``GROUP``."""
    ask, b = config.comparison, config.bootstrap
    panels = pairing.paired_panels(rows, [base, cand], GROUP, ask.require_common_units)
    out: dict[str, _Facts | Refused] = {g: p for g, p in panels.items() if isinstance(p, pairing.PairingError)}
    panels = {g: p for g, p in panels.items() if g not in out}
    if not panels:
        return out
    own = next(iter(panels.values())).rows
    bootstrap = partial(
        resample.grouped_bootstraps, panels, GROUP, metric.estimator, metric.parameters, n_resamples=b.n_resamples, seed=b.seed, confidence_level=b.confidence_level, method=b.method, hierarchical=b.hierarchical, paired=ask.paired
    )
    made, overlaps, effects, uneven = together(
        bootstrap,
        lambda: [r.asDict() for r in pairing.overlap(rows, [base, cand], [GROUP]).collect()],
        lambda: [r.asDict() for r in resample.design_effect(own, [GROUP, "policy_id"]).collect()],
        lambda: pairing.imbalance_reports(own, [base, cand], GROUP, config.missing_data.max_count_imbalance),
    )
    for g, panel_ in panels.items():
        found = made[g]
        out[g] = found if isinstance(found, resample.BootstrapError) else _Facts(
            panel_, found, [_without(r, GROUP) for r in overlaps if r[GROUP] == g], {r["policy_id"]: _without(r, GROUP, "policy_id") for r in effects if r[GROUP] == g}, uneven[g]
        )
    return out


def _one(config: AnalysisConfig, metric: MetricSpec, facts: _Facts, base: str, cand: str, source: Any) -> MetricComparison:
    own, made, gap = facts.panel, facts.made, facts.made["difference"]
    notes = [] if own.paired else ["the policies are compared on different sets of units"]
    for arm, support in ((made["baseline"], (metric.bounds.lower, metric.bounds.upper)), (made["candidate"], (metric.bounds.lower, metric.bounds.upper)), (gap, metric.bounds.of_difference() or (None, None))):
        notes += intervals.outside(arm.low, arm.high, support)
    margin = config.margin_for(metric)
    same = decisions.tost(gap.replicates, margin, config.equivalence.alpha) if margin else None
    safe = decisions.non_inferiority(gap.replicates, margin, metric.direction, config.equivalence.alpha) if metric.name in config.equivalence.non_inferiority else None
    verdict, favours = decisions.classify_difference(gap.estimate, gap.low, gap.high, metric, same)
    credible, why = estimators.credibility(metric.estimator, own.n_units)
    if not credible:
        notes.append(why)
    notes += [f"shared units of {r['policy_id']} are not typical of its units: standardised shift {r['shift']:.2f}" for r in facts.overlap if r["flagged"]]
    if facts.uneven["n_flagged"]:
        notes.append(f"{facts.uneven['n_flagged']} unit(s) have uneven numbers of values")
    out = MetricComparison(metric, base, cand, made["baseline"], made["candidate"], gap, verdict, {"candidate": cand, "baseline": base}.get(favours), same, safe, margin, own.n_units, own.coverage, own.estimand(), credible, [*notes, *gap.notes])
    out.diagnostics = {"overlap": facts.overlap, "design_effect": facts.effect, "imbalance": facts.uneven, "dropped_units": own.dropped}
    out.provenance = provenance_for(config, metric, base, cand, source, gap.method)
    return out


def _families(config: AnalysisConfig, comparisons: list[MetricComparison]) -> dict[str, dict[str, Any]]:
    out = {}
    for role in ROLE_ORDER:
        tests = {c.key: c.difference.p_value for c in comparisons if c.metric.role == role}
        if tests:
            method = config.multiplicity.method(role)
            out[role] = {"method": method, "size": sum(p is not None for p in tests.values()), "p_adjusted": decisions.adjust(tests, method)}
    return out


def detect_disagreements(comparisons: Sequence[MetricComparison]) -> list[dict[str, str]]:
    """Metrics that favour different policies: centre against tail of one column, and any split of a pair."""
    found = []
    told = [c for c in comparisons if c.favours]
    for c in told:
        for t in told:
            pair = c.metric.column == t.metric.column and (c.baseline, c.candidate) == (t.baseline, t.candidate)
            if pair and not estimators.lookup(c.metric.estimator).tail and estimators.lookup(t.metric.estimator).tail and c.favours != t.favours:
                side = "the harmful tail" if t.metric.tail_side == t.metric.harmful_side else f"the {t.metric.tail_side} tail"
                found.append({"kind": "central_vs_tail", "message": f"{c.metric.name} favours {c.favours}, {t.metric.name} ({side} of {t.metric.column}) favours {t.favours}"})
    for pair in sorted({(c.baseline, c.candidate) for c in told}):
        sides = sorted({c.favours for c in told if (c.baseline, c.candidate) == pair})
        if len(sides) > 1:
            found.append({"kind": "metric_split", "message": f"between {pair[0]} and {pair[1]}, metrics favour {' and '.join(sides)}"})
    return found


def compare_policies(records: DataFrame, config: AnalysisConfig, *, validate: bool = True, metrics: Sequence[str] | None = None, source: Any = None) -> ComparisonResult:
    """Validate, prepare, roll up, pair, resample and decide.

    The structure is always checked, on the unfiltered records: filters cannot rescue an
    invalid table.  Prepared rows are written once and read by every metric.
    """
    warnings = require_valid_structure(records, config.inference)
    if validate:
        report = validate_for_config(records, config)
        report.raise_if_invalid()
        warnings = report.warnings
    found = _compare_groups(records.withColumn(GROUP, F.lit(WHOLE)), config, [WHOLE], metrics, source)[WHOLE]
    if isinstance(found, Exception):
        raise found
    found.warnings = warnings
    return found


def _compare_groups(records: DataFrame, config: AnalysisConfig, groups: Sequence[str], metrics: Sequence[str] | None, source: Any) -> dict[str, ComparisonResult | Refused]:
    """The comparison of every group (column ``GROUP``), or why there is none.

    Groups are keys of every aggregate, join and draw: the number of jobs follows metrics and candidates, not groups.
    """
    unit, missing = config.inference.primary_unit, config.missing_data
    kept = filtered(records, config.filters)
    ledger = run_status_ledger(kept, missing, unit, [GROUP]).orderBy(GROUP, "policy_id", "status") if missing.status_column in kept.columns else None
    steps, ledger, status, ready = together(
        lambda: [r.asDict() for r in filter_log(records, config.filters, unit, [GROUP]).orderBy(GROUP, "step").collect()],
        lambda: [r.asDict() for r in ledger.collect()] if ledger is not None else [],
        lambda: status_logs(kept, missing, unit, GROUP),
        lambda: materialize(with_status(kept, missing), "compare-ready"),
    )
    have: dict[str, list[str]] = {}
    for g, policy in sorted((r[0], r[1]) for r in ready.select(GROUP, "policy_id").where("policy_id is not null").distinct().collect()):  # a row for each group and policy
        have.setdefault(g, []).append(policy)
    out: dict[str, ComparisonResult | Refused] = {}
    arms: dict[str, tuple[str, tuple[str, ...]]] = {}
    for g in groups:
        try:
            base, cands = pairing.chosen_policies(have.get(g, []), config.comparison.baseline, config.comparison.candidates)
            arms[g] = base, tuple(cands)
        except pairing.PairingError as e:
            out[g] = e
    chosen = [config.metric(m) for m in metrics] if metrics else sorted(config.metrics, key=lambda m: ROLE_ORDER[m.role])
    pairs = sorted({(base, cand) for base, cands in arms.values() for cand in cands})
    of = lambda rows, own: rows if len(own) == len(groups) else rows.where(F.col(GROUP).isin(own))

    def compared(metric: MetricSpec) -> tuple[dict[str, dict[str, int]], dict[tuple[str, str], dict[str, _Facts | Refused]]]:
        gone: dict[str, dict[str, int]] = {}
        for r in missing_counts(ready, metric.column, [GROUP]).collect():
            gone.setdefault(r[GROUP], {})[r["policy_id"]] = r["missing"]
        rows = with_missing_policy(ready, metric.column, missing.policy, metric.direction == "lower_is_better", [GROUP])
        rolled = materialize(panel(rows, config.inference, metric.column, resolve_unit(metric.level), config.aggregation, [GROUP]), "compare-panel")
        calls = (partial(_facts, config, metric, of(rolled, [g for g, (base, cands) in arms.items() if base == b and c in cands]), b, c) for b, c in pairs)
        return gone, dict(zip(pairs, together(*calls), strict=True))

    kinds = sorted(set(arms.values()))
    tables = (partial(failure_summaries, of(ready, [g for g in arms if arms[g] == kind]), unit, kind[0], list(kind[1]), GROUP, config.failure_column) for kind in kinds)
    found = together(*tables, *(partial(compared, m) for m in chosen))
    failures, told = dict(zip(kinds, found, strict=False)), dict(zip([m.name for m in chosen], found[len(kinds) :], strict=True))
    for g, (base, cands) in arms.items():
        facts = [(m, c, told[m.name][1][base, c].get(g, pairing.PairingError(f"policy {base} has no finite value"))) for m in chosen for c in cands]
        refused = [f for _, _, f in facts if isinstance(f, Exception)]
        if refused:
            out[g] = refused[0]
            continue
        comparisons = [_one(config, m, f, base, c, source) for m, c, f in facts]
        log = PreparationLog([_without(r, GROUP) for r in steps if r[GROUP] == g])
        for name, value in status.get(g, {}).items():
            setattr(log, name, value)
        if chosen:
            log.missing_by_policy = told[chosen[-1].name][0].get(g, {})
        families = _families(config, comparisons)
        for c in comparisons:
            c.p_adjusted = families[c.metric.role]["p_adjusted"][c.key]
        summary = failures[base, cands]
        out[g] = ComparisonResult(config, base, list(cands), comparisons, log, [_without(r, GROUP) for r in ledger if r[GROUP] == g], [], detect_disagreements(comparisons), summary[g] if summary else None, families)
    return out


@dataclass
class StratifiedResult:
    """A comparison overall and within each level of a stratum."""

    column: str
    overall: ComparisonResult
    strata: dict[str, ComparisonResult]
    skipped: dict[str, str]
    disagreements: list[dict[str, str]]
    balance_note: str = ""

    def summary_table(self) -> pd.DataFrame:
        parts = [self.overall.summary_table().assign(stratum="__all__")]
        parts += [r.summary_table().assign(stratum=k) for k, r in sorted(self.strata.items())]
        return pd.concat(parts, ignore_index=True)


def compare_by_stratum(records: DataFrame, config: AnalysisConfig, column: str, *, min_units: int = LEAST_UNITS, source: Any = None, metrics: Sequence[str] | None = None) -> StratifiedResult:
    """The comparison overall and within each level, units assigned to their commonest value: all in the jobs of one comparison."""
    unit = config.inference.primary_unit
    if column not in records.columns:
        raise KeyError(f"stratum column {column} is not in the records")
    warnings = require_valid_structure(records, config.inference)
    level_of = unit_strata(records, unit, column).select(F.col("unit").alias(unit), F.concat(F.lit(LEVEL), "stratum").alias("__level"))
    grouped = records.join(level_of, unit, "left").withColumn(GROUP, F.explode(F.array(F.lit(WHOLE), "__level"))).where(F.col(GROUP).isNotNull()).drop("__level")
    grouped = materialize(grouped, "strata-rows")
    structure = grouped_structure(grouped.where(F.col(GROUP) != WHOLE), config.inference, GROUP)
    arms = grouped.where(F.col("policy_id").isNotNull()).groupBy(GROUP, unit).agg(F.collect_set("policy_id").alias("arms"))
    policies = [config.comparison.baseline, *config.comparison.candidates] if config.comparison.baseline and config.comparison.candidates else None
    if policies is None:
        ready = with_status(filtered(records, config.filters), config.missing_data)
        base, cands = pairing.resolve_policies(ready, config.comparison.baseline, config.comparison.candidates)
        policies = [base, *cands]
    shared = {r[0]: r[1] for r in arms.groupBy(GROUP).agg(F.count_if(F.size(F.array_intersect("arms", F.lit(policies))) == len(set(policies)))).collect()}  # a row for each level
    levels = sorted(g for g in structure if g in shared)
    refused: dict[str, Exception | str] = {g: f"{shared[g]} unit(s) have every policy; {min_units} are needed" for g in levels if shared[g] < min_units}
    for g in levels:
        try:
            without_errors(structure[g])
        except InferenceStructureError as e:
            refused.setdefault(g, e)
    asked = [WHOLE, *(g for g in levels if g not in refused)]
    found = _compare_groups(grouped.where(F.col(GROUP).isin(asked)), config, asked, metrics, source)
    overall = found.pop(WHOLE)
    if isinstance(overall, Exception):
        raise overall
    overall.warnings = warnings
    skipped = {g.removeprefix(LEVEL): str(why) for g, why in [*refused.items(), *((g, r) for g, r in found.items() if isinstance(r, Exception))]}
    done = {}
    for g, made in found.items():
        if not isinstance(made, Exception):
            made.warnings = structure[g]
            done[g.removeprefix(LEVEL)] = made
    gap = allocation_balance(records, unit, column).agg(F.max("gap")).first()[0] or 0.0
    note = f"shares of units in a level of {column} differ by up to {gap:.2f} between policies" if gap > WIDE_GAP else ""
    return StratifiedResult(column, overall, done, skipped, stratum_disagreements(overall, done), note)


def stratum_disagreements(overall: ComparisonResult, strata: dict[str, ComparisonResult]) -> list[dict[str, str]]:
    """Levels that favour different policies, or all favour another one than the whole does."""
    found = []
    for c in overall.comparisons:
        sides = {level: t.favours for level, r in strata.items() for t in r.comparisons if t.key == c.key and t.favours}
        if len(set(sides.values())) > 1:
            found.append({"kind": "strata_differ", "message": f"{c.metric.name}: " + ", ".join(f"{k} favours {v}" for k, v in sorted(sides.items()))})
        elif sides and c.favours and c.favours not in sides.values():
            found.append({"kind": "aggregate_reversed", "message": f"{c.metric.name}: all records favour {c.favours}, every resolved level favours {next(iter(sides.values()))}"})
    return found


def stratified_estimate(result: StratifiedResult, metric: str, weights: dict[str, float] | None = None) -> float:
    """Mean of the levels' differences, weighted by shared units or as given."""
    rows = {level: c for level, r in result.strata.items() for c in r.comparisons if c.metric.name == metric}
    if not rows:
        raise KeyError(f"no level has a comparison of {metric}")
    w = {k: (weights or {}).get(k, 0.0) if weights else c.n_units for k, c in rows.items()}
    total = sum(w.values())
    if not total:
        raise ValueError("the weights sum to zero")
    return sum(w[k] * c.difference.estimate for k, c in rows.items()) / total
