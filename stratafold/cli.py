"""Command line: exit code 0 for success, 1 for findings or refusals, 2 for wrong use."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from stratafold import provenance, report, schema
from stratafold.config import ConfigError, load_config
from stratafold.functions import estimators
from stratafold.hierarchy import InferenceStructureError, require_valid_structure, resolve_unit
from stratafold.operators import prepare, resample, rollup, strata
from stratafold.operators.pairing import PairingError, resolve_policies, single_policy_values
from stratafold.operators.prepare import MissingValues
from stratafold.operators.resample import BootstrapError
from stratafold.operators.validate import validate_for_config, validate_records
from stratafold.plans.compare import compare_by_stratum, compare_policies
from stratafold.ship import ship
from stratafold.sources.records import load_records, write_records
from stratafold.synth import scenarios
from stratafold.synth.generate import to_spark

OK, FOUND, MISUSE = 0, 1, 2

STARTER = """\
# What is compared, and on which independent unit.
label: my analysis
analysis_status: exploratory
inference:
  primary_unit: world_id
  nested_units: [event_id, resident_id]
metrics:
  - name: mean_loss
    column: loss
    estimator: mean
    level: event_id
    direction: lower_is_better
    role: primary
  - name: cvar90_loss
    column: loss
    estimator: cvar
    params: {alpha: 0.9}
    role: secondary
comparison: {baseline: policy_a, candidates: [policy_b]}
bootstrap: {n_resamples: 2000, seed: 20260919, confidence_level: 0.95, method: percentile}
# Equivalence needs a difference that would not matter, and where it comes from.
equivalence:
  margins:
    mean_loss: {lower: 0.4, upper: 0.4, source: say where it comes from}
multiplicity: {secondary_correction: holm}
missing_data: {policy: drop_record, status_handling: {crashed: failure}}
strata: []
"""


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    made = found or SparkSession.builder.appName("stratafold").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(made)
    return made


def _say(args: argparse.Namespace, value: object, text: str) -> None:
    print(json.dumps(report.plain(value), indent=2) if getattr(args, "json", False) else text)


def validate_results(args: argparse.Namespace) -> int:
    df, _ = load_records(session(), args.results)
    if args.config:
        found = validate_for_config(df, load_config(args.config))
        found.issues += strata.stratum_issues(df, load_config(args.config).inference.primary_unit, args.stratum or [])
    else:
        found = validate_records(df, strata=args.stratum or [])
    _say(args, json.loads(found.to_json()), found.to_text())
    return FOUND if found.errors or (args.strict and found.warnings) else OK


def compare(args: argparse.Namespace) -> int:
    df, source = load_records(session(), args.results)
    config = load_config(args.config)
    result = compare_policies(df, config, validate=not args.no_validate, metrics=args.metric, source=source)
    by = [compare_by_stratum(df, config, s, source=source, metrics=args.metric) for s in args.stratify or []]
    text = report.render_markdown(result, by, args.title) if args.markdown else report.render_text(result)
    if not args.markdown:
        text += "".join("\n\n" + s.summary_table()[["stratum", "metric", "difference", "verdict"]].to_string(index=False) for s in by)
    _say(args, report.result_to_json(result), text)
    return OK


def bootstrap(args: argparse.Namespace) -> int:
    df, _ = load_records(session(), args.results)
    config = load_config(args.config)
    require_valid_structure(df, config.inference)
    ready = prepare.with_status(prepare.filtered(df, config.filters), config.missing_data)
    b, rows = config.bootstrap, []
    base, others = resolve_policies(ready, config.comparison.baseline, config.comparison.candidates)
    for m in [config.metric(n) for n in args.metric] if args.metric else config.metrics:
        clean = prepare.with_missing_policy(ready, m.column, config.missing_data.policy, m.direction == "lower_is_better")
        panel = rollup.panel(clean, config.inference, m.column, resolve_unit(m.level), config.aggregation)
        for p in (base, *others):
            r = resample.cluster_bootstrap(single_policy_values(panel, p), m.estimator, m.parameters, n_resamples=b.n_resamples, seed=b.seed, confidence_level=b.confidence_level, method=b.method, hierarchical=b.hierarchical)
            rows.append({"metric": m.name, "policy": p, "estimate": r.estimate, "low": r.low, "high": r.high, "n_units": r.n_units, "method": r.method})
    _say(args, rows, "\n".join(f"{r['metric']:<24} {r['policy']:<16} {r['estimate']:.4g} [{r['low']:.4g}, {r['high']:.4g}]  {r['n_units']} units" for r in rows))
    return OK


def write(args: argparse.Namespace) -> int:
    df, source = load_records(session(), args.results)
    config = load_config(args.config)
    result = compare_policies(df, config, validate=not args.no_validate, source=source)
    columns = args.stratify if args.stratify is not None else [s for s in config.strata if s in df.columns]
    by = [compare_by_stratum(df, config, s, source=source) for s in columns]
    for name, path in report.write_report(result, args.out, args.basename, strata=by, source=source, title=args.title).items():
        print(f"{name}: {path}")
    return OK


def ledger(args: argparse.Namespace) -> int:
    df, _ = load_records(session(), args.results)
    config = load_config(args.config)
    unit = config.inference.primary_unit
    base, others = resolve_policies(df, config.comparison.baseline, config.comparison.candidates)
    rows = [r.asDict() for r in strata.allocation_ledger(df, unit, [base, *others], config.inference.nested_units).orderBy("policy_id").collect()]
    runs = [r.asDict() for r in prepare.run_status_ledger(df, config.missing_data, unit).orderBy("policy_id", "status").collect()] if config.missing_data.status_column in df.columns else []
    shifts = {s: [r.asDict() for r in strata.composition_shift(df, unit, s, [base, *others]).orderBy("policy_id", "stratum").collect()] for s in config.strata if s in df.columns}
    _say(args, {"allocation": rows, "runs": runs, "strata": shifts}, "\n".join(str(r) for r in [*rows, *runs]))
    return OK


def show_schema(_: argparse.Namespace) -> int:
    print(schema.describe())
    return OK


def show_metrics(_: argparse.Namespace) -> int:
    for e in estimators.listing():
        print(f"{e['name']:<14} {e['definition']}; {e['min_units']}+ units{', tail' if e['tail'] else ''}; {e['parameters'] or 'no parameters'}")
    return OK


def init_config(args: argparse.Namespace) -> int:
    path = Path(args.out)
    if path.exists() and not args.force:
        print(f"{path} exists; --force overwrites it", file=sys.stderr)
        return FOUND
    path.write_text(STARTER, encoding="utf-8")
    print(path)
    return OK


def synth(args: argparse.Namespace) -> int:
    df = to_spark(session(), scenarios.example_records(args.scenario, args.seed))
    Path(args.out).parent.mkdir(parents=True, exist_ok=True)
    write_records(df, args.out, single=True)
    print(args.out)
    return OK


def redteam(args: argparse.Namespace) -> int:
    found = scenarios.run(session(), args.scenario, args.seed)
    lines = [f"{'ok ' if o.trap and o.defence else 'BAD'} {k}: trap {'fires' if o.trap else 'does not fire'}, defence {'holds' if o.defence else 'fails'}" for k, o in found.items()]
    data = {k: asdict(o) for k, o in found.items()}
    if args.out:
        Path(args.out).mkdir(parents=True, exist_ok=True)
        (Path(args.out) / "redteam.md").write_text("\n".join(["# Scenarios", "", *("- " + x for x in lines), ""]), encoding="utf-8")
        (Path(args.out) / "redteam.json").write_text(json.dumps(report.plain(data), indent=2), encoding="utf-8")
    _say(args, data, "\n".join(lines))
    return OK if all(o.trap and o.defence for o in found.values()) else FOUND


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratafold", description="Evaluation of policies from nested experiment records.")
    top.add_argument("--version", action="version", version=f"stratafold {provenance.VERSION}")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable[[argparse.Namespace], int], about: str, *places: str, flags: Sequence[str] = (), lists: Sequence[str] = (), **texts: str | None) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about)
        for x in places:
            p.add_argument(x)
        for x in flags:
            p.add_argument(f"--{x}", action="store_true")
        for x in lists:
            p.add_argument(f"--{x}", action="append")
        for x, default in texts.items():
            p.add_argument(f"--{x}", default=default)
        p.set_defaults(run=run)
        return p

    add("validate-results", validate_results, "check a record table", "results", flags=("strict", "json"), lists=("stratum",), config=None)
    add("compare", compare, "compare policies", "results", "config", flags=("no-validate", "json", "markdown"), lists=("metric", "stratify"), title="Evaluation report")
    add("bootstrap", bootstrap, "estimates by policy", "results", "config", flags=("json",), lists=("metric",))
    add("report", write, "write a report", "results", "config", flags=("no-validate",), lists=("stratify",), out="reports", basename="report", title="Evaluation report")
    add("ledger", ledger, "allocation and run status", "results", "config", flags=("json",))
    add("schema", show_schema, "the record schema")
    add("metrics", show_metrics, "the estimators")
    add("init-config", init_config, "write a starter configuration", flags=("force",), out="analysis.yaml")
    add("synth", synth, "write a synthetic table", scenario="observation_bootstrap_false_precision", out="fixtures/records.parquet").add_argument("--seed", type=int, default=scenarios.SEED)
    add("redteam", redteam, "run the scenarios", flags=("json",), lists=("scenario",), out=None).add_argument("--seed", type=int, default=scenarios.SEED)
    return top


REFUSALS = (ConfigError, InferenceStructureError, PairingError, BootstrapError, MissingValues, report.WordingError, ValueError)


def main(argv: Sequence[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return args.run(args)
    except (KeyError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return MISUSE
    except REFUSALS as e:
        print(f"refused: {e}", file=sys.stderr)
        return FOUND


if __name__ == "__main__":
    sys.exit(main())
