"""Reports of a comparison: Markdown, text, JSON, CSV, and an audit of their wording."""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, is_dataclass
from pathlib import Path
from typing import Any

import numpy as np

from stratafold import provenance
from stratafold.functions import estimators
from stratafold.plans.compare import ROLE_ORDER, ComparisonResult, MetricComparison, StratifiedResult

# Phrasings that claim more than an interval shows.
OVERCLAIMS = (
    r"\bprove[sdn]?\b",
    r"\bproven\b",
    r"\bno difference\b",
    r"\bno significant difference\b",
    r"\bare the same\b",
    r"\bis the same as\b",
    r"\bidentical performance\b",
    r"\bbetter overall\b",
    r"\bworse overall\b",
    r"\boverall winner\b",
    r"\bis safe\b",
    r"\bare safe\b",
    r"\bbeats\b",
)
#: Further phrasings of the kind.
OVERCLAIMS += (
    r"\bguarantees?\b",
    r"\binterchangeable\b",
    r"\bsafe to deploy\b",
    r"\bhighly significant\b",
    r"\bmarginally significant\b",
    r"\btrending? toward",
    r"\bclearly (better|worse|superior)\b",
    r"\bno effect\b",
)


class WordingError(ValueError):
    """A report claims more than it may."""


def audit_wording(text: str) -> list[str]:
    """Lines that overclaim, with what was found."""
    found = []
    for n, line in enumerate(text.splitlines(), 1):
        found += [f"line {n}: {m.group(0)!r}" for p in OVERCLAIMS if (m := re.search(p, line, re.IGNORECASE))]
    return found


def plain(value: Any) -> Any:
    """Data that JSON can hold; numbers that are not finite become null."""
    if is_dataclass(value) and not isinstance(value, type):
        return plain(asdict(value))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [plain(v) for v in value]
    if isinstance(value, np.ndarray):
        return [plain(v) for v in value.tolist()]
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def _number(x: float | None) -> str:
    return "–" if x is None or not math.isfinite(x) else f"{x:.4g}"


def _sentence(c: MetricComparison) -> str:
    said = {
        "superior": f"{c.candidate} is better than {c.baseline}",
        "worse": f"{c.candidate} is worse than {c.baseline}",
        "statistically_equivalent": "any difference lies within the declared margin",
        "statistically_different_within_margin": "the difference is distinguishable from zero and lies within the declared margin",
        "inconclusive": "the records leave the direction open",
    }
    return said[c.verdict]


def _finding(c: MetricComparison) -> list[str]:
    d = c.difference
    lines = [
        f"### {c.metric.name} ({c.metric.role})",
        f"{estimators.definition(c.metric.estimator, **c.metric.parameters)} of `{c.metric.column}` at `{c.metric.level}`, {c.metric.direction.replace('_', ' ')}.",
        f"- {c.baseline}: {_number(c.base.estimate)} [{_number(c.base.low)}, {_number(c.base.high)}]",
        f"- {c.candidate}: {_number(c.cand.estimate)} [{_number(c.cand.low)}, {_number(c.cand.high)}]",
        f"- difference: {_number(d.estimate)} [{_number(d.low)}, {_number(d.high)}], {d.method}, {c.n_units} units, p {_number(d.p_value)}, adjusted {_number(c.p_adjusted)}",
        f"- verdict: **{c.verdict}**: {_sentence(c)}",
        f"- population: {c.estimand}",
    ]
    if c.equivalence:
        lines.append(f"- equivalence: {c.equivalence.conclusion}, margin -{c.equivalence.margin.lower:g} to +{c.equivalence.margin.upper:g}")
    if c.non_inferiority:
        lines.append(f"- non-inferiority: {c.non_inferiority.conclusion}")
    return [*lines, *(f"- note: {n}" for n in c.notes), ""]


def _table(rows: list[dict[str, Any]]) -> list[str]:
    if not rows:
        return ["none", ""]
    heads = list(rows[0])
    cell = lambda v: _number(v) if isinstance(v, float) else str(v)
    return ["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads), *("| " + " | ".join(cell(r[h]) for h in heads) + " |" for r in rows), ""]


def _shown(result: ComparisonResult) -> list[MetricComparison]:
    return sorted(result.comparisons, key=lambda c: ROLE_ORDER[c.metric.role])


def render_markdown(result: ComparisonResult, strata: list[StratifiedResult] | None = None, title: str = "Evaluation report") -> str:
    """The whole report."""
    config, b = result.config, result.config.bootstrap
    out = [f"# {title}", ""]
    out += ["## 1. Question and design", f"{result.baseline} against {', '.join(result.candidates)}; unit of inference `{config.inference.primary_unit}`, levels {' > '.join(config.inference.levels)}; status: {config.protocol.analysis_status}.", ""]
    out += ["## 2. Findings", *(line for c in _shown(result) for line in _finding(c))]
    out += ["## 3. Multiplicity", *_table([{"family": k, "method": v["method"], "tests": v["size"]} for k, v in result.families.items()])]
    out += ["## 4. Disagreements", *([f"- {d['kind']}: {d['message']}" for d in result.disagreements] or ["none"]), ""]
    out += ["## 5. Strata"]
    for s in strata or []:
        out += [f"### {s.column}", *_table(s.summary_table()[["stratum", "metric", "n_units", "difference", "ci_low", "ci_high", "verdict"]].to_dict("records")), *(f"- skipped {k}: {why}" for k, why in s.skipped.items()), *(f"- {d['kind']}: {d['message']}" for d in s.disagreements), *([f"- {s.balance_note}"] if s.balance_note else []), ""]
    out += [] if strata else ["none", ""]
    out += ["## 6. Runs and missing values", *_table(result.ledger), f"Missing by policy: {plain(result.log.missing_by_policy)}; counters: {plain(result.log.counters)}.", ""]
    out += ["## 7. Failures", *(_table(result.failures.table) if result.failures else ["not recorded", ""])]
    out += ["## 8. Checks", *([f"- {i.code}: {i.message}" for i in result.warnings] or ["no warnings"]), ""]
    made = result.comparisons[0].provenance if result.comparisons else None
    out += ["## 9. Provenance", f"{b.n_resamples} resamples, seed {b.seed}, {b.confidence_level:.0%} intervals; code {provenance.code_version()}; fingerprint {made.scientific_fingerprint()[:16] if made else '–'}.", ""]
    out += ["## How to read this", "Intervals come from resampling whole units. An interval that holds zero leaves the direction open; only a declared margin can support equivalence, and it speaks of the margin, not of every use.", ""]
    return "\n".join(out)


def render_text(result: ComparisonResult) -> str:
    """A few lines for a console."""
    lines = [f"{result.baseline} vs {', '.join(result.candidates)}"]
    lines += [f"{c.metric.name:<24} {c.candidate:<16} {_number(c.difference.estimate):>10} [{_number(c.difference.low)}, {_number(c.difference.high)}]  {c.verdict}" for c in _shown(result)]
    return "\n".join([*lines, *(f"! {d['message']}" for d in result.disagreements)])


def result_to_json(result: ComparisonResult, replicates: bool = False) -> dict[str, Any]:
    """Everything as plain data; replicate vectors only if asked for."""
    rows = []
    for c in _shown(result):
        one = plain({**c.row(), "notes": c.notes, "diagnostics": c.diagnostics, "estimand": c.estimand})
        one["fingerprint"] = c.provenance.scientific_fingerprint() if c.provenance else None
        if replicates:
            one["replicates"] = plain(c.difference.replicates)
        rows.append(one)
    return {"baseline": result.baseline, "candidates": result.candidates, "comparisons": rows, "disagreements": result.disagreements, "families": plain(result.families), "ledger": plain(result.ledger), "warnings": plain(result.warnings), "failures": plain(result.failures)}


def reproducibility_manifest(result: ComparisonResult, source: Any = None) -> provenance.ReproducibilityManifest:
    return provenance.manifest(result.config, source, plain(result.summary_table().to_dict("records")))


def write_report(result: ComparisonResult, directory: str | Path, basename: str = "report", *, strata: list[StratifiedResult] | None = None, source: Any = None, title: str = "Evaluation report", audit: bool = True) -> dict[str, Path]:
    """Markdown, JSON, summary CSV and manifest; raises before writing if the wording overclaims."""
    text = render_markdown(result, strata, title)
    found = audit_wording(text) if audit else []
    if found:
        raise WordingError("; ".join(found))
    directory = Path(directory)
    directory.mkdir(parents=True, exist_ok=True)
    paths = {k: directory / f"{basename}{end}" for k, end in (("markdown", ".md"), ("json", ".json"), ("csv", "_summary.csv"), ("manifest", "_manifest.json"))}
    paths["markdown"].write_text(text, encoding="utf-8")
    paths["json"].write_text(json.dumps(result_to_json(result), indent=2), encoding="utf-8")
    result.summary_table().to_csv(paths["csv"], index=False)
    paths["manifest"].write_text(json.dumps(plain(reproducibility_manifest(result, source)), indent=2), encoding="utf-8")
    return paths
