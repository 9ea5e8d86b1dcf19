"""Spark-native evaluation of policies from nested experiment records.

Names are imported when first used: executors that only run a kernel load nothing else.
"""

from importlib import import_module

_WHERE = {
    "stratafold.config": "AnalysisConfig Bounds ConfigError Margin MetricSpec config_from_mapping load_config",
    "stratafold.functions.decisions": "CoverageEstimate EquivalenceResult MarginRequired adjust bonferroni classify_difference estimate_coverage holm non_inferiority tost wilson_interval",
    "stratafold.functions.estimators": "METRIC_REGISTRY credibility estimate estimate_by register_estimator",
    "stratafold.hierarchy": "InferenceSpec InferenceStructureError check_structure nesting_relation require_valid_structure unit_labels",
    "stratafold.issues": "ValidationIssue ValidationReport",
    "stratafold.operators.failures": "FailureSummary summarize_failures",
    "stratafold.operators.pairing": "PairedPanel build_paired_panel",
    "stratafold.operators.prepare": "apply_filters apply_missing_policy apply_run_status run_status_ledger",
    "stratafold.operators.resample": "BootstrapResult cluster_bootstrap naive_iid_bootstrap paired_cluster_bootstrap",
    "stratafold.operators.rollup": "aggregate_to_level panel",
    "stratafold.operators.strata": "allocation_ledger stratum_redundancy",
    "stratafold.operators.validate": "validate_for_config validate_records",
    "stratafold.plans.compare": "ComparisonResult MetricComparison StratifiedResult compare_by_stratum compare_policies",
    "stratafold.provenance": "REPORT_GENERATOR_VERSION:REPORT_VERSION __version__:VERSION Provenance ReproducibilityManifest code_version provenance_for",
    "stratafold.report": "audit_wording render_markdown reproducibility_manifest write_report",
    "stratafold.schema": "CORE_COLUMNS ID_COLUMNS OUTCOME_COLUMNS SCHEMA ColumnSpec:Column",
    "stratafold.sources.records": "DataSource file_checksum load_records write_records",
}
_NAMES = {part.partition(":")[0]: (module, part.partition(":")[2] or part) for module, parts in _WHERE.items() for part in parts.split()}
__all__ = sorted(_NAMES)  # noqa: PLE0605


def __getattr__(name: str) -> object:
    if name not in _NAMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, own = _NAMES[name]
    return getattr(import_module(module), own)


def __dir__() -> list[str]:
    return __all__
