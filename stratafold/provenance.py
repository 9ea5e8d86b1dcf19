"""Fingerprints that say what a result depends on."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path
from typing import Any

from stratafold.config import AnalysisConfig, MetricSpec

VERSION = "0.1.0"
REPORT_VERSION = "1"
RNG = "md5-counter-32"
# Keys of a configuration that change how a result is shown or where it lies, not what it is.
PRESENTATION = frozenset(("created_at", "label", "title", "path", "source_path", "description", "basename"))


def digest(value: Any) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()


def _scientific(value: Any) -> Any:
    if isinstance(value, dict):
        return {str(k): _scientific(v) for k, v in value.items() if k not in PRESENTATION}
    if isinstance(value, list | tuple):
        return [_scientific(v) for v in value]
    return value


def code_version() -> str:
    """Version, commit and, if tracked files of the package were changed, ``+dirty``."""
    here = Path(__file__).resolve().parent

    def git(*words: str) -> str:
        return subprocess.run(["git", "-C", str(here), *words], capture_output=True, text=True, timeout=10, check=True).stdout.strip()

    try:
        commit = git("rev-parse", "--short", "HEAD")
        dirty = "+dirty" if git("status", "--porcelain", "--", str(here)) else ""
    except (OSError, subprocess.SubprocessError):
        return VERSION
    return f"{VERSION}+{commit}{dirty}"


def environment() -> dict[str, str]:
    out = {"python": platform.python_version(), "rng": RNG}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            out[name] = version(name)
        except PackageNotFoundError:
            out[name] = "absent"
    return out


@dataclass
class Provenance:
    """Everything that a comparison depends on."""

    metric: dict[str, Any]
    baseline: str
    candidate: str
    config: dict[str, Any]
    data_sha256: str
    interval_method: str
    seed: int
    n_resamples: int
    code: str
    environment: dict[str, str] = field(default_factory=environment)
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat(timespec="seconds"))

    def scientific_fingerprint(self) -> str:
        """Changes with every input that can change a number, and with nothing else."""
        parts = {k: v for k, v in asdict(self).items() if k not in ("environment", "created_at", "code")}
        return digest(_scientific(parts))

    def full_fingerprint(self) -> str:
        return digest({k: v for k, v in asdict(self).items() if k != "created_at"})


@dataclass
class ReproducibilityManifest:
    """Five digests (data, configuration, protocol, code and results) and the version of the report's generator."""

    data: str
    config: str
    protocol: str
    code: str
    results: str
    report_generator: str = REPORT_VERSION
    environment: dict[str, str] = field(default_factory=environment)


def provenance_for(config: AnalysisConfig, metric: MetricSpec, baseline: str, candidate: str, source: Any, method: str) -> Provenance:
    spec = {k: v for k, v in asdict(metric).items() if k != "description"} | {"parameters": metric.parameters}
    return Provenance(spec, baseline, candidate, dict(config.raw), getattr(source, "sha256", "") or "", method, config.bootstrap.seed, config.bootstrap.n_resamples, code_version())


def manifest(config: AnalysisConfig, source: Any, results: Any) -> ReproducibilityManifest:
    p = config.protocol
    return ReproducibilityManifest(getattr(source, "sha256", "") or "", digest(dict(config.raw)), digest([p.analysis_status, p.hash, p.commit, p.path]), code_version(), digest(results))
