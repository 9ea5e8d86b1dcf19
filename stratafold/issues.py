"""Findings of a validation."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Issue:
    """One finding: error, warning or info, with a stable code."""

    severity: str
    code: str
    message: str
    column: str | None = None
    count: int | None = None


ValidationIssue = Issue


@dataclass
class ValidationReport:
    """All findings of a table."""

    issues: list[Issue] = field(default_factory=list)
    n_rows: int = 0

    def add(self, severity: str, code: str, message: str, column: str | None = None, count: int | None = None) -> None:
        self.issues.append(Issue(severity, code, message, column, count))

    def of(self, severity: str) -> list[Issue]:
        return [i for i in self.issues if i.severity == severity]

    @property
    def errors(self) -> list[Issue]:
        return self.of("error")

    @property
    def warnings(self) -> list[Issue]:
        return self.of("warning")

    @property
    def ok(self) -> bool:
        return not self.errors

    def codes(self) -> set[str]:
        return {i.code for i in self.issues}

    def raise_if_invalid(self) -> None:
        if self.errors:
            raise ValueError("; ".join(f"{i.code}: {i.message}" for i in self.errors))

    def to_json(self) -> str:
        return json.dumps({"n_rows": self.n_rows, "ok": self.ok, "issues": [asdict(i) for i in self.issues]}, indent=2)

    def to_text(self) -> str:
        lines = [f"{self.n_rows} rows: {len(self.errors)} error(s), {len(self.warnings)} warning(s)"]
        order = {"error": 0, "warning": 1, "info": 2}
        lines += [f"[{i.severity}] {i.code}: {i.message}" for i in sorted(self.issues, key=lambda i: order[i.severity])]
        return "\n".join(lines)
