"""The whole audit as one lazy plan: changes and scopes in, findings, scores and warnings out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import compare, diff, impact


@dataclass
class Audit:
    actual: DataFrame
    findings: DataFrame
    scores: DataFrame
    warnings: DataFrame


def audit(lines: DataFrame, scope: DataFrame) -> Audit:
    """lines: (audit_id, line_no, raw) of changes; scope: rows of arrays (operators.compare.scope_rows or operators.scope.extract)."""
    scanned = diff.scan(lines)
    actual = diff.actual(diff.surface(scanned), lines.select("audit_id").distinct())
    found = compare.findings(actual, scope)
    return Audit(actual, found, compare.scores(found, actual), impact.warnings(diff.file_stats(scanned)))
