"""Severities, rule assessment and verdict numbers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# Severity order, base scores of a verdict and the bonus per further reason.
SEVERITIES = {"unknown": -1, "neutral": 0, "attention": 1, "avoid": 2, "forbidden": 3}
REASON_WEIGHTS = {"neutral": 0, "attention": 1, "personal": 2, "avoid": 3, "forbidden": 4}
BASE_SCORES = {"neutral": 10, "attention": 45, "personal": 65, "avoid": 80, "forbidden": 95}
REASON_BONUS = 5
PERSONAL_FLOOR = 95

# Notes attached by the assessment.
INEXACT_NOTE = "Недостаточно точное совпадение для применения нормативного статуса."
PHASE_OUT_NOTE = (
    "Переходный период завершен. Проверьте дату изготовления и документы: "
    "законно выпущенная ранее продукция может обращаться до окончания срока годности. "
    "Наличие ингредиента само по себе не устанавливает незаконность товара."
)


def _lookup(key: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def severity_weight(name: Column) -> Column:
    return _lookup(name, SEVERITIES, -1)


def severity_name(weight: Column) -> Column:
    return _lookup(weight, {v: k for k, v in SEVERITIES.items()}, "unknown")


def reason_weight(severity: Column) -> Column:
    """Weight of a severity inside a verdict, where ``personal`` sits between the others."""
    return _lookup(severity, REASON_WEIGHTS, 0)


def reason_name(weight: Column) -> Column:
    return _lookup(weight, {v: k for k, v in REASON_WEIGHTS.items()}, "neutral")


def base_severity(status: Column) -> Column:
    return F.when(status == "BANNED", "forbidden").when(status == "PHASE_OUT", "attention").otherwise("regulatory")


def assess(
    status: Column,
    evaluation: Column,
    match_policy: Column,
    transition_end: Column,
    explanation: Column,
    *,
    matched_by: Column,
    on: dt.date,
) -> Column:
    """Struct (severity, note) of a dated rule for one kind of match.

    A reference-only prohibition stays neutral; a phase-out stays an attention even then.
    """
    inexact = F.coalesce((match_policy == "exact_only") & (matched_by == "similarity"), F.lit(False))
    reference_only = F.coalesce(evaluation == "reference_only", F.lit(False))
    base = base_severity(status)
    plain = F.when(reference_only | (base == "regulatory"), "neutral").otherwise(base)
    severity = (
        F.when(inexact, "neutral")
        .when((status == "BANNED") & ~reference_only, "forbidden")
        .when(status == "PHASE_OUT", "attention")
        .otherwise(plain)
    )
    ended = F.coalesce((status == "PHASE_OUT") & (transition_end <= F.lit(on)), F.lit(False))
    note = (
        F.when(inexact, F.lit(INEXACT_NOTE))
        .when(ended, F.lit(PHASE_OUT_NOTE))
        .otherwise(explanation)
    )
    return F.struct(severity.alias("severity"), note.alias("note"))


def risk_base(severity: Column) -> Column:
    return _lookup(severity, BASE_SCORES, 10)


def risk_score(severity: Column, reasons: Column, unmatched: Column) -> Column:
    bonus = F.greatest(F.lit(0), reasons - 1) * REASON_BONUS
    return F.least(F.lit(100), risk_base(severity) + bonus + unmatched).cast("long")


def verdict_level(severity: Column) -> Column:
    """Level of a verdict without personal hits; nothing found is unknown, never safe."""
    return (
        F.when(severity.isin("forbidden", "avoid"), "dangerous")
        .when(severity == "personal", "risky_for_user")
        .when(severity == "attention", "attention")
        .otherwise("unknown")
    )
