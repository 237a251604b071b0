"""Dated rules of ingredients: validity, evidence, assessment and severity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from provisor.functions.severity import assess, severity_name, severity_weight
from provisor.operators.spread import numbered


def valid_on(day: dt.date, start: str = "effective_from", end: str = "effective_to") -> Column:
    """Both ends inclusive, open ends allowed."""
    since, until = F.col(start), F.col(end)
    return (since.isNull() | (since <= F.lit(day))) & (until.isNull() | (until >= F.lit(day)))


def valid_rules(rules: DataFrame, sources: DataFrame, day: dt.date) -> DataFrame:
    """Rules and sources valid on a day; source columns are prefixed with ``source_``."""
    named = sources.where(valid_on(day)).select(
        "source_id", F.col("code").alias("source_code"), F.col("title").alias("source_title"),
        F.col("url").alias("source_url"),
    )
    return rules.where(valid_on(day)).join(named, "source_id")


def with_transition(rules: DataFrame, transitions: DataFrame) -> DataFrame:
    """Add the nullable transition struct of each rule (at most one row per rule)."""
    terms = transitions.select(
        "rule_id", F.struct(*[c for c in transitions.columns if c != "rule_id"]).alias("transition")
    )
    return rules.join(terms, "rule_id", "left")


def rule_evidence(rules: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per piece of evidence of the given rules with its source; kept long, not nested."""
    named = sources.select("source_id", F.col("code").alias("source_code"), F.col("title").alias("source_title"))
    return evidence.join(rules.select("rule_id"), "rule_id", "left_semi").join(named, "source_id")


def nested_evidence(long: DataFrame) -> DataFrame:
    """Evidence nested per rule in identifier order, for documents of a bounded catalog."""
    item = F.struct("evidence_id", *[c for c in long.columns if c not in ("rule_id", "evidence_id")])
    return long.groupBy("rule_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))


def assessed_rules(rules: DataFrame, transitions: DataFrame, day: dt.date, matched_by: str) -> DataFrame:
    """Add ``severity``, its ``weight`` and the ``note`` for one kind of match."""
    joined = with_transition(rules, transitions)
    verdict = assess(
        F.col("regulatory_status"), F.col("evaluation"), F.col("match_policy"),
        F.col("transition.transition_end"), F.col("explanation"),
        matched_by=F.lit(matched_by), on=day,
    )
    scored = joined.withColumn("_a", verdict)
    return scored.select(
        *joined.columns, F.col("_a.severity").alias("severity"), F.col("_a.note").alias("note")
    ).withColumn("weight", severity_weight(F.col("severity")))


def ordered_rules(assessed: DataFrame, bucket: Column) -> DataFrame:
    """Rules of each ingredient numbered by falling severity, then identifier.

    ``bucket`` must grow with ``rule_id``; it bounds how many rules are ordered in one task.
    """
    key = F.struct(-F.greatest(F.col("weight"), F.lit(0)), bucket)
    order = [F.greatest(F.col("weight"), F.lit(0)).desc(), F.col("rule_id")]
    return numbered(assessed, ["ingredient_id"], key, order, "rule_no")


def severity_of_ingredients(ingredients: DataFrame, assessed: DataFrame) -> DataFrame:
    """Highest severity per ingredient; ``unknown`` without any valid rule."""
    top = assessed.groupBy("ingredient_id").agg(
        F.max("weight").alias("weight"), F.count(F.lit(1)).alias("rules")
    )
    return ingredients.join(top, "ingredient_id", "left").select(
        *ingredients.columns,
        F.coalesce("weight", F.lit(-1)).alias("weight"),
        F.coalesce("rules", F.lit(0)).alias("rules"),
        severity_name(F.coalesce("weight", F.lit(-1))).alias("severity"),
    )


def reason_texts(ordered: DataFrame) -> DataFrame:
    """Reason text of each ingredient: note, explanation or title of its most severe rule."""
    return ordered.where("rule_no = 1").select(
        "ingredient_id",
        F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("note", "explanation", "title")]).alias("reason"),
    )


def rule_status(rules: DataFrame) -> DataFrame:
    """Display status and ``needs_review`` of rules."""
    review = (
        F.coalesce(F.col("primary_basis_required"), F.lit(False))
        | F.coalesce(~F.col("production_ready"), F.lit(False))
        | ~F.col("verification_status").eqNullSafe("verified_primary")
    )
    status = F.col("regulatory_status")
    title = (
        F.when(status == "PERMITTED_WITH_CONDITIONS", "Применение с условиями")
        .when((status == "BANNED") & review, "Сведения о запрете")
        .when(status == "BANNED", "Запрет применения")
        .when(status == "PHASE_OUT", "Изменение условий применения")
        .otherwise(F.col("title"))
    )
    return rules.withColumn("needs_review", review).withColumn("display_title", title)
