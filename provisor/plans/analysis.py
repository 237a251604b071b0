"""Label text to verdict."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from provisor.operators import resolve, rules, verdict
from provisor.session import cut_lineage


def graded_dictionary(dictionary: DataFrame, weights: DataFrame) -> DataFrame:
    """Match dictionary with the severity weight of each ingredient.

    Severities are joined on the catalog side, so tokens are still joined once.
    """
    return dictionary.join(weights, "ingredient_id", "left").withColumn("weight", F.coalesce("weight", F.lit(-1)))


def catalog_dictionary(
    ingredients: DataFrame, aliases: DataFrame, review: DataFrame, rule_rows: DataFrame, sources: DataFrame,
    transitions: DataFrame, day: dt.date,
) -> DataFrame:
    """Everything a label needs from the catalog on one day: (by, key) to ingredient and weight.

    A written table: build it once per catalog version and day and give it to every label job.
    Its size is known, so Spark broadcasts it exactly while it is below the session's threshold.
    """
    assessed = rules.assessed_rules(rules.valid_rules(rule_rows, sources, day), transitions, day, "alias")
    weights = rules.severity_of_ingredients(ingredients.select("ingredient_id"), assessed).select("ingredient_id", "weight")
    return cut_lineage(graded_dictionary(resolve.match_dictionary(ingredients, aliases, review), weights), "catalog-dictionary")


def analyse_labels(labels: DataFrame, dictionary: DataFrame, *, keep_empty: bool = True) -> DataFrame:
    """One verdict row per label (``product_id``, ``text``), against a :func:`catalog_dictionary`.

    Labels are dealt out by product before they are split, so both aggregates find their rows in
    place: one exchange of labels, none of tokens. A label without any token keeps a row with
    zero counts, unless ``keep_empty`` is false.
    """
    tokens = resolve.with_lookup_key(resolve.label_tokens(labels.repartition("product_id"), keep_empty=keep_empty))
    return verdict.described(verdict.verdicts(verdict.label_counts(resolve.resolve_tokens(tokens, dictionary))))


def personal_verdicts(
    labels: DataFrame, dictionary: DataFrame, exclusions: DataFrame, names: DataFrame | None = None
) -> DataFrame:
    """One verdict row per label and its user (``product_id``, ``user_id``, ``text``).

    With ``names`` (``ingredient_id``, ``e_code``, ``name``) the description of a personal verdict
    lists the excluded ingredients.
    """
    keys = ("product_id", "user_id")
    tokens = resolve.with_lookup_key(resolve.label_tokens(labels.repartition(*keys), keys=keys, keep_empty=True))
    flagged = verdict.with_personal_hits(resolve.resolve_tokens(tokens, dictionary), exclusions)
    judged = verdict.verdicts(verdict.label_counts(flagged, keys, with_hits=names is not None))
    return verdict.described(judged, names, keys)
