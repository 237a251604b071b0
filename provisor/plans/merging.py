"""Merge a profile catalog with a regulatory one: match, remap, fill, select rules and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from provisor.functions.ids import name_uuid
from provisor.functions.names import english_name
from provisor.functions.text import normalize_text
from provisor.operators import changes, merge, quality
from provisor.operators.aliases import ID_PREFIX
from provisor.session import cut_lineage

RULE_FIELDS = [
    "rule_type", "severity", "effective_from", "effective_to", "regulatory_status", "evaluation", "verification_status", "match_policy",
]


def merge_catalogs(
    primary: dict[str, DataFrame], legacy: dict[str, DataFrame], ambiguous: DataFrame, raw_rules: DataFrame | None = None,
    prefix: str = ID_PREFIX,
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Merged tables and report sections; neither input changes.

    Each side has ``ingredients`` (with ``position`` on the primary side), ``ingredient_aliases``,
    ``ingredient_rules`` (flat, with ``rule_type`` and the condition columns) and
    ``regulatory_sources``. ``ambiguous`` has ``form``. Rules never flow to an unmatched row.
    """
    ingredients, old = primary["ingredients"], legacy["ingredients"]
    matches = cut_lineage(merge.match_catalogs(ingredients, old), "catalog-matches")
    pairs = matches.where("legacy_id is not null").select("ingredient_id", "legacy_id")
    crosswalk = pairs.select("legacy_id", "ingredient_id")

    partial = F.contains("name_en", F.lit(") (ii)")) & ~F.contains("name_en", F.lit("(i)"))
    source = pairs.join(old.select(F.col("ingredient_id").alias("legacy_id"), "name_en", "category"), "legacy_id")
    cleaned = source.withColumn("name_en", F.when(~F.coalesce(partial, F.lit(False)), english_name(F.col("name_en"))))
    filled = changes.fill_from_match(ingredients, cleaned, "ingredient_id", ["name_en", "category"])

    rules = legacy["ingredient_rules"]
    in_scope = rules.where("ingredient_id is null").unionByName(
        rules.join(crosswalk.select(F.col("legacy_id").alias("ingredient_id")), "ingredient_id", "left_semi").select(*rules.columns))
    kept = in_scope.where(merge.is_status_rule())
    remapped = merge.remap_ids(kept, crosswalk, "ingredient_id").drop("legacy_ingredient_id")
    if "resolved_ingredient_ids" in rules.columns:
        remapped = merge.remap_arrays(remapped, crosswalk, "rule_id", "resolved_ingredient_ids")
    if "group_ingredient_id" in rules.columns:
        remapped = merge.remap_ids(remapped, crosswalk, "group_ingredient_id")

    restricted = remapped.where("match_policy = 'exact_only'").select("ingredient_id")
    own = primary["ingredient_aliases"].withColumn("_order", F.lit(0))
    carried = merge.remap_ids(
        legacy["ingredient_aliases"].join(crosswalk.select(F.col("legacy_id").alias("ingredient_id")), "ingredient_id", "left_semi"),
        crosswalk, "ingredient_id").drop("legacy_ingredient_id").withColumn("_order", F.lit(1))
    english = filled.where(F.coalesce("name_en", F.lit("")) != "").select(
        name_uuid(prefix, "alias", F.concat_ws("/", "ingredient_id", normalize_text(F.col("name_en")))).alias("alias_id"),
        "ingredient_id", F.col("name_en").alias("alias"), F.lit("en").alias("language"), F.lit("catalog_match").alias("source"), F.lit(2).alias("_order"))
    union = own.unionByName(carried, allowMissingColumns=True).unionByName(english, allowMissingColumns=True)
    judged = merge.alias_decisions(union, restricted, ambiguous)
    # An own alias is only dropped for ambiguity, a carried one also for being an extraction row.
    reason = F.when((F.col("_order") != 1) & (F.col("reason") == "extraction_row_not_a_clean_alias"), None).otherwise(F.col("reason"))
    judged = cut_lineage(
        judged.withColumn("reason", reason).withColumn("_position", F.struct("_order", "alias_id")), "merged-aliases")
    active = judged.where("reason is null")
    later = merge.first_by_key(active.where("_order > 0"), ["ingredient_id", "form"], "_position")
    taken = active.where("_order = 0")
    added = later.join(taken.select("ingredient_id", "form"), ["ingredient_id", "form"], "left_anti")
    aliases = taken.select(*added.columns).unionByName(added).drop("_order", "_position", "reason").withColumnRenamed("form", "normalized_alias_")
    aliases = aliases.drop("normalized_alias").withColumnRenamed("normalized_alias_", "normalized_alias")

    tables = {
        **primary,
        "ingredients": filled,
        "ingredient_aliases": aliases,
        "ingredient_rules": remapped,
        "ingredient_matches": matches.where("legacy_id is not null").select(
            "ingredient_id", F.col("legacy_id").alias("legacy_ingredient_id"), F.col("method").alias("match_method")),
        "regulatory_sources": merge.first_wins([legacy["regulatory_sources"], primary["regulatory_sources"]], "source_id"),
    }
    excluded = in_scope.where(~merge.is_status_rule())
    report = {
        "unmatched": merge.review_candidates(matches, old),
        "field_changes": changes.field_changes(ingredients, filled, "ingredient_id", ["name_en", "category"]),
        "english_needs_review": cleaned.where("name_en is null").join(
            source.where("name_en is not null").select("ingredient_id", F.col("name_en").alias("source_value")), "ingredient_id").select("ingredient_id", "source_value"),
        "name_differences": pairs.join(ingredients.select("ingredient_id", "name"), "ingredient_id").join(
            old.select(F.col("ingredient_id").alias("legacy_id"), F.col("name").alias("legacy_name")), "legacy_id").where(
            normalize_text(F.col("name")) != normalize_text(F.col("legacy_name"))),
        "rejected_aliases": judged.where("reason is not null").select("ingredient_id", "alias", "reason"),
        "excluded_rules": merge.counter(excluded, "rule_type"),
        "rules_copied": merge.counter(remapped, "ingredient_id"),
        "status_counts": merge.counter(remapped, "regulatory_status"),
        "legacy_only": old.where("e_code is not null").join(crosswalk.select(F.col("legacy_id").alias("ingredient_id")), "ingredient_id", "left_anti").select("ingredient_id", "e_code", "name"),
        "summary": merge.merge_summary(matches, filled, old),
    }
    if raw_rules is not None:
        fields = [f for f in RULE_FIELDS if f in raw_rules.columns and f in remapped.columns]
        report["rule_changes"] = changes.rule_changes(raw_rules, remapped, fields)
    return tables, report


def merged_violations(tables: dict[str, DataFrame], profiles: DataFrame, primary_sources: DataFrame) -> DataFrame:
    """Nested references mapped, rules only about status and not from the profile publisher,
    a profile with unchanged description for every ingredient."""
    rules, ingredients = tables["ingredient_rules"], tables["ingredients"]
    parts = [
        quality.failing_rows("ingredient_rules", rules, "rule_id", {"not_a_status_rule": merge.is_status_rule()}),
        quality.orphans("ingredient_rules", rules, "ingredient_id", ingredients, "ingredient_id"),
        quality.orphans("ingredient_rules", rules, "source_id", tables["regulatory_sources"], "source_id"),
        quality.code_rules(ingredients),
        quality.key_set_difference("profiles_of_ingredients", profiles, ingredients, "ingredient_id"),
        quality.duplicate_keys("profiles", profiles, "ingredient_id"),
    ]
    own = rules.join(primary_sources.select("source_id"), "source_id", "left_semi")
    parts.append(quality.violations("ingredient_rules", own, "publisher_rule", F.col("rule_id")))
    for column in ("resolved_ingredient_ids", "group_ingredient_id"):
        if column in rules.columns:
            refs = rules.select("rule_id", (F.explode(column) if column.endswith("ids") else F.col(column)).alias("ref"))
            parts.append(quality.orphans("ingredient_rules", refs, "ref", ingredients, "ingredient_id"))
    if "full_description" in profiles.columns:
        texts = profiles.select("ingredient_id", F.col("full_description").alias("_profile")).join(
            ingredients.select("ingredient_id", "full_description"), "ingredient_id")
        parts.append(quality.failing_rows("profiles", texts, "ingredient_id", {
            "description_changed": F.col("_profile").eqNullSafe(F.col("full_description"))}))
    return quality.union_all(parts)
