"""Profile bundle from parsed article pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provisor.functions.ids import name_uuid
from provisor.functions.names import EXCERPT_WORDS, script_language
from provisor.functions.text import normalize_text
from provisor.operators import quality
from provisor.operators.aliases import ID_PREFIX

CODE = r"(?i)^E\d{3,4}[a-z]?(?:\([ivx]+\))?$"


def short_description(name: Column, code: Column, functions: Column, origins: Column) -> Column:
    """Factual one-liner from name, code, functions and origins (arrays of titles)."""
    listed = F.when(F.size(functions) > 0, F.concat(F.lit("Функции: "), F.array_join(functions, "; "), F.lit(".")))
    from_ = F.when(F.size(origins) > 0, F.concat(F.array_join(origins, "; "), F.lit(".")))
    return F.concat_ws(" ", F.concat(name, F.lit(" ("), code, F.lit(").")), listed, from_)


def profile_bundle(records: DataFrame, descriptions: DataFrame, source: str, prefix: str = ID_PREFIX) -> dict[str, DataFrame]:
    """Ingredients, aliases and profile fragments of article records.

    ``records``: e_code, name, source_url, has_article, description_excerpt, synonyms, functions,
    origins (arrays of titles). ``descriptions``: code, new_text. A publisher's own rating column
    is never carried over.
    """
    text = descriptions.select(F.col("code").alias("e_code"), F.col("new_text").alias("_text"))
    rows = records.drop("danger").join(text, "e_code", "left").withColumns({
        "ingredient_id": name_uuid(prefix, "ingredient", F.col("e_code")),
        "description": short_description(F.col("name"), F.col("e_code"), F.col("functions"), F.col("origins")),
        "full_description": F.when(F.col("has_article"), F.nullif(F.col("_text"), F.lit(""))),
    }).withColumn(
        "full_description_status", F.when(F.col("full_description").isNotNull(), "paraphrased")
        .when(F.col("has_article"), "not_reviewed").otherwise("no_source_article")).drop("_text")
    names = F.array_distinct(F.concat(F.array("e_code", "name"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    aliases = rows.select("ingredient_id", "e_code", F.explode(names).alias("alias")).select(
        name_uuid(prefix, "alias", F.col("e_code"), F.col("alias")).alias("alias_id"), "ingredient_id", "alias",
        normalize_text(F.col("alias")).alias("normalized_alias"), script_language(F.col("alias")).alias("language"),
        F.lit(source).alias("source"), F.lit(1).cast("decimal(3,2)").alias("confidence"))
    return {
        "ingredients": rows.select(
            "ingredient_id", F.lit("food_additive").alias("kind"), "e_code", "name", F.lit(None).cast("string").alias("name_en"),
            F.nullif(F.array_join("functions", "; "), F.lit("")).alias("category"), "description", "full_description", F.lit(True).alias("is_active")),
        "ingredient_aliases": aliases,
        "source_fragments": rows.withColumn("record_kind", F.lit("additive_profile")).withColumn(
            "fragment_id", name_uuid(prefix, "fragment", F.col("source_url"))),
    }


def completeness(bundle: dict[str, DataFrame]) -> DataFrame:
    """One row of coverage counts."""
    return bundle["source_fragments"].agg(
        F.count(F.lit(1)).alias("additives"), F.count_if("has_article").alias("with_article"),
        F.count("full_description").alias("with_full_description"),
        F.count_if(~F.col("has_article")).alias("without_article"))


def profile_violations(bundle: dict[str, DataFrame]) -> DataFrame:
    """Coverage, excerpt length and consistent descriptions of a profile bundle."""
    ingredients, profiles = bundle["ingredients"], bundle["source_fragments"].where("record_kind = 'additive_profile'")
    words = F.size(F.filter(F.split(F.coalesce("description_excerpt", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    both = profiles.select("ingredient_id", "has_article", "description_excerpt", F.col("full_description").alias("_own")).join(
        ingredients.select("ingredient_id", "full_description"), "ingredient_id")
    return quality.union_all([
        quality.duplicate_keys("ingredients", ingredients, "ingredient_id"),
        quality.duplicate_keys("ingredients", ingredients, "e_code", "duplicate_code"),
        quality.duplicate_keys("ingredient_aliases", bundle["ingredient_aliases"], "alias_id"),
        quality.failing_rows("ingredients", ingredients, "ingredient_id", {"invalid_code": F.col("e_code").rlike(CODE)}),
        quality.key_set_difference("profiles_of_ingredients", profiles, ingredients, "ingredient_id"),
        quality.orphans("ingredient_aliases", bundle["ingredient_aliases"], "ingredient_id", ingredients, "ingredient_id"),
        quality.failing_rows("profiles", both, "ingredient_id", {
            "excerpt_too_long": words <= EXCERPT_WORDS,
            "descriptions_differ": F.col("_own").eqNullSafe(F.col("full_description")),
            "description_without_article": F.col("_own").isNull() | (F.col("has_article") & (F.btrim("_own") != "")),
        }),
    ])
