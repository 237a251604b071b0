"""Alias rows, duplicates and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provisor.functions.codes import letter_count, strict_code
from provisor.functions.ids import name_uuid
from provisor.functions.text import normalize_text
from provisor.operators.merge import first_by_key
from provisor.operators.quality import alias_owners, ambiguous_forms

ID_PREFIX = "provisor/catalog/v1"


def alias_rows(df: DataFrame, ingredient: str, language: Column, name: str, source: Column, prefix: str = ID_PREFIX) -> DataFrame:
    """Alias records with derived id, normal form and confidence 1."""
    return df.select(
        name_uuid(prefix, "alias", F.col(ingredient), language, F.col(name)).alias("alias_id"),
        F.col(ingredient).alias("ingredient_id"), F.col(name).alias("alias"), normalize_text(F.col(name)).alias("normalized_alias"),
        language.alias("language"), source.cast("string").alias("source"), F.lit(1).cast("decimal(3,2)").alias("confidence"),
    )


def first_aliases(aliases: DataFrame, position: str = "position") -> DataFrame:
    """First alias per (ingredient, language, normal form) in input order."""
    rows = aliases.withColumn("normalized_alias", normalize_text(F.col("alias"))).withColumn(
        "language", F.coalesce("language", F.lit("")))
    return first_by_key(rows, ["ingredient_id", "language", "normalized_alias"], position)


def quarantine(aliases: DataFrame, ingredients: DataFrame, position: str = "position") -> DataFrame:
    """First aliases with their quarantine ``reason`` (null: active).

    Precedence: ambiguous name, code of another ingredient, empty form, fragment of a name.
    Names are ambiguous over all given aliases and both canonical names.
    """
    many = ambiguous_forms(alias_owners(ingredients, aliases)).select(
        F.col("form").alias("normalized_alias"), F.lit(True).alias("_many"))
    own = ingredients.select("ingredient_id", strict_code(F.col("e_code")).alias("_own"))
    rows = first_aliases(aliases, position).join(many, "normalized_alias", "left").join(own, "ingredient_id", "left")
    code = strict_code(F.col("alias"))
    reason = (
        F.when(F.col("_many"), "ambiguous_name")
        .when(code.isNotNull() & ~code.eqNullSafe(F.col("_own")), "e_code_mismatch")
        .when(F.col("normalized_alias") == "", "empty_normalized_alias")
        .when((letter_count(F.col("normalized_alias")) < 2) & code.isNull(), "name_fragment")
    )
    return rows.withColumn("reason", reason).drop("_many", "_own")


def retired_by_note(aliases: DataFrame, special: DataFrame, ambiguous: DataFrame, note: str) -> tuple[DataFrame, DataFrame]:
    """Split aliases into kept and retired: names of special ingredients that are ambiguous or
    carry a parser note."""
    marked = aliases.withColumn("normalized_alias", normalize_text(F.col("alias"))).join(
        special.select("ingredient_id").distinct().withColumn("_special", F.lit(True)), "ingredient_id", "left").join(
        ambiguous.select(F.col("form").alias("normalized_alias")).distinct().withColumn("_unclear", F.lit(True)), "normalized_alias", "left")
    retired = F.coalesce(F.col("_special"), F.lit(False)) & (
        F.coalesce(F.col("_unclear"), F.lit(False)) | F.col("normalized_alias").contains(note))
    return marked.where(~retired).drop("_special", "_unclear"), marked.where(retired).drop("_special", "_unclear")
