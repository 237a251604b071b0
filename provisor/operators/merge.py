"""Matching two catalogs one to one and selecting what is carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provisor.functions.codes import strict_code
from provisor.functions.names import CYRILLIC
from provisor.functions.text import normalize_text

ALIAS_MAX_CHARS = 180


def match_catalogs(primary: DataFrame, legacy: DataFrame) -> DataFrame:
    """One row per primary row with its legacy row, if any, and the method.

    A code shared by exactly one legacy row decides; a code no legacy row has falls back to a
    name owned by exactly one legacy row that has no code. A legacy row goes to the first taker
    in ``position`` order; later takers stay unmatched, they get no second choice.
    Both sides have ``ingredient_id, e_code, name``; ``primary`` also ``position``.
    """
    left = primary.select(
        "ingredient_id", "position", strict_code(F.col("e_code")).alias("code"), normalize_text(F.col("name")).alias("form")
    )
    right = legacy.select(
        F.col("ingredient_id").alias("legacy_id"), strict_code(F.col("e_code")).alias("code"),
        normalize_text(F.col("name")).alias("form"), (F.coalesce("e_code", F.lit("")) != "").alias("coded"),
    )
    by_code = right.where("code is not null").groupBy("code").agg(
        F.count(F.lit(1)).alias("code_owners"), F.min("legacy_id").alias("by_code"))
    by_name = right.groupBy("form").agg(
        F.count(F.lit(1)).alias("name_owners"), F.min("legacy_id").alias("by_name"), F.bool_or("coded").alias("name_coded"))
    rows = left.join(by_code, "code", "left").join(by_name, "form", "left")
    named = F.col("code_owners").isNull() & (F.col("name_owners") == 1) & ~F.col("name_coded")
    wanted = rows.withColumn(
        "wanted", F.when(F.col("code_owners") == 1, F.col("by_code")).when(named, F.col("by_name"))
    ).withColumn("method", F.when(F.col("code_owners") == 1, "exact_e_code").when(named, "unique_exact_name_without_legacy_code"))
    taker = wanted.where("wanted is not null").groupBy("wanted").agg(F.min("position").alias("_first"))
    out = wanted.join(taker, "wanted", "left")
    mine = F.col("position") == F.col("_first")
    return out.select(
        "ingredient_id", "code", "form", F.when(mine, F.col("wanted")).alias("legacy_id"), F.when(mine, F.col("method")).alias("method")
    )


def review_candidates(matches: DataFrame, legacy: DataFrame) -> DataFrame:
    """Related legacy rows of every unmatched primary row: same name, same code, parent code.

    Rows come long, one per candidate; an unmatched row without candidate has a null one.
    """
    right = legacy.select(
        F.col("ingredient_id").alias("candidate_id"), strict_code(F.col("e_code")).alias("code"), normalize_text(F.col("name")).alias("form"))
    open_rows = matches.where("legacy_id is null").select("ingredient_id", "code", "form")
    parent = F.regexp_replace("code", r"\([IVX]+\)$", "")
    bare = F.translate("code", "()", "")
    codes = open_rows.select("ingredient_id", F.explode(F.array_distinct(F.array("code", parent, bare))).alias("code"))
    found = (
        open_rows.join(right.select("form", "candidate_id"), "form").select("ingredient_id", "candidate_id")
        .unionByName(codes.where("code is not null").join(right.select("code", "candidate_id"), "code").select("ingredient_id", "candidate_id"))
        .distinct()
    )
    return open_rows.select("ingredient_id").join(found, "ingredient_id", "left").withColumn(
        "reason", F.when(F.col("candidate_id").isNull(), "no_match").otherwise("ambiguous_or_requires_review"))


def remap_arrays(rows: DataFrame, crosswalk: DataFrame, key: str, ids: str) -> DataFrame:
    """Replace legacy ids inside an array by current ones, in order, without repeats.

    The original array stays as ``legacy_<ids>``; ``<ids>_scope`` tells when some id had no match.
    ``crosswalk`` is (legacy_id, ingredient_id). The rebuilt arrays are never longer than the ones
    the rows came with.
    """
    flat = rows.select(key, F.posexplode(ids).alias("_pos", "legacy_id")).join(crosswalk, "legacy_id", "left")
    again = flat.groupBy(key).agg(
        F.array_distinct(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("ingredient_id").isNotNull(), F.struct("_pos", "ingredient_id")))),
            lambda x: x["ingredient_id"])).alias("_new"),
        F.count_if(F.col("ingredient_id").isNull()).alias("_lost"),
    )
    empty = F.array().cast(again.schema["_new"].dataType)
    return rows.join(again, key, "left").select(
        *[c for c in rows.columns if c != ids], F.col(ids).alias(f"legacy_{ids}"),
        F.when(F.col(ids).isNotNull(), F.coalesce("_new", empty)).alias(ids),
        F.when(F.col("_lost") > 0, "matched_catalog_subset").alias(f"{ids}_scope"),
    )


def remap_ids(rows: DataFrame, crosswalk: DataFrame, column: str) -> DataFrame:
    """Replace one legacy id column by the current id; the original stays as ``legacy_<column>``."""
    current = crosswalk.select(F.col("legacy_id").alias(column), F.col("ingredient_id").alias("_current"))
    out = rows.join(current, column, "left")
    return out.withColumn(f"legacy_{column}", F.col(column)).withColumn(column, F.col("_current")).drop("_current")


def is_status_rule() -> Column:
    """Permission or prohibition of an ingredient; never dose, purity or labelling."""
    permitted = (F.col("rule_type") == "permitted_food_additive") & (F.col("regulatory_status") == "PERMITTED_WITH_CONDITIONS")
    restricted = (F.col("rule_type") == "regulatory_status") & F.col("regulatory_status").isin("BANNED", "PHASE_OUT")
    return F.coalesce(F.col("ingredient_id").isNotNull() & (permitted | restricted), F.lit(False))


def alias_decisions(aliases: DataFrame, restricted: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Reason for leaving out an alias, or null: unclean extraction row, or ambiguous for a
    strictly matched ingredient. ``restricted`` has ``ingredient_id``, ``ambiguous`` has ``form``."""
    unclean = (F.length("alias") > ALIAS_MAX_CHARS) | (
        F.coalesce(F.col("language") == "en", F.lit(False)) & F.col("alias").rlike(CYRILLIC))
    strict = restricted.select("ingredient_id").distinct().withColumn("_strict", F.lit(True))
    unclear = ambiguous.select("form").distinct().withColumn("_unclear", F.lit(True))
    rows = aliases.withColumn("form", normalize_text(F.col("alias"))).join(strict, "ingredient_id", "left").join(unclear, "form", "left")
    return rows.withColumn(
        "reason", F.when(unclean, "extraction_row_not_a_clean_alias").when(
            F.col("_strict") & F.col("_unclear"), "ambiguous_for_strict_status_rule")
    ).drop("_strict", "_unclear")


def first_by_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """First row per key by a unique position; the rest are dropped."""
    first = df.groupBy(*keys).agg(F.min(position).alias(position))
    return df.join(first, [*keys, position], "left_semi")


def first_wins(bundles: list[DataFrame], key: str) -> DataFrame:
    """Union by key; the earliest bundle that has a key provides its row."""
    marked = [b.withColumn("_source", F.lit(i)) for i, b in enumerate(bundles)]
    union = marked[0]
    for part in marked[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return first_by_key(union, [key], "_source").drop("_source")


def counter(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def merge_summary(matches: DataFrame, ingredients: DataFrame, legacy: DataFrame) -> DataFrame:
    """One row of counts: sizes, matches per method, gaps."""
    counts = matches.agg(
        F.count(F.lit(1)).alias("ingredients"), F.count("legacy_id").alias("matched"),
        F.count_if(F.col("method") == "exact_e_code").alias("matched_by_code"),
        F.count_if(F.col("legacy_id").isNull()).alias("unmatched"), F.lit(1).alias("_k"))
    gaps = ingredients.agg(F.count_if(F.coalesce("name_en", F.lit("")) == "").alias("english_remaining_null"), F.lit(1).alias("_k"))
    used = matches.select(F.col("legacy_id").alias("ingredient_id"))
    rest = legacy.where("e_code is not null").join(used, "ingredient_id", "left_anti").agg(
        F.count(F.lit(1)).alias("legacy_only_codes"), F.lit(1).alias("_k"))
    return counts.join(gaps, "_k").join(rest, "_k").drop("_k")
