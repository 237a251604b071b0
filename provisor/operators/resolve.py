"""Label tokens to catalog ingredients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provisor.functions.codes import code_form, code_text
from provisor.functions.text import normalize_text, split_label
from provisor.session import bound_tasks


def label_tokens(
    labels: DataFrame, text: str = "text", keys: tuple[str, ...] = ("product_id",), *, keep_empty: bool = False
) -> DataFrame:
    """One row per token of a label, with its zero-based position.

    ``keep_empty`` keeps a row with null position and token for a label without tokens.
    """
    # The outer form keeps Catalyst from adding a size filter that would split every text twice.
    tokens = labels.select(*keys, F.posexplode_outer(split_label(F.col(text))).alias("pos", "token"))
    return tokens if keep_empty else tokens.where("pos is not null")


def with_lookup_key(tokens: DataFrame, token: str = "token", *, any_script: bool = True) -> DataFrame:
    """Add how a token is looked up: ``by`` is ``code`` or ``name`` and ``key`` the text.

    A negated token has its code suppressed and is looked up by its whole normal form; a token
    with a code is never looked up by name. A missing token has the empty key, which the dictionary
    does not have.
    """
    bound_tasks(tokens.sparkSession)
    raw = F.col(token)
    # Steps in columns of their own, so that no regular expression runs twice per token.
    found = tokens.withColumn("_found", code_text(raw))
    coded = found.withColumn("code", code_form(F.col("_found"))).drop("_found")
    named = F.when(F.col("code").isNull(), normalize_text(raw, any_script=any_script))
    # Never null: an inner join would otherwise test the whole expression for null once more at the scan.
    return coded.withColumn("by", F.when(F.col("code").isNotNull(), "code").otherwise("name")).withColumn(
        "key", F.coalesce(F.lower("code"), named, F.lit(""))
    )


def code_dictionary(ingredients: DataFrame) -> DataFrame:
    """Active coded ingredients by lower-case code; of several with one code, the smallest id.

    See :func:`code_clashes` for those.
    """
    return ingredients.where(F.col("is_active") & F.col("e_code").isNotNull()).groupBy(F.lower("e_code").alias("key")).agg(
        F.min("ingredient_id").alias("ingredient_id")).select(F.lit("code").alias("by"), "key", "ingredient_id", F.lit(1.0).alias("match_score"))


def code_clashes(ingredients: DataFrame) -> DataFrame:
    """Codes that several active ingredients carry, whatever their case, with their number."""
    live = ingredients.where(F.col("is_active") & F.col("e_code").isNotNull())
    return live.groupBy(F.lower("e_code").alias("key")).agg(F.count(F.lit(1)).alias("ingredients")).where("ingredients > 1")


def name_dictionary(ingredients: DataFrame, aliases: DataFrame, review: DataFrame) -> DataFrame:
    """Names owned by exactly one active ingredient and not under review, best confidence kept.

    Owners are counted after the active filter. A name has one owner exactly when its smallest
    and largest owner agree, so one partial aggregate is enough.
    """
    live = ingredients.where("is_active").select("ingredient_id")
    usable = aliases.where("normalized_alias <> ''").join(review.select("normalized_alias"), "normalized_alias", "left_anti").join(
        live, "ingredient_id", "left_semi"
    )
    owners = usable.groupBy("normalized_alias").agg(
        F.min("ingredient_id").alias("ingredient_id"),
        F.max("ingredient_id").alias("_last"),
        F.max("confidence").cast("double").alias("match_score"),
    )
    return owners.where(F.col("ingredient_id") == F.col("_last")).select(
        F.lit("name").alias("by"), F.col("normalized_alias").alias("key"), "ingredient_id", "match_score"
    )


def match_dictionary(ingredients: DataFrame, aliases: DataFrame, review: DataFrame) -> DataFrame:
    """Codes and unique names in one look-up table, so tokens are joined once."""
    return code_dictionary(ingredients).unionByName(name_dictionary(ingredients, aliases, review))


def resolve_tokens(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Left join of keyed tokens with the dictionary; ``ingredient_id`` is null when unmatched.

    No broadcast is forced: a written dictionary has a known size and is broadcast only below the
    session's threshold. Beyond it the join shuffles on the key, and the adaptive skew split divides a
    name that fills a third of all labels, since only the small side is repeated.
    """
    return tokens.join(dictionary, ["by", "key"], "left").withColumn(
        "matched_by",
        F.when(F.col("ingredient_id").isNotNull(), F.when(F.col("by") == "code", "e_code").otherwise("alias")),
    )


def first_positions(resolved: DataFrame, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """First position of every matched ingredient of a label."""
    return resolved.where(F.col("ingredient_id").isNotNull()).groupBy(*keys, "ingredient_id").agg(
        F.min("pos").alias("pos")
    )


def review_tokens(resolved: DataFrame, uncertain: Column) -> DataFrame:
    """Tokens a person should look at: unmatched, empty, or all of an uncertain label."""
    return resolved.where(
        F.col("ingredient_id").isNull() | (F.col("token") == "") | F.coalesce(uncertain, F.lit(False))
    )
