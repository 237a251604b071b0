"""Personal exclusions: legacy identifiers, imports, snapshots and replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LEGACY = "legacy_preference_id"
ID_MAX_CHARS = 200


def legacy_targets(matches: DataFrame, aliases: DataFrame, review: DataFrame) -> DataFrame:
    """(requested, ingredient_id) of every legacy identifier, without repeats."""
    parts = [
        matches.select(F.col("legacy_ingredient_id").cast("string").alias("requested"), "ingredient_id"),
        *[
            t.where(F.col("source") == LEGACY).select(F.col("alias").alias("requested"), "ingredient_id")
            for t in (aliases, review)
        ],
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.distinct()


def widened_exclusions(requested: DataFrame, targets: DataFrame) -> DataFrame:
    """Exclusions as given plus the ingredients their legacy identifiers stand for."""
    own = requested.select("user_id", F.col("requested").cast("string").alias("excluded_id"))
    more = requested.join(targets, "requested").select(
        "user_id", F.col("ingredient_id").cast("string").alias("excluded_id")
    )
    return own.unionByName(more).distinct()


def import_outcome(requested: DataFrame, ingredients: DataFrame, targets: DataFrame) -> DataFrame:
    """Each (user, requested id) with its one active ingredient, or null when unresolved.

    Candidates are found per distinct requested id, not per user.
    """
    active = ingredients.where("is_active").select("ingredient_id")
    own = active.select(F.col("ingredient_id").cast("string").alias("requested"), "ingredient_id")
    candidates = own.unionByName(targets.join(active, "ingredient_id", "left_semi").select("requested", "ingredient_id"))
    single = candidates.groupBy("requested").agg(
        F.min("ingredient_id").alias("ingredient_id"), F.max("ingredient_id").alias("_last")
    ).where(F.col("ingredient_id") == F.col("_last")).drop("_last")
    return requested.select("user_id", "requested").distinct().join(single, "requested", "left").select(
        "user_id", "requested", "ingredient_id",
        F.when(F.length("requested") > ID_MAX_CHARS, "rejected_id")
        .when(F.col("ingredient_id").isNull(), "unresolved").otherwise("resolved").alias("outcome"),
    )


def preference_catalog(ingredients: DataFrame, targets: DataFrame) -> DataFrame:
    """Active ingredients with the sorted array of their legacy identifiers."""
    legacy = targets.groupBy("ingredient_id").agg(F.array_sort(F.collect_set("requested")).alias("legacy_ids"))
    return ingredients.where("is_active").join(legacy, "ingredient_id", "left").withColumn(
        "legacy_ids", F.coalesce("legacy_ids", F.array().cast("array<string>"))
    )


def preference_snapshot(users: DataFrame, preferences: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Per user: sorted exclusion list, revision and import flag with defaults."""
    # An exclusion list is a set of catalog identifiers, so its size is bounded by the catalog.
    lists = exclusions.groupBy("user_id").agg(F.array_sort(F.collect_set("ingredient_id")).alias("excluded"))
    return (
        users.join(preferences, "user_id", "left").join(lists, "user_id", "left")
        .select(
            "user_id",
            F.coalesce("excluded", F.array().cast(lists.schema["excluded"].dataType)).alias("excluded"),
            F.coalesce("revision", F.lit(0)).alias("revision"),
            F.col("local_imported_at").isNotNull().alias("local_imported"),
        )
    )


def coded_exclusions(exclusions: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Active coded exclusions of users with upper-case codes."""
    coded = ingredients.where(F.col("is_active") & F.col("e_code").isNotNull()).select(
        "ingredient_id", F.upper("e_code").alias("e_code")
    )
    return exclusions.select("user_id", "ingredient_id").join(coded, "ingredient_id")


def replace_exclusions(
    requests: DataFrame, items: DataFrame, current: DataFrame, preferences: DataFrame, ingredients: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Replace a user's exclusions when the revision matches and every id is active.

    ``requests`` is (user_id, revision), ``items`` (user_id, ingredient_id). Returns the new
    exclusion rows of all users and the outcome per request.
    """
    active = ingredients.where("is_active").select("ingredient_id", F.lit(True).alias("_active"))
    bad = (
        items.join(active, "ingredient_id", "left").groupBy("user_id")
        .agg(F.count_if(F.col("_active").isNull()).alias("inactive"))
    )
    stored = preferences.select("user_id", F.col("revision").alias("_stored"))
    outcome = (
        requests.join(stored, "user_id", "left").join(bad, "user_id", "left")
        .select(
            "user_id", "revision",
            F.when(F.coalesce("_stored", F.lit(0)) != F.col("revision"), "stale_revision")
            .when(F.coalesce("inactive", F.lit(0)) > 0, "inactive_ingredient")
            .otherwise("accepted").alias("outcome"),
        )
    )
    accepted = outcome.where("outcome = 'accepted'").select("user_id")
    kept = current.select("user_id", "ingredient_id").join(accepted, "user_id", "left_anti")
    added = items.select("user_id", "ingredient_id").join(accepted, "user_id", "left_semi").distinct()
    return kept.unionByName(added), outcome
