"""Catalog service tables: search, paging, detail, counts and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from provisor.functions.codes import first_code
from provisor.functions.text import normalize_text

CATALOG_VERSION = 2


def search(
    spark: SparkSession, ingredients: DataFrame, aliases: DataFrame, query: str, kind: str = "all"
) -> DataFrame:
    """Active ingredients whose names, code or aliases contain the query as plain text."""
    term = query.strip().lower()
    keys = spark.range(1).select(
        normalize_text(F.lit(query)).alias("n"), F.lower(F.coalesce(first_code(F.lit(query)), F.lit(term))).alias("c")
    ).first()
    rows = ingredients.where("is_active")
    if kind == "additives":
        rows = rows.where("e_code is not null")
    elif kind == "foods":
        rows = rows.where("e_code is null")
    if not term:
        return rows
    own = F.lower("name").contains(term) | F.lower(F.coalesce("e_code", F.lit(""))).contains(keys.c)
    if "name_en" in rows.columns:
        own = own | F.lower(F.coalesce("name_en", F.lit(""))).contains(term)
    if not keys.n:
        return rows.where(own)
    named = aliases.where(F.col("normalized_alias").contains(keys.n)).select("ingredient_id").distinct().withColumn(
        "_named", F.lit(True)
    )
    return rows.join(named, "ingredient_id", "left").where(own | F.coalesce("_named", F.lit(False))).drop("_named")


def with_status(rows: DataFrame, status: str) -> DataFrame:
    """Filter on the assessed severity; applied before paging."""
    if status == "all":
        return rows
    return rows.where(F.col("severity").isin(*(("avoid", "forbidden") if status == "restricted" else (status,))))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def next_page(rows: DataFrame, after: tuple | None, limit: int) -> DataFrame:
    """Keyset paging by (lower name, id): no row repeats or is lost between pages."""
    name = F.lower("name")
    if after is not None:
        last_name, last_id = after
        rows = rows.where((name > last_name) | ((name == last_name) & (F.col("ingredient_id") > last_id)))
    return rows.orderBy(name, "ingredient_id").limit(limit)


def with_total(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page with the size of the whole filtered set beside each of its rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    top = page(rows, order, limit, offset).withColumn("_one", F.lit(1))
    return top.join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")


def ingredient_detail(ingredients: DataFrame, tags: DataFrame, aliases: DataFrame, severity: DataFrame) -> DataFrame:
    """Ingredients with sorted distinct functions, origins and aliases, and the severity."""
    kinds = tags.groupBy("ingredient_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("tag_type") == "category", F.col("name")))).alias("functions"),
        F.array_sort(F.collect_set(F.when(F.col("tag_type") == "origin", F.col("name")))).alias("origins"),
    )
    names = aliases.groupBy("ingredient_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    empty = F.array().cast("array<string>")
    return (
        ingredients.where("is_active")
        .join(kinds, "ingredient_id", "left").join(names, "ingredient_id", "left")
        .join(severity.select("ingredient_id", "severity", "rules"), "ingredient_id", "left")
        .withColumns({c: F.coalesce(c, empty) for c in ("functions", "origins", "aliases")})
    )


def alternative_names(detail: DataFrame) -> DataFrame:
    """Aliases without the display names and spellings of the own code, first of each form."""
    rows = detail.select(
        "ingredient_id", "name", "name_en", "e_code", F.posexplode("aliases").alias("pos", "alias")
    )
    form = _display_form(F.col("alias"))
    rows = rows.withColumn("form", form)
    code = _code_key(F.col("e_code"))
    kept = rows.where(
        (F.col("form") != "")
        & (F.col("form") != _display_form(F.col("name")))
        & (F.col("form") != _display_form(F.coalesce("name_en", F.lit(""))))
        & (code.isNull() | (_code_key(F.col("alias")) != code))
    )
    first = kept.groupBy("ingredient_id", "form").agg(F.min_by("alias", "pos").alias("alias"), F.min("pos").alias("pos"))
    return first.groupBy("ingredient_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "alias"))), lambda x: x["alias"]).alias("names")
    )


def _display_form(text: Column) -> Column:
    return F.replace(normalize_text(text), F.lit("_"), F.lit(" "))


def _code_key(text: Column) -> Column:
    return F.replace(F.regexp_replace(_display_form(text), r"^е(?=\s*\d)", "e"), F.lit(" "), F.lit(""))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table; one aggregate each, united."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def readiness(ingredients: DataFrame, versions: DataFrame) -> DataFrame:
    """One row: does the catalog have the supported version only, and any active ingredient."""
    version = versions.agg(
        F.coalesce(F.bool_and(F.col("version") == CATALOG_VERSION), F.lit(False)).alias("version_ok")
    )
    active = ingredients.where("is_active").limit(1).agg((F.count(F.lit(1)) > 0).alias("has_active"))
    joined = version.withColumn("_k", F.lit(1)).join(active.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return joined.withColumn("ready", F.col("version_ok") & F.col("has_active"))


def require_ready(ingredients: DataFrame, versions: DataFrame) -> None:
    """Guard with an action: fail when the catalog is not usable."""
    if not readiness(ingredients, versions).first().ready:
        raise ValueError("catalog has no supported version or no active ingredient")


def table_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """Order-free content fingerprint per table.

    The md5 of each row is cut into four numbers which are added up, so the whole table combines
    map-side: neither row order nor one task's memory matters. Repeated rows count.
    """
    parts = []
    for name, df in tables.items():
        digest = F.md5(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
        parts.append(row_hash_fingerprint(df.select(digest.alias("h")), name))
    return reduce(DataFrame.unionByName, parts)


def row_hash_fingerprint(hashes: DataFrame, name: str) -> DataFrame:
    """Fingerprint of one table from a column ``h`` of md5 hex strings."""
    words = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(4)]
    zero = F.lit(0).cast("decimal(38,0)")
    sums = hashes.agg(
        F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(w), zero).alias(f"w{i}") for i, w in enumerate(words)]
    )
    text = F.concat_ws("|", "rows", *[F.col(f"w{i}").cast("string") for i in range(4)])
    return sums.select(F.lit(name).alias("table_name"), "rows", F.md5(text).alias("digest"))


def catalog_fingerprint(per_table: DataFrame) -> DataFrame:
    """One fingerprint over the (few) table digests, in table order."""
    digests = F.transform(F.array_sort(F.collect_list(F.struct("table_name", "digest"))), lambda x: x["digest"])
    return per_table.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(digests, "|"), 256)).alias("fingerprint"))
