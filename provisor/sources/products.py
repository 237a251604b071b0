"""Product records: pruned scan, lookup by barcode, display fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from provisor.schemas import PRODUCT_SCHEMA
from provisor.session import cut_lineage

NAMELESS = "Продукт без названия"


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Product records (JSON lines) with the fixed projection; the ingredient tree stays JSON text."""
    return spark.read.schema(PRODUCT_SCHEMA).json(path)


def filled(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.btrim(c) != "", c)


def lookup(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Outcome per requested barcode: not_found, no_composition or analysable."""
    known = products.select(
        F.col("code").alias("barcode"),
        F.coalesce(F.nullif("product_name", F.lit("")), F.nullif("generic_name", F.lit("")), F.lit(NAMELESS)).alias("product_name"),
        F.nullif("brands", F.lit("")).alias("brand"), filled("ingredients_text").alias("ingredients_text"), F.lit(True).alias("_found"))
    return requests.join(known, "barcode", "left").select(
        *requests.columns, "product_name", "brand", "ingredients_text",
        F.when(F.col("_found").isNull(), "not_found").when(F.col("ingredients_text").isNull(), "no_composition")
        .otherwise("analysable").alias("outcome"))


def display_fields(products: DataFrame) -> DataFrame:
    """Name with fallback, brand, first category (or first tag without its language) and quantity."""
    own = F.get(F.filter(F.transform(F.split("categories", ","), lambda c: F.btrim(c)), lambda c: c != ""), F.lit(0))
    tag = F.replace(F.regexp_replace(F.get("categories_tags", F.lit(0)), "^[a-z]{2,3}:", ""), F.lit("-"), F.lit(" "))
    return products.select(
        "code", F.coalesce(filled("product_name"), filled("generic_name"), F.lit(NAMELESS)).alias("name"),
        filled("brands").alias("brand"),
        F.when(filled("categories").isNotNull(), own).otherwise(tag).alias("category"), filled("quantity").alias("quantity"))


def _tree_names(products: DataFrame) -> DataFrame:
    """(code, names): the names in each product's ingredient tree, depth first, at any depth.

    A level of the trees is one written table of nodes; the loop ends at the first empty level.
    """
    child = F.variant_get("node", "$.ingredients", "array<variant>")
    level = products.where("ingredients is not null").select(
        "code", F.posexplode(F.variant_get(F.try_parse_json("ingredients"), "$", "array<variant>")).alias("at", "node"))
    level = level.select("code", F.array("at").alias("path"), "node")
    named = None
    while True:
        text, tag = (F.variant_get("node", f"$.{f}", "string") for f in ("text", "id"))
        name = F.coalesce(filled(text), F.nullif(F.regexp_replace(tag, "(?i)^[a-z]{2}:", ""), F.lit("")))
        level = cut_lineage(level.select("code", "path", name.alias("name"), child.alias("below")), "tree-level")
        if level.isEmpty():
            break
        own = level.where("name is not null").select("code", "path", "name")
        named = own if named is None else named.unionAll(own)
        level = level.select("code", "path", F.posexplode("below").alias("at", "node")).select("code", F.concat("path", F.array("at")).alias("path"), "node")
    if named is None:
        return products.where(F.lit(False)).select("code", F.lit(None).cast("string").alias("names"))
    ordered = F.array_sort(F.collect_list(F.struct("path", "name")))
    return named.groupBy("code").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), ", ").alias("names"))


def composition_text(products: DataFrame) -> DataFrame:
    """Composition text; without one, the names of the ingredient tree depth first.

    A tree that is no JSON array has no names.
    """
    own = products.select("code", "ingredients", filled("ingredients_text").alias("_text"))
    trees = _tree_names(own.where("_text is null"))
    return own.join(trees, "code", "left").select("code", F.coalesce("_text", "names", F.lit("")).alias("composition"))
