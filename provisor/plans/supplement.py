"""Reviewed additions to a flat catalog: insert what is missing, update what is there, delete nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provisor.functions.ids import name_uuid
from provisor.functions.text import normalize_text
from provisor.operators import quality
from provisor.operators.aliases import ID_PREFIX


def ensure_rows(rows: DataFrame, wanted: DataFrame, keys: list[str], updates: list[str]) -> tuple[DataFrame, DataFrame]:
    """Insert wanted rows whose natural key is absent; set ``updates`` on the one that matches.

    Returns the table and violations for keys that match more than one row.
    """
    fresh = wanted.join(rows.select(*keys).distinct(), keys, "left_anti")
    changed = wanted.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in updates], F.lit(True).alias("_hit"))
    out = rows.join(changed, keys, "left")
    out = out.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in updates}).select(*rows.columns)
    counts = rows.join(wanted.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return out.unionByName(fresh, allowMissingColumns=True), quality.violations("supplement", counts, "ambiguous_match", key, F.col("n"))


def supplement_catalog(tables: dict[str, DataFrame], items: DataFrame, source: dict[str, str], keep_bare: Column, prefix: str = ID_PREFIX):
    """Catalog with the reviewed items and the violations found on the way.

    ``items``: e_code, name, name_en, category, origin, description, full_description, aliases
    (array), locator, explanation, title, pdf_url, pdf_page. ``source``: source_id, code, title, url.
    ``keep_bare`` is false for items whose plain names must not become aliases.
    """
    spark = items.sparkSession
    out, found = dict(tables), []

    def ensure(table: str, wanted: DataFrame, keys: list[str], updates: list[str]):
        out[table], bad = ensure_rows(out[table], wanted, keys, updates)
        found.append(bad)

    ensure("regulatory_sources", spark.createDataFrame([source], "source_id string, code string, title string, url string"), ["code"], [])
    by_code = tables["ingredients"].where("e_code is not null").select(
        F.lower("e_code").alias("_code"), F.col("ingredient_id").alias("_id"), F.col("name").alias("_old_name"))
    known = items.withColumn("_code", F.lower("e_code")).join(by_code, "_code", "left").withColumn(
        "ingredient_id", F.coalesce("_id", name_uuid(prefix, "ingredient", F.col("e_code"))))
    fields = ["name", "name_en", "category", "description", "full_description"]
    ensure("ingredients", known.select("ingredient_id", F.lit("food_additive").alias("kind"), "e_code", *fields, F.lit(True).alias("is_active")), ["ingredient_id"], fields)
    plain = F.when(keep_bare, F.array(F.coalesce("_old_name", "name"), F.col("name"), F.col("name_en"))).otherwise(F.array().cast("array<string>"))
    names = F.array_distinct(F.array_compact(F.concat(F.array("e_code"), F.col("aliases"), plain)))
    aliases = known.select("ingredient_id", F.posexplode(names).alias("i", "alias")).withColumn("normalized_alias", normalize_text(F.col("alias")))
    first = aliases.groupBy("ingredient_id", "normalized_alias").agg(F.min_by("alias", "i").alias("alias")).select(
        name_uuid(prefix, "alias", F.concat_ws("/", "ingredient_id", "normalized_alias")).alias("alias_id"), "ingredient_id", "alias", "normalized_alias",
        F.when(F.col("alias").rlike(r"^[\x00-\x7f]*$"), "en").otherwise("ru").alias("language"), F.lit(1).cast("decimal(3,2)").alias("confidence"))
    out["ingredient_aliases"] = out["ingredient_aliases"].unionByName(
        first.join(tables["ingredient_aliases"].select("ingredient_id", "normalized_alias"), ["ingredient_id", "normalized_alias"], "left_anti"),
        allowMissingColumns=True)
    tags = known.select("ingredient_id", F.explode(F.array(
        F.struct(F.lit("category").alias("tag_type"), F.col("category").alias("name")),
        F.struct(F.lit("origin").alias("tag_type"), F.col("origin").alias("name")))).alias("t")).select("ingredient_id", "t.*").where(
        "coalesce(name, '') <> ''").withColumn("tag_id", name_uuid(prefix, "tag", F.concat_ws("/", "ingredient_id", "tag_type", "name")))
    out["ingredient_tags"] = out["ingredient_tags"].unionByName(
        tags.join(tables["ingredient_tags"].select("ingredient_id", "tag_type").distinct(), ["ingredient_id", "tag_type"], "left_anti"), allowMissingColumns=True)
    rules = known.select(
        name_uuid(prefix, "rule", F.col("e_code")).alias("rule_id"), "ingredient_id", F.lit(source["source_id"]).alias("source_id"),
        F.lit("BANNED").alias("regulatory_status"), "title", "explanation",
        F.concat(F.col("locator"), F.lit(" | "), F.col("pdf_url")).alias("citation"), F.lit("use_as_food_additive").alias("scope"),
        F.lit("verified_official_publication").alias("verification_status"), F.lit("notice").alias("evaluation"), F.lit("exact_only").alias("match_policy"),
        F.lit(True).alias("primary_basis_required"), F.lit(False).alias("production_ready"), F.lit(False).alias("product_compliance_assessed"))
    rule_key = ["ingredient_id", "source_id", "regulatory_status"]
    ensure("ingredient_rules", rules, rule_key, ["title", "explanation", "citation"])
    stored = out["ingredient_rules"].select("rule_id", *rule_key)
    evidence = known.join(stored.where((F.col("source_id") == source["source_id"]) & (F.col("regulatory_status") == "BANNED")), "ingredient_id").select(
        name_uuid(prefix, "evidence", F.col("e_code")).alias("evidence_id"), "rule_id", "source_id", F.col("pdf_url").alias("url"), "locator",
        F.lit("official_explanation").alias("document_role"), F.lit("verified_official_publication").alias("verification_status"), "pdf_page")
    ensure("rule_evidence", evidence, ["rule_id", "source_id", "url"], ["locator"])
    return out, quality.union_all(found)
