"""Snapshots, backups, bundles and product files, written from the driver tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisor.operators import quality
from provisor.session import shared_dir
from provisor.sinks import snapshots
from provisor.sources.bundles import read_bundle
from provisor.sources.products import read_products
from provisor_checks.registry import check


def parts(t, name="p_name"):
    return t.part.select(F.col("p_partkey").alias("ingredient_id"), F.col(name).alias("name"), (F.col("p_size") % 4 != 0).alias("is_active"))


@check("snk_1_stored_snapshot", """
    SELECT p_partkey AS ingredient_id, p_brand AS name, p_size % 4 <> 0 AS is_active, 2 AS version, (SELECT count(*) FROM part) AS counted FROM part""")
def _(t):
    root = shared_dir(t.spark, "snapshots")
    snapshots.write_snapshot({"ingredients": parts(t), "ingredient_rules": t.region}, root)
    counted = snapshots.write_snapshot({"ingredients": parts(t, "p_brand"), "ingredient_rules": t.region}, root)
    version = snapshots.current_version(t.spark, root)
    return snapshots.read_current(t.spark, root, ["ingredients"])["ingredients"].select("*", F.lit(version).alias("version"), F.lit(counted["ingredients"]).alias("counted"))


@check("snk_2_first_load", """
    SELECT p_partkey AS ingredient_id, p_name AS name, p_size % 4 <> 0 AS is_active, 'loaded' AS first, 'preserved' AS second FROM part""")
def _(t):
    root = shared_dir(t.spark, "first-load")
    outcomes = [snapshots.load_if_empty({"ingredients": parts(t, name)}, root) for name in ("p_name", "p_brand")]
    return snapshots.read_current(t.spark, root, ["ingredients"])["ingredients"].select("*", F.lit(outcomes[0]).alias("first"), F.lit(outcomes[1]).alias("second"))


@check("snk_8_backup", "SELECT p_partkey AS ingredient_id, p_name AS name, p_size % 4 <> 0 AS is_active, true AS refused FROM part")
def _(t):
    """A second backup to one place is refused and leaves the first as it is."""
    from pyspark.errors import AnalysisException

    path, refused = shared_dir(t.spark, "backup"), False
    snapshots.backup(parts(t), path)
    try:
        snapshots.backup(parts(t, "p_brand"), path)
    except AnalysisException:
        refused = True
    return t.spark.read.parquet(path).withColumn("refused", F.lit(refused))


@check("src_2_bundle_tables", """
    SELECT 'ingredients' AS table_name, p_partkey::VARCHAR AS id, p_name AS name FROM part
    UNION ALL SELECT 'regulatory_sources', 's' || (p_partkey % 9), 'list ' || (p_partkey % 9) FROM part GROUP BY p_partkey % 9""")
def _(t):
    """Nine bundle documents, one file each."""
    path = shared_dir(t.spark, "bundles")
    item = F.struct(F.col("p_partkey").cast("string").alias("id"), F.lit("food").alias("kind"), F.col("p_name").alias("canonical_name_ru"))
    docs = t.part.groupBy((F.col("p_partkey") % 9).alias("doc")).agg(F.collect_list(item).alias("ingredients"))
    source = F.array(F.struct(F.concat(F.lit("s"), "doc").alias("id"), F.concat(F.lit("list "), "doc").alias("title")))
    text = F.to_json(F.struct(F.struct(F.lit(2).alias("schema_version")).alias("metadata"), "ingredients", source.alias("regulatory_sources")))
    docs.select("doc", text.alias("value")).repartition("doc").write.partitionBy("doc").text(path)
    bundle = read_bundle(t.spark, path)
    return bundle["ingredients"].select(F.lit("ingredients").alias("table_name"), "id", F.col("canonical_name_ru").alias("name")).unionAll(
        bundle["regulatory_sources"].select(F.lit("regulatory_sources"), "id", "title"))


@check("src_3_product_records", """
    SELECT p_partkey::VARCHAR AS code, p_name AS product_name, 'a:' || p_type AS tag, CASE WHEN p_size % 2 = 0 THEN '[{"text":"' || p_brand || '"}]' END AS ingredients FROM part""")
def _(t):
    path = shared_dir(t.spark, "product-records")
    tree = F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.col("p_brand").alias("text"))))
    t.part.select(
        F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("product_name"), F.array(F.concat(F.lit("a:"), "p_type")).alias("categories_tags"),
        tree.alias("ingredients"), F.lit("not read").alias("other")).write.json(path)
    return read_products(t.spark, path).select("code", "product_name", F.get("categories_tags", F.lit(0)).alias("tag"), "ingredients")


@check("dq_10_rules_by_dataset", """
    SELECT 'unnamed' AS rule, p_partkey::VARCHAR AS key FROM part WHERE p_size % 4 = 0
    UNION ALL SELECT 'no_region', n_nationkey::VARCHAR FROM nation WHERE n_regionkey = 1""")
def _(t):
    """Two bundles: one names its rule set, the other one has none of its own and takes the general one."""
    tables = {"ingredients": parts(t), "nations": t.nation}
    general = lambda x: quality.failing_rows("ingredients", x["ingredients"], "ingredient_id", {"unnamed": F.col("is_active")})
    own = {"places": lambda x: quality.failing_rows("nations", x["nations"], "n_nationkey", {"no_region": F.col("n_regionkey") != 1})}
    metadata = t.region.select(F.when(F.col("r_regionkey") == 0, "places").otherwise("other").alias("dataset"))
    return quality.dataset_violations(metadata, tables, own, general).select("rule", F.col("key").cast("string").alias("key"))
