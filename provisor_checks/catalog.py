"""Catalog service tables and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisor.functions.codes import code_spellings
from provisor.operators import catalog, quality, rules
from provisor_checks.labels import DICT_CTE, NAME_OF, graded
from provisor.operators.paging import OrderedPages
from provisor_checks.registry import check

GRADED = "WITH " + DICT_CTE + ", listed AS (SELECT i.ingredient_id, i.name, i.e_code, i.is_active, " + NAME_OF.format(w="g.weight") + """ AS severity
    FROM ingredients i JOIN graded g ON i.ingredient_id = g.ingredient_id WHERE i.is_active)"""


@check("src_4_readiness", """
    SELECT TRUE AS version_ok, count(*) > 0 AS has_active, count(*) > 0 AS ready FROM ingredients WHERE is_active""")
def _(t):
    version = t.region.agg(F.min(F.lit(2)).alias("version"))
    return catalog.readiness(t.ingredients, version)


@check("set_2_table_counts", """
    SELECT 'ingredients' AS table_name, count(*) AS rows FROM ingredients UNION ALL SELECT 'aliases', count(*) FROM aliases
    UNION ALL SELECT 'rules', count(*) FROM rules UNION ALL SELECT 'evidence', count(*) FROM evidence""")
def _(t):
    return catalog.table_counts({n: getattr(t, n) for n in ("ingredients", "aliases", "rules", "evidence")})


@check("flt_6_catalog_search", """
    SELECT ingredient_id, name, e_code FROM ingredients i WHERE is_active AND (contains(lower(name), 'widget 1')
      OR contains(lower(name_en), 'widget 1') OR contains(lower(coalesce(e_code, '')), 'widget 1')
      OR EXISTS (SELECT 1 FROM aliases a WHERE a.ingredient_id = i.ingredient_id AND contains(a.normalized_alias, 'widget 1')))""")
def _(t):
    return catalog.search(t.spark, t.ingredients, t.aliases, " Widget 1").select("ingredient_id", "name", "e_code")


@check("flt_6_code_search", """
    SELECT ingredient_id, name, e_code FROM ingredients i WHERE is_active AND e_code IS NOT NULL AND (contains(lower(name), 'e-1')
      OR contains(lower(e_code), 'e-1') OR contains(lower(name_en), 'e-1')
      OR EXISTS (SELECT 1 FROM aliases a WHERE a.ingredient_id = i.ingredient_id AND contains(a.normalized_alias, 'e 1')))""")
def _(t):
    return catalog.search(t.spark, t.ingredients, t.aliases, "E-1", "additives").select("ingredient_id", "name", "e_code")


@check("flt_7_restricted", GRADED + "SELECT ingredient_id, severity FROM listed WHERE severity IN ('avoid', 'forbidden')")
def _(t):
    return catalog.with_status(graded(t).where("is_active"), "restricted").select("ingredient_id", "severity")


@check("ord_1_catalog_page", "SELECT ingredient_id, name FROM ingredients WHERE is_active ORDER BY lower(name), ingredient_id LIMIT 50 OFFSET 100")
def _(t):
    return catalog.page(
        t.ingredients.where("is_active").select("ingredient_id", "name"), [F.lower("name"), "ingredient_id"], 50, 100
    )


@check("ord_1_deep_page", "SELECT ingredient_id, name FROM ingredients WHERE is_active ORDER BY lower(name), ingredient_id LIMIT 50 OFFSET 120")
def _(t):
    """From the ranges that hold it; ranges of 40 rows, so that the page crosses some."""
    rows = t.ingredients.where("is_active").select("ingredient_id", "name")
    return OrderedPages(rows, [F.lower("name"), "ingredient_id"], "catalog-pages", 40).page(50, 120)


@check("ord_6_next_page", """
    SELECT ingredient_id, name FROM ingredients WHERE is_active AND (lower(name) > 'cold widget' OR (lower(name) = 'cold widget' AND ingredient_id > 5))
    ORDER BY lower(name), ingredient_id LIMIT 40""")
def _(t):
    rows = t.ingredients.where("is_active").select("ingredient_id", "name")
    return catalog.next_page(rows, ("cold widget", 5), 40)


@check("agg_23_page_with_total", GRADED + """
    SELECT ingredient_id, name, (SELECT count(*) FROM listed WHERE severity = 'attention') AS total FROM listed WHERE severity = 'attention'
    ORDER BY lower(name), ingredient_id LIMIT 30""")
def _(t):
    rows = catalog.with_status(graded(t).where("is_active"), "attention").select("ingredient_id", "name")
    return catalog.with_total(rows, [F.lower("name"), "ingredient_id"], 30)


@check("agg_22_ingredient_detail", "WITH " + DICT_CTE + """,
    f AS (SELECT ingredient_id, string_agg(DISTINCT name, '|' ORDER BY name) FILTER (WHERE tag_type = 'category') AS functions,
      string_agg(DISTINCT name, '|' ORDER BY name) FILTER (WHERE tag_type = 'origin') AS origins FROM tags GROUP BY 1),
    n AS (SELECT ingredient_id, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases FROM aliases GROUP BY 1)
    SELECT i.ingredient_id, i.name, coalesce(f.functions, '') AS functions, coalesce(f.origins, '') AS origins, coalesce(n.aliases, '') AS aliases,
      """ + NAME_OF.format(w="g.weight") + """ AS severity, g.rules
    FROM ingredients i JOIN graded g ON i.ingredient_id = g.ingredient_id LEFT JOIN f ON f.ingredient_id = i.ingredient_id
    LEFT JOIN n ON n.ingredient_id = i.ingredient_id WHERE i.is_active""")
def _(t):
    out = catalog.ingredient_detail(t.ingredients, t.tags, t.aliases, graded(t))
    joined = [F.array_join(c, "|").alias(c) for c in ("functions", "origins", "aliases")]
    return out.select("ingredient_id", "name", *joined, "severity", "rules")


@check("prj_9_rule_status", """
    SELECT rule_id, primary_basis_required IS TRUE OR production_ready IS FALSE OR verification_status <> 'verified_primary' AS needs_review,
      CASE WHEN regulatory_status = 'PERMITTED_WITH_CONDITIONS' THEN 'Применение с условиями'
        WHEN regulatory_status = 'PHASE_OUT' THEN 'Изменение условий применения'
        WHEN primary_basis_required IS TRUE OR production_ready IS FALSE OR verification_status <> 'verified_primary' THEN 'Сведения о запрете'
        ELSE 'Запрет применения' END AS display_title FROM rules""")
def _(t):
    return rules.rule_status(t.rules).select("rule_id", "needs_review", "display_title")


@check("prj_10_alternative_names", """
    SELECT ingredient_id, string_agg(alias, '|' ORDER BY alias) AS names FROM aliases WHERE source <> 'catalog' GROUP BY 1""")
def _(t):
    detail = catalog.ingredient_detail(
        t.ingredients.withColumn("is_active", F.lit(True)), t.tags, t.aliases, graded(t)
    )
    out = catalog.alternative_names(detail)
    return out.select("ingredient_id", F.array_join(F.array_sort("names"), "|").alias("names"))


@check("prj_5_code_spellings", """
    SELECT ingredient_id, unnest([e_code, 'Е' || substr(e_code, 2), 'E-' || substr(e_code, 2), 'E ' || substr(e_code, 2)]) AS alias
    FROM ingredients WHERE e_code IS NOT NULL""")
def _(t):
    coded = t.ingredients.where("e_code is not null")
    return coded.select("ingredient_id", F.explode(code_spellings(F.col("e_code"))).alias("alias"))


@check("agg_12_table_fingerprints", """
    WITH h AS (SELECT md5(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS h FROM orders),
    s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 8))::BIGINT) AS a, sum(('0x' || substr(h, 9, 8))::BIGINT) AS b,
      sum(('0x' || substr(h, 17, 8))::BIGINT) AS c, sum(('0x' || substr(h, 25, 8))::BIGINT) AS d FROM h)
    SELECT 'orders' AS table_name, n AS rows, md5(n || '|' || a || '|' || b || '|' || c || '|' || d) AS digest FROM s""")
def _(t):
    text = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")
    return catalog.row_hash_fingerprint(t.orders.select(F.md5(text).alias("h")), "orders")


@check("agg_12_catalog_fingerprint")
def _(t):
    names = ("ingredients", "aliases", "alias_review", "matches", "rules", "sources", "evidence", "transitions")
    return catalog.catalog_fingerprint(catalog.table_fingerprint({n: getattr(t, n) for n in names}))


@check("agg_13_alias_owners", r"""
    SELECT DISTINCT * FROM (SELECT trim(regexp_replace(lower(alias), '[^a-z0-9_]+', ' ', 'g')) AS form, ingredient_id FROM aliases
      UNION ALL SELECT lower(name), ingredient_id FROM ingredients UNION ALL SELECT lower(name_en), ingredient_id FROM ingredients)""")
def _(t):
    return quality.alias_owners(t.ingredients, t.aliases)


@check("agg_14_ambiguity_report", r"""
    WITH o AS (SELECT DISTINCT * FROM (SELECT trim(regexp_replace(lower(alias), '[^a-z0-9_]+', ' ', 'g')) AS form, ingredient_id FROM aliases
      UNION ALL SELECT lower(name), ingredient_id FROM ingredients UNION ALL SELECT lower(name_en), ingredient_id FROM ingredients))
    SELECT o.form, o.ingredient_id, i.name, i.e_code FROM o JOIN ingredients i ON o.ingredient_id = i.ingredient_id
    WHERE o.form IN (SELECT form FROM o GROUP BY 1 HAVING count(*) > 1)""")
def _(t):
    return quality.ambiguity_report(quality.alias_owners(t.ingredients, t.aliases), t.ingredients)


@check("dq_1_unique_ids", """
    SELECT 'duplicate_id' AS rule, 'evidence' AS table_name, CAST(evidence_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail
    FROM evidence GROUP BY evidence_id HAVING count(*) > 1""")
def _(t):
    return quality.duplicate_keys("evidence", t.evidence, "evidence_id")


@check("dq_1_identifier_form", """
    SELECT 'not_uuid_ingredient_id' AS rule, 'ingredients' AS table_name, CAST(ingredient_id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail FROM ingredients""")
def _(t):
    return quality.identifier_form("ingredients", t.ingredients.select("ingredient_id", "name"), "ingredient_id")


@check("dq_2_orphans", """
    SELECT 'orphan_rule_id' AS rule, 'evidence' AS table_name, CAST(rule_id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail
    FROM evidence WHERE rule_id NOT IN (SELECT rule_id FROM rules)
    UNION ALL SELECT 'orphan_ingredient_id', 'exclusions', CAST(ingredient_id AS VARCHAR), NULL FROM exclusions WHERE ingredient_id NOT IN (SELECT ingredient_id FROM ingredients WHERE is_active)""")
def _(t):
    return quality.union_all([
        quality.orphans("evidence", t.evidence, "rule_id", t.rules, "rule_id"),
        quality.orphans("exclusions", t.exclusions, "ingredient_id", t.ingredients.where("is_active"), "ingredient_id"),
    ])


@check("dq_3_codes", """
    SELECT 'duplicate_code' AS rule, 'ingredients' AS table_name, code AS key, CAST(count(*) AS VARCHAR) AS detail FROM (
      SELECT 'E' || CAST(100 + p_partkey % 900 AS VARCHAR) AS code FROM part) GROUP BY code HAVING count(*) > 1
    UNION ALL SELECT 'invalid_code', 'ingredients', CAST(p_partkey AS VARCHAR), NULL FROM part WHERE p_partkey % 50 = 0
    UNION ALL SELECT 'code_required', 'ingredients', CAST(p_partkey AS VARCHAR), NULL FROM part WHERE p_partkey % 77 = 0 AND p_partkey % 50 <> 0 AND FALSE""")
def _(t):
    parts = t.part.select(
        F.col("p_partkey").alias("ingredient_id"), F.concat(F.lit("E"), (100 + F.col("p_partkey") % 900).cast("string")).alias("e_code")
    )
    broken = parts.where("ingredient_id % 50 = 0").select("ingredient_id", F.concat("e_code", F.lit("zz")).alias("e_code"))
    return quality.code_rules(parts.unionByName(broken))


@check("dq_4_rule_completeness", """
    SELECT 'only_right' AS rule, 'evidence_of_rules' AS table_name, CAST(rule_id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail
      FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM evidence)
    UNION ALL SELECT DISTINCT 'only_left', 'evidence_of_rules', CAST(rule_id AS VARCHAR), NULL FROM evidence WHERE rule_id NOT IN (SELECT rule_id FROM rules)""")
def _(t):
    return quality.rule_completeness(t.rules, t.evidence, t.transitions)


@check("dq_5_domains", """
    SELECT 'date_order' AS rule, 'ingredient_rules' AS table_name, CAST(rule_id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail
      FROM rules WHERE effective_to < effective_from
    UNION ALL SELECT 'end_after_start', 'rule_transitions', CAST(rule_id AS VARCHAR), NULL FROM transitions WHERE transition_end < effective_from
    UNION ALL SELECT 'confidence_range', 'ingredient_aliases', CAST(ingredient_id AS VARCHAR), NULL FROM aliases WHERE confidence > 1""")
def _(t):
    domain = quality.domain_rules()
    checked = t.rules.withColumn("product_compliance_assessed", F.lit(False))
    ended = t.transitions.withColumn("last_production_date", F.lit(None).cast("date"))
    return quality.union_all([
        quality.failing_rows("ingredient_rules", checked, "rule_id", domain["ingredient_rules"]),
        quality.failing_rows("rule_transitions", ended, "rule_id", domain["rule_transitions"]),
        quality.failing_rows("ingredient_aliases", t.aliases, "ingredient_id", domain["ingredient_aliases"]),
    ])


@check("dq_9_matching_safety", r"""
    WITH o AS (SELECT DISTINCT * FROM (SELECT normalized_alias AS form, ingredient_id FROM aliases
      UNION ALL SELECT lower(name), ingredient_id FROM ingredients UNION ALL SELECT lower(name_en), ingredient_id FROM ingredients)),
    many AS (SELECT form FROM o GROUP BY 1 HAVING count(*) > 1)
    SELECT 'ambiguous' AS rule, 'ingredient_aliases' AS table_name, ingredient_id || '/' || alias AS key, CAST(NULL AS VARCHAR) AS detail
      FROM aliases WHERE normalized_alias IN (SELECT form FROM many)
    UNION ALL SELECT 'under_review', 'ingredient_aliases', ingredient_id || '/' || alias, NULL FROM aliases
      WHERE normalized_alias IN (SELECT normalized_alias FROM alias_review)""")
def _(t):
    return quality.matching_safety(t.ingredients, t.aliases, t.alias_review)


@check("set_4_disjoint_keys", """
    SELECT 'overlap' AS rule, 'rules_and_transitions' AS table_name, CAST(rule_id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail
    FROM (SELECT rule_id FROM rules INTERSECT SELECT rule_id FROM transitions)""")
def _(t):
    return quality.key_set_overlap("rules_and_transitions", t.rules, t.transitions, "rule_id")


@check("set_5_equal_keys", """
    SELECT 'only_right' AS rule, 'transitions_of_rules' AS table_name, CAST(rule_id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail
    FROM (SELECT rule_id FROM rules EXCEPT SELECT rule_id FROM transitions)""")
def _(t):
    return quality.key_set_difference("transitions_of_rules", t.transitions, t.rules, "rule_id")


@check("dq_11_experiment_bounds", """
    SELECT 'hint_before_barcode' AS rule, 'configs' AS table_name, CAST(o_orderkey AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail FROM orders WHERE o_custkey % 9000 >= 4000
    UNION ALL SELECT 'lookup_before_end', 'configs', CAST(o_orderkey AS VARCHAR), NULL FROM orders WHERE o_orderkey % 16000 >= 10000 + o_custkey % 4000
    UNION ALL SELECT 'lookup_range', 'configs', CAST(o_orderkey AS VARCHAR), NULL FROM orders WHERE o_orderkey % 16000 < 500 OR o_orderkey % 16000 > 15000""")
def _(t):
    configs = t.orders.select(
        "o_orderkey", (F.col("o_custkey") % 9000).alias("photo_hint_ms"), F.lit(4000).alias("barcode_max_ms"),
        (10000 + F.col("o_custkey") % 4000).alias("run_max_ms"), F.lit(1500).alias("ocr_hedge_ms"),
        (F.col("o_orderkey") % 16000).alias("lookup_max_ms"), F.lit(1500).alias("frame_min_interval_ms"), F.lit(3).alias("max_ocr_requests"),
    )
    return quality.failing_rows("configs", configs, "o_orderkey", quality.experiment_config_rules())


@check("dq_12_correction_bounds", """
    WITH items AS (SELECT o_custkey AS request_id, o_orderkey % 40 AS token_index FROM orders)
    SELECT 'too_many_items' AS rule, 'corrections' AS table_name, CAST(request_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail
      FROM items GROUP BY request_id HAVING count(*) > 50
    UNION ALL SELECT DISTINCT 'duplicate_token_index', 'corrections', CAST(request_id AS VARCHAR), NULL
      FROM (SELECT request_id, token_index FROM items GROUP BY 1, 2 HAVING count(*) > 1)""")
def _(t):
    items = t.orders.select(
        F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 40).alias("token_index"),
        F.col("o_orderstatus").alias("token_raw"), F.col("o_orderpriority").alias("corrected_text"),
    )
    return quality.correction_rules(items)
