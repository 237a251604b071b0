"""Regulatory build and flat catalog in bulk: every part of the tables, and the violations of damaged ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisor.plans import flatten, merging, regulatory
from provisor.session import cut_lineage
from provisor_checks.build import LEGACY, MATCHED, merge_sides
from provisor_checks.fragments import fragments
from provisor_checks.registry import check

# Inputs of the build as SQL for both engines: two bundles that share keys, restricted items with
# and without code, of which some are in no bundle, and the acts that restrict them.
INPUTS = {
    "bundle_items": """SELECT 'i' || CAST(p_partkey AS STRING) AS ingredient_id, p_size % 2 AS bundle, 'food_additive' AS kind,
          CASE WHEN p_partkey % 3 = 0 AND p_partkey < 9800 THEN 'E' || CAST(100 + p_partkey AS STRING) END AS e_code,
          p_name || ' ' || CAST(p_partkey AS STRING) AS name, p_type AS name_en, p_brand AS category, 'about ' || p_name AS description, p_size <> 7 AS is_active
        FROM part
        UNION ALL SELECT 'i' || CAST(p_partkey AS STRING), 1, 'food_additive', CASE WHEN p_partkey % 3 = 0 AND p_partkey < 9800 THEN 'E' || CAST(100 + p_partkey AS STRING) END,
          p_name || ' ' || CAST(p_partkey AS STRING), 'second', p_brand, 'second', true FROM part WHERE p_size % 2 = 0""",
    "bundle_aliases": """SELECT 'a' || CAST(p_partkey AS STRING) AS alias_id, 'i' || CAST(p_partkey AS STRING) AS ingredient_id,
          CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_type END AS alias, 'en' AS language, 'bundle' AS source FROM part""",
    "bundle_sources": """SELECT DISTINCT 's' || CAST(p_partkey % 7 AS STRING) AS source_id, 'SRC_' || CAST(p_partkey % 7 AS STRING) AS code,
          'https://acts.example.org/' || CAST(p_partkey % 7 AS STRING) AS url FROM part""",
    "bundle_rules": """SELECT 'r' || CAST(p_partkey AS STRING) AS rule_id, 's' || CAST(p_partkey % 7 AS STRING) AS source_id, 'i' || CAST(p_partkey AS STRING) AS ingredient_id,
          CASE WHEN p_partkey % 5 = 0 THEN 'regulatory_text' WHEN p_partkey % 5 = 1 THEN 'mandatory_warning_label' ELSE 'permitted_food_additive' END AS rule_type,
          'Rule ' || CAST(p_partkey AS STRING) AS title, CASE WHEN p_size % 3 = 0 THEN 'About ' || p_name END AS explanation, 'list' AS citation,
          CAST(NULL AS STRING) AS source_text, CASE WHEN p_partkey % 4 <> 3 THEN 2 END AS appendix, CASE WHEN p_partkey % 8 = 0 THEN 9 END AS tab FROM part""",
    "seed": """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'BANNED' ELSE 'PHASE_OUT' END AS status,
          CASE WHEN p_partkey % 3 = 0 AND p_partkey < 9800 THEN 'e' || CAST(100 + p_partkey AS STRING) END AS code,
          CASE WHEN p_partkey % 25 = 0 THEN p_name || ' ' || CAST(p_partkey AS STRING) ELSE 'Seed ' || CAST(p_partkey AS STRING) END AS name,
          'seeded ' || CAST(p_partkey AS STRING) AS name_en, p_brand AS category, 'k' || CAST(p_partkey AS STRING) AS item_key FROM part WHERE p_partkey % 25 < 2""",
    "act_rows": """SELECT CASE WHEN r_regionkey = 0 THEN 'BANNED' ELSE 'PHASE_OUT' END AS status, 'act' || CAST(r_regionkey AS STRING) AS source_id, 'ACT_' || CAST(r_regionkey AS STRING) AS source_code,
          'https://acts.example.org/act/' || CAST(r_regionkey AS STRING) AS url, 'section ' || r_name || ': ' AS locator_head, 'normative_act' AS document_role,
          'verified_primary' AS act_status, CASE WHEN r_regionkey = 0 THEN 12 END AS pdf_page, r_name AS explanation, DATE '2024-02-27' AS effective_from,
          CASE WHEN r_regionkey = 1 THEN 36 END AS months FROM region WHERE r_regionkey < 2""",
    "notice_rows": """SELECT 'e' || CAST(100 + p_partkey AS STRING) AS code, 'notice ' || CAST(p_partkey AS STRING) AS locator, 'https://acts.example.org/n' AS url, 's1' AS source_id,
          'SRC_1' AS source_code, 4 AS pdf_page FROM part WHERE p_partkey % 6 = 0 AND p_partkey < 9800""",
    "new_rows": """SELECT 'E' || CAST(100 + p_partkey AS STRING) AS code, 'entry ' || CAST(p_partkey AS STRING) AS locator, 'https://acts.example.org/m' AS url, 's2' AS source_id,
          'SRC_2' AS source_code, CAST(NULL AS INT) AS pdf_page, DATE '2025-03-01' AS effective_from FROM part WHERE p_partkey % 9 = 0 AND p_partkey < 9800""",
    "unclear": "SELECT DISTINCT lower(p_name) AS form FROM part WHERE p_size > 25",
}
HEAD = "WITH " + ",\n    ".join(f"{name} AS ({sql})" for name, sql in INPUTS.items())


def uuid_sql(path: str) -> str:
    """Version-5 identifier of a path, in SQL."""
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('provisor/catalog/v1/' || {path}))"
    return (f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST(('0x' || substr(h, 17, 1))::BIGINT AS INTEGER) + 1, 1)"
            f" || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))")


# Items of both bundles (the first wins), seeded ones with their ingredient, and all ingredients.
SEEDED = HEAD + """,
    items AS (SELECT * FROM bundle_items WHERE bundle = 0 UNION ALL SELECT * FROM bundle_items WHERE bundle = 1 AND ingredient_id NOT IN (SELECT ingredient_id FROM bundle_items WHERE bundle = 0)),
    by_code AS (SELECT upper(e_code) AS code, min(ingredient_id) AS id FROM items WHERE e_code IS NOT NULL GROUP BY 1),
    by_name AS (SELECT lower(name) AS form, min(ingredient_id) AS id FROM items GROUP BY 1),
    seeded AS (SELECT s.*, coalesce(c.id, n.id, """ + uuid_sql("'ingredient/' || item_key") + """) AS ingredient_id FROM seed s
      LEFT JOIN by_code c ON upper(s.code) = c.code LEFT JOIN by_name n ON lower(s.name) = n.form),
    ingredients_all AS (SELECT ingredient_id, 'food_additive' AS kind, code AS e_code, name, name_en, category, name || ' (' || name_en || ')' AS description, true AS is_active FROM seeded
      UNION ALL SELECT ingredient_id, kind, e_code, name, name_en, category, description, is_active FROM items WHERE ingredient_id NOT IN (SELECT ingredient_id FROM seeded))"""
STATUS_RULES = SEEDED + """,
    status_rules AS (SELECT """ + uuid_sql("'rule/' || s.status || '/' || item_key") + """ AS rule_id, ingredient_id, a.source_id, 'regulatory_status' AS rule_type, 'attention' AS severity,
      s.status || ': ' || name AS title, a.explanation, locator_head || coalesce(code, name) || ' | ' || url AS citation, s.status AS regulatory_status, 'notice' AS evaluation,
      'exact_only' AS match_policy, 'status_rule' AS record_kind, act_status AS verification_status, CASE WHEN s.status = 'BANNED' THEN true END AS primary_basis_required,
      CASE WHEN s.status = 'BANNED' THEN false END AS production_ready, a.source_id || '|' || locator_head || coalesce(code, name) || '|' || act_status || '|' || coalesce(CAST(pdf_page AS VARCHAR), '-') AS proofs,
      a.months, a.effective_from FROM seeded s JOIN act_rows a ON s.status = a.status)"""
# Extracted rules with their place in a source, then refined by notices and newly permitted codes.
REFINED = STATUS_RULES + """,
    placed AS (SELECT r.*, s.code AS source_code, s.url, r.rule_type <> 'regulatory_text' AND appendix IS NOT NULL AS reference,
      CASE WHEN rule_type = 'regulatory_text' OR appendix IS NULL THEN citation
        ELSE s.code || ', приложение ' || appendix || coalesce(', таблица ' || tab, '') || ', позиция: ' || coalesce(explanation, title) END AS locator
      FROM bundle_rules r JOIN bundle_sources s ON r.source_id = s.source_id),
    joined AS (SELECT p.*, CASE WHEN reference THEN 'extracted_not_verified' ELSE 'needs_review' END AS state, n.locator AS n_locator, n.url AS n_url, m.locator AS m_locator, m.effective_from AS m_from,
      rule_type = 'mandatory_warning_label' AND n.code IS NOT NULL AS notice,
      rule_type = 'permitted_food_additive' AND p.ingredient_id NOT IN (SELECT ingredient_id FROM seeded) AS permitted, m.code IS NOT NULL AS newly
      FROM placed p JOIN ingredients_all i ON i.ingredient_id = p.ingredient_id LEFT JOIN notice_rows n ON upper(n.code) = upper(i.e_code) LEFT JOIN new_rows m ON m.code = upper(i.e_code)),
    refined AS (SELECT rule_id, ingredient_id, source_id, rule_type, CASE WHEN notice THEN 'attention' END AS severity,
      CASE WHEN notice THEN n_locator || ' | ' || n_url ELSE locator || ' | ' || url END AS citation,
      CASE WHEN notice THEN 'ATTENTION' WHEN permitted THEN 'PERMITTED_WITH_CONDITIONS' END AS regulatory_status, CASE WHEN notice THEN 'notice' ELSE 'reference_only' END AS evaluation,
      CASE WHEN notice THEN 'exact_only' END AS match_policy, CASE WHEN reference THEN 'normative_reference' ELSE 'source_fragment' END AS record_kind,
      CASE WHEN notice THEN 'verified_primary' ELSE state END AS verification_status,
      CASE WHEN notice THEN 's1|' || n_locator || '|verified_primary|4'
        ELSE source_id || '|' || locator || '|' || state || '|-' || CASE WHEN permitted AND newly THEN ';s2|' || m_locator || '|verified_primary|-' ELSE '' END END AS proofs,
      CASE WHEN permitted AND newly THEN m_from END AS effective_from,
      CASE WHEN permitted THEN 'food_category,concentration,technological_function' END AS required_context FROM joined
      UNION ALL SELECT rule_id, ingredient_id, source_id, rule_type, severity, citation, regulatory_status, evaluation, match_policy, record_kind, verification_status, proofs, effective_from, NULL FROM status_rules)"""
RULE_COLUMNS = ("rule_id", "ingredient_id", "source_id", "rule_type", "severity", "citation", "regulatory_status", "evaluation", "match_policy", "verification_status")
COLUMNS_SQL = ", ".join(RULE_COLUMNS)


def proofs():
    parts = ("source_id", "locator", "verification_status", "pdf_page")
    return F.array_join(F.transform("evidence", lambda e: F.concat_ws("|", *[F.coalesce(e[p].cast("string"), F.lit("-")) for p in parts])), ";").alias("proofs")


def inputs(t) -> dict:
    return {name: t.sql(sql) for name, sql in INPUTS.items()}


def acts(rows):
    return rows.withColumn("transition", F.when(F.col("months").isNotNull(), F.struct("months"))).drop("months")


def bundles(x):
    empty = F.lit(False)
    rules = x["bundle_rules"].withColumnRenamed("tab", "table").withColumns({c: F.lit(None).cast("string") for c in ("regulatory_status", "match_policy", "severity")}).withColumn(
        "effective_from", F.lit(None).cast("date"))
    aliases = x["bundle_aliases"].withColumn("normalized_alias", F.lower("alias")).withColumn("confidence", F.lit(1).cast("decimal(3,2)"))
    first = {"regulatory_sources": x["bundle_sources"], "ingredient_aliases": aliases, "ingredient_rules": rules}
    second = {name: df.where(empty) if name == "regulatory_sources" else df for name, df in first.items()}  # the same rows once more
    items = lambda n: x["bundle_items"].where(F.col("bundle") == n).drop("bundle")
    return [{**first, "ingredients": items(0)}, {**second, "ingredients": items(1)}]


def built(t):
    x = inputs(t)
    extra = x["seed"].select("item_key", F.concat(F.lit("other "), "item_key").alias("alias"))
    return regulatory.build_regulatory(bundles(x), x["seed"], acts(x["act_rows"]), extra, x["unclear"], x["notice_rows"], x["new_rows"])


@check("prj_14_status_rules", STATUS_RULES + "SELECT * FROM status_rules")
def _(t):
    x = inputs(t)
    from provisor.operators.merge import first_wins

    items = first_wins([b["ingredients"] for b in bundles(x)], "ingredient_id")
    rules = regulatory.status_rules(regulatory.seeded_ingredients(x["seed"], items), acts(x["act_rows"]))
    return rules.select(*RULE_COLUMNS, "title", "explanation", "record_kind", "primary_basis_required", "production_ready", proofs(),
                        F.col("transition.months").alias("months"), "effective_from")


@check("prj_15_refined_rules", REFINED + f"SELECT {COLUMNS_SQL}, record_kind, proofs, effective_from, required_context FROM refined")
def _(t):
    out = built(t)
    both = out["ingredient_rules"].unionByName(out["source_fragments"])
    return both.select(*RULE_COLUMNS, "record_kind", proofs(), "effective_from", F.array_join("required_context", ",").alias("required_context"))


@check("chg_11_rules", REFINED + f"SELECT {COLUMNS_SQL}, proofs FROM refined WHERE record_kind <> 'source_fragment'")
def _(t):
    return built(t)["ingredient_rules"].select(*RULE_COLUMNS, proofs())


@check("chg_11_fragments", REFINED + f"SELECT {COLUMNS_SQL}, proofs FROM refined WHERE record_kind = 'source_fragment'")
def _(t):
    return built(t)["source_fragments"].select(*RULE_COLUMNS, proofs())


@check("chg_11_ingredients", SEEDED + "SELECT * FROM ingredients_all")
def _(t):
    return built(t)["ingredients"].select("ingredient_id", "kind", "e_code", "name", "name_en", "category", "description", "is_active")


@check("chg_11_sources", HEAD + "SELECT source_id, code, url FROM bundle_sources UNION ALL SELECT source_id, source_code, url FROM act_rows")
def _(t):
    return built(t)["regulatory_sources"].select("source_id", "code", "url")


ALIASES = SEEDED + r""",
    spelled AS (SELECT ingredient_id, unnest([code, 'Е' || substr(code, 2), 'E-' || substr(code, 2), 'E ' || substr(code, 2)]) AS alias FROM seeded WHERE code IS NOT NULL),
    given AS (SELECT ingredient_id, name AS alias FROM seeded UNION SELECT ingredient_id, name_en FROM seeded UNION SELECT ingredient_id, 'other ' || item_key FROM seeded UNION SELECT * FROM spelled),
    aliases_all AS (SELECT ingredient_id, alias, CASE WHEN alias LIKE 'Е%' THEN 'ru' ELSE 'en' END AS language, 'regulatory_status_seed' AS source,
        trim(regexp_replace(lower(alias), '[^\p{L}\p{N}_]+', ' ', 'g')) AS form FROM given
        WHERE trim(regexp_replace(lower(alias), '[^\p{L}\p{N}_]+', ' ', 'g')) NOT IN (SELECT form FROM unclear)
      UNION ALL SELECT ingredient_id, alias, language, source, lower(alias) FROM bundle_aliases),
    decided AS (SELECT *, ingredient_id IN (SELECT ingredient_id FROM seeded) AND form IN (SELECT form FROM unclear) AS retired FROM aliases_all)"""


@check("chg_11_aliases", ALIASES + "SELECT ingredient_id, alias, language, source, form AS normalized_alias, retired FROM decided")
def _(t):
    out = built(t)
    names = ["ingredient_id", "alias", "language", "source", "normalized_alias"]
    return out["ingredient_aliases"].select(*names, F.lit(False).alias("retired")).unionByName(out["retired_aliases"].select(*names, F.lit(True).alias("retired")))


@check("dq_6_regulatory_violations", REFINED + """
    SELECT 'orphan_ingredient_id' AS rule, 'ingredient_rules' AS table_name, ingredient_id AS key FROM refined WHERE record_kind <> 'source_fragment' AND ingredient_id LIKE '%7'
    UNION ALL SELECT 'orphan_ingredient_id', 'ingredient_aliases', ingredient_id FROM bundle_aliases WHERE ingredient_id LIKE '%7'
      AND NOT (ingredient_id IN (SELECT ingredient_id FROM seeded) AND lower(alias) IN (SELECT form FROM unclear))
    UNION ALL SELECT 'orphan_ingredient_id', 'ingredient_aliases', ingredient_id FROM (
      SELECT ingredient_id, name AS alias FROM seeded UNION SELECT ingredient_id, name_en FROM seeded UNION SELECT ingredient_id, 'other ' || item_key FROM seeded
      UNION SELECT ingredient_id, unnest([code, 'Е' || substr(code, 2), 'E-' || substr(code, 2), 'E ' || substr(code, 2)]) FROM seeded WHERE code IS NOT NULL)
      WHERE ingredient_id LIKE '%7' AND lower(alias) NOT IN (SELECT form FROM unclear)
    UNION ALL SELECT 'citation', 'ingredient_rules', rule_id FROM refined WHERE record_kind <> 'source_fragment' AND rule_id LIKE '%3'
    UNION ALL SELECT 'evaluation', 'source_fragments', rule_id FROM refined WHERE record_kind = 'source_fragment' AND (evaluation <> 'reference_only' OR rule_id LIKE '%5')
    UNION ALL SELECT 'duplicate_code', 'ingredients', upper(e_code) FROM ingredients_all WHERE e_code IS NOT NULL AND ingredient_id NOT LIKE '%7' GROUP BY 3 HAVING count(*) > 1""")
def _(t):
    """A damaged bundle: ingredients are missing, citations emptied, fragments evaluated."""
    out = built(t)
    lost = {**out, "ingredients": out["ingredients"].where("ingredient_id not like '%7'"),
            "ingredient_rules": out["ingredient_rules"].withColumn("citation", F.when(F.col("rule_id").endswith("3"), "").otherwise(F.col("citation"))),
            "source_fragments": out["source_fragments"].withColumn("evaluation", F.when(F.col("rule_id").endswith("5"), "notice").otherwise(F.col("evaluation")))}
    return regulatory.regulatory_violations(lost).select("rule", "table_name", "key")


def nested_catalog(t):
    """A merged bundle with nested conditions and source fragments; source 3 is the one to leave out."""
    texts = F.concat(F.lit("Kept sentence. Taken from alpha. About "), "name")
    item = lambda n: F.struct(F.col("source_id"), F.col("url"), F.concat(F.lit(f"p{n} "), "title").alias("locator"), F.col("verification_status"), F.lit(n).alias("table"))
    rules = t.rules.join(t.sources.select("source_id", "url"), "source_id")
    items = F.when(F.col("rule_id") % 2 == 0, F.array(item(1), item(2))).otherwise(F.array(item(1)))
    end = F.when(F.col("regulatory_status") == "PHASE_OUT", F.struct(F.lit(36).alias("months")))
    return {
        "regulatory_sources": t.sources, "ingredients": t.ingredients.withColumn("kind", F.lit("food_additive")).withColumn("description", texts),
        "ingredient_aliases": t.aliases.withColumn("alias_id", F.concat_ws("/", F.col("ingredient_id").cast("string"), "alias")),
        "ingredient_rules": rules.select("rule_id", "ingredient_id", "source_id", "title", F.struct(
            "regulatory_status", "evaluation", "verification_status", items.alias("evidence"), end.alias("transition")).alias("conditions")),
        "source_fragments": fragments(t),
    }


def flat(t):
    return flatten.build_catalog(nested_catalog(t), "SRC_3", ["law.example.org"], ["alpha"])


FLAT = """f AS (SELECT r.*, s.url FROM rules r JOIN sources s ON r.source_id = s.source_id),
    e AS (SELECT *, 'p' || n || ' ' || title AS locator FROM (SELECT *, unnest(CASE WHEN rule_id % 2 = 0 THEN [1, 2] ELSE [1] END) AS n FROM f))"""


@check("chg_13_rules", "WITH " + FLAT + """
    SELECT rule_id, ingredient_id, source_id, title, regulatory_status, evaluation, verification_status, false AS product_compliance_assessed FROM f""")
def _(t):
    return flat(t)[0]["ingredient_rules"].select(
        "rule_id", "ingredient_id", "source_id", "title", "regulatory_status", "evaluation", "verification_status", "product_compliance_assessed")


@check("chg_13_evidence", "WITH " + FLAT + "SELECT " + uuid_sql("'evidence/' || rule_id || '/' || (n - 1)") + """ AS evidence_id, rule_id, source_id, url, locator, verification_status,
    CAST(n AS VARCHAR) AS table_label FROM e""")
def _(t):
    return flat(t)[0]["rule_evidence"].select("evidence_id", "rule_id", "source_id", "url", "locator", "verification_status", "table_label")


@check("chg_13_ingredients", "SELECT ingredient_id, e_code, name, 'Kept sentence. About ' || name AS description FROM ingredients")
def _(t):
    return flat(t)[0]["ingredients"].select("ingredient_id", "e_code", "name", "description")


@check("chg_13_documents", """
    WITH d AS (SELECT p_partkey AS document_id, p_name AS title, 'https://doc.example.org/' || (p_partkey % 60) AS url FROM part WHERE p_partkey % 3 = 0)
    SELECT document_id, 'document' AS part, 1 AS source_id, title AS text, url FROM d
    UNION ALL SELECT document_id, 'link', NULL, 'file', 'https://file.example.org/' || document_id FROM d
    UNION ALL SELECT p_partkey, 'profile', 1, 'own', 'https://page.example.org/' || (p_partkey % 50) FROM part WHERE p_partkey % 3 = 1""")
def _(t):
    """Links to a host of the source that is left out are gone."""
    out = flat(t)[0]
    docs = out["documents"].select("document_id", F.lit("document").alias("part"), "source_id", F.col("title").alias("text"), "url")
    links = out["document_links"].select("document_id", F.lit("link"), F.lit(None).cast("int"), "relation", "url")
    profiles = out["ingredient_profiles"].select("ingredient_id", F.lit("profile"), "source_id", "full_description_status", "source_url")
    return docs.union(links).union(profiles)


@check("chg_13_violations", "WITH " + FLAT + """
    SELECT 'depends_on_excluded_source' AS rule, 'ingredient_rules' AS table_name, CAST(rule_id AS VARCHAR) AS key FROM f WHERE source_id = 3
    UNION ALL SELECT 'depends_on_excluded_source', 'rule_evidence', CAST(rule_id AS VARCHAR) FROM e WHERE source_id = 3
    UNION ALL SELECT 'orphan_source_id', 'ingredient_rules', '3' FROM f WHERE source_id = 3
    UNION ALL SELECT 'orphan_source_id', 'rule_evidence', '3' FROM e WHERE source_id = 3
    UNION ALL SELECT 'orphan_ingredient_id', 'ingredient_rules', CAST(ingredient_id AS VARCHAR) FROM f WHERE ingredient_id NOT IN (SELECT ingredient_id FROM ingredients)
    UNION ALL SELECT 'missing_profile', 'ingredient_profiles', CAST(ingredient_id AS VARCHAR) FROM ingredients WHERE e_code IS NOT NULL AND ingredient_id % 3 <> 1
    UNION ALL SELECT 'code_required', 'ingredients', CAST(ingredient_id AS VARCHAR) FROM ingredients WHERE e_code IS NULL
    UNION ALL SELECT 'duplicate_id', 'ingredient_aliases', ingredient_id || '/' || alias FROM aliases GROUP BY 3 HAVING count(*) > 1""")
def _(t):
    return cut_lineage(flat(t)[1], "catalog-violations").select("rule", "table_name", "key")


@check("dq_7_merged_violations", "WITH " + MATCHED + """,
    rules_in AS (SELECT r.rule_id, m.ingredient_id, r.source_id FROM rules r JOIN m ON m.legacy_id = r.ingredient_id + 100000000)
    SELECT 'orphan_source_id' AS rule, 'ingredient_rules' AS table_name, '4' AS key FROM rules_in WHERE source_id = 4
    UNION ALL SELECT 'only_right', 'profiles_of_ingredients', CAST(ingredient_id AS VARCHAR) FROM ingredients WHERE ingredient_id % 50 = 1
    UNION ALL SELECT 'description_changed', 'profiles', CAST(ingredient_id AS VARCHAR) FROM ingredients WHERE ingredient_id % 40 = 2 AND ingredient_id % 50 <> 1
    UNION ALL SELECT 'not_a_status_rule', 'ingredient_rules', CAST(rule_id AS VARCHAR) FROM rules_in WHERE rule_id % 9 = 0
    UNION ALL SELECT 'publisher_rule', 'ingredient_rules', CAST(rule_id AS VARCHAR) FROM rules_in WHERE source_id = 5""")
def _(t):
    """A damaged merge: profiles lost or changed, a source lost, other rule types, rules of the publisher."""
    tables, _ = merging.merge_catalogs(*merge_sides(t))
    ingredients = tables["ingredients"].withColumn("full_description", F.col("name"))
    damaged = {**tables, "ingredients": ingredients, "regulatory_sources": tables["regulatory_sources"].where("source_id <> 4"),
               "ingredient_rules": tables["ingredient_rules"].withColumn("rule_type", F.when(F.col("rule_id") % 9 == 0, "purity").otherwise(F.col("rule_type")))}
    profiles = ingredients.where("ingredient_id % 50 <> 1").select("ingredient_id", F.when(F.col("ingredient_id") % 40 == 2, "changed").otherwise(F.col("name")).alias("full_description"))
    publisher = t.sources.where("source_id = 5").select("source_id")
    return merging.merged_violations(damaged, profiles, publisher).select("rule", "table_name", "key")
