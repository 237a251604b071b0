"""Catalog builds: matching, merging, quarantine, comparison and checked updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisor.functions.codes import code_spellings
from provisor.operators import aliases as al, changes, merge
from provisor_checks.registry import check

# The legacy side: shifted codes, shared names, some rows without code.
LEGACY = """legacy AS (SELECT 100000000 + p_partkey AS ingredient_id,
      CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey < 9800 THEN 'E-' || CAST(100 + p_partkey - p_partkey % 2 AS STRING) END AS e_code,
      CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_name || ' ' || CAST(p_partkey AS STRING) END AS name,
      CASE WHEN p_partkey % 2 = 0 THEN p_type END AS name_en, p_brand AS category FROM part)"""
MATCHED = LEGACY + """,
    l AS (SELECT ingredient_id AS legacy_id, replace(e_code, '-', '') AS code, name AS form, e_code IS NOT NULL AS coded FROM legacy),
    bc AS (SELECT code, count(*) AS n, min(legacy_id) AS id FROM l WHERE code IS NOT NULL GROUP BY 1),
    bn AS (SELECT form, count(*) AS n, min(legacy_id) AS id, bool_or(coded) AS coded FROM l GROUP BY 1),
    w AS (SELECT p.ingredient_id, p.e_code AS code, p.name AS form, CASE WHEN bc.n = 1 THEN bc.id WHEN bc.n IS NULL AND bn.n = 1 AND NOT bn.coded THEN bn.id END AS wanted,
      CASE WHEN bc.n = 1 THEN 'exact_e_code' WHEN bc.n IS NULL AND bn.n = 1 AND NOT bn.coded THEN 'unique_exact_name_without_legacy_code' END AS method
      FROM ingredients p LEFT JOIN bc ON p.e_code = bc.code LEFT JOIN bn ON p.name = bn.form),
    f AS (SELECT wanted, min(ingredient_id) AS first FROM w WHERE wanted IS NOT NULL GROUP BY 1),
    m AS (SELECT w.ingredient_id, w.code, w.form, CASE WHEN w.ingredient_id = f.first THEN w.wanted END AS legacy_id, CASE WHEN w.ingredient_id = f.first THEN w.method END AS method
      FROM w LEFT JOIN f ON w.wanted = f.wanted)"""


def legacy(t):
    return t.sql(LEGACY[LEGACY.index("(") + 1:-1])


def matched(t):
    return merge.match_catalogs(t.ingredients.withColumn("position", F.col("ingredient_id")), legacy(t))


@check("jon_11_matched_catalogs", "WITH " + MATCHED + "SELECT ingredient_id, legacy_id, method FROM m")
def _(t):
    return matched(t).select("ingredient_id", "legacy_id", "method")


@check("jon_11_review_candidates", "WITH " + MATCHED + """,
    o AS (SELECT * FROM m WHERE legacy_id IS NULL),
    c AS (SELECT o.ingredient_id, l.legacy_id AS candidate_id FROM o JOIN l ON o.form = l.form UNION SELECT o.ingredient_id, l.legacy_id FROM o JOIN l ON o.code = l.code)
    SELECT o.ingredient_id, c.candidate_id, CASE WHEN c.candidate_id IS NULL THEN 'no_match' ELSE 'ambiguous_or_requires_review' END AS reason
    FROM o LEFT JOIN c ON o.ingredient_id = c.ingredient_id""")
def _(t):
    return merge.review_candidates(matched(t), legacy(t))


@check("agg_24_merge_summary", "WITH " + MATCHED + """
    SELECT count(*) AS ingredients, count(legacy_id) AS matched, count(*) FILTER (WHERE method = 'exact_e_code') AS matched_by_code,
      count(*) FILTER (WHERE legacy_id IS NULL) AS unmatched, CAST(0 AS BIGINT) AS english_remaining_null,
      (SELECT count(*) FROM legacy WHERE e_code IS NOT NULL AND ingredient_id NOT IN (SELECT legacy_id FROM m WHERE legacy_id IS NOT NULL)) AS legacy_only_codes FROM m""")
def _(t):
    return merge.merge_summary(matched(t), t.ingredients, legacy(t))


@check("jon_18_filled_fields", "WITH " + MATCHED + """
    SELECT m.ingredient_id, CASE WHEN i.is_active THEN i.name_en ELSE g.name_en END AS name_en, i.category FROM m JOIN ingredients i ON i.ingredient_id = m.ingredient_id
    LEFT JOIN legacy g ON g.ingredient_id = m.legacy_id""")
def _(t):
    pairs = matched(t).where("legacy_id is not null").select("ingredient_id", "legacy_id")
    other = pairs.join(legacy(t).select(F.col("ingredient_id").alias("legacy_id"), "name_en", "category"), "legacy_id")
    rows = t.ingredients.select("ingredient_id", F.when(F.col("is_active"), F.col("name_en")).alias("name_en"), "category")
    return changes.fill_from_match(rows, other, "ingredient_id", ["name_en", "category"])


@check("jon_12_remapped_arrays", "WITH " + MATCHED + """,
    x AS (SELECT legacy_id, ingredient_id FROM m WHERE legacy_id IS NOT NULL),
    a AS (SELECT p_partkey AS rule_id, unnest([100000000 + p_partkey, 100000000 + (p_partkey * 7) % 1000, 100000000 + p_partkey]) AS legacy_id, generate_subscripts([1, 2, 3], 1) AS pos FROM part),
    j AS (SELECT a.rule_id, a.pos, x.ingredient_id FROM a LEFT JOIN x ON a.legacy_id = x.legacy_id),
    d AS (SELECT rule_id, ingredient_id, min(pos) AS pos FROM j WHERE ingredient_id IS NOT NULL GROUP BY 1, 2)
    SELECT j.rule_id, coalesce((SELECT string_agg(CAST(ingredient_id AS VARCHAR), '|' ORDER BY pos) FROM d WHERE d.rule_id = j.rule_id), '') AS ids,
      CASE WHEN count(*) FILTER (WHERE ingredient_id IS NULL) > 0 THEN 'matched_catalog_subset' END AS ids_scope FROM j GROUP BY j.rule_id""")
def _(t):
    crosswalk = matched(t).where("legacy_id is not null").select("legacy_id", "ingredient_id")
    base = 100000000 + F.col("p_partkey")
    rows = t.part.select(F.col("p_partkey").alias("rule_id"), F.array(base, 100000000 + (F.col("p_partkey") * 7) % 1000, base).alias("ids"))
    out = merge.remap_arrays(rows, crosswalk, "rule_id", "ids")
    return out.select("rule_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), "|").alias("ids"), "ids_scope")


RULE_TYPES = """typed AS (SELECT *, CASE rule_id % 4 WHEN 0 THEN 'permitted_food_additive' WHEN 1 THEN 'regulatory_status' WHEN 2 THEN 'dose_limit' ELSE 'purity' END AS rule_type FROM rules)"""


@check("flt_8_status_rules", "WITH " + RULE_TYPES + """
    SELECT rule_id, rule_type FROM typed WHERE (rule_type = 'permitted_food_additive' AND regulatory_status = 'PERMITTED_WITH_CONDITIONS')
      OR (rule_type = 'regulatory_status' AND regulatory_status IN ('BANNED', 'PHASE_OUT'))""")
def _(t):
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("permitted_food_additive", "regulatory_status", "dose_limit", "purity")]), (F.col("rule_id") % 4 + 1).cast("int"))
    return t.rules.withColumn("rule_type", kinds).where(merge.is_status_rule()).select("rule_id", "rule_type")


@check("flt_9_alias_decisions", """
    SELECT ingredient_id, alias, CASE WHEN ingredient_id IN (SELECT ingredient_id FROM rules WHERE match_policy = 'exact_only')
      AND normalized_alias IN (SELECT normalized_alias FROM alias_review) THEN 'ambiguous_for_strict_status_rule' END AS reason FROM aliases""")
def _(t):
    restricted = t.rules.where("match_policy = 'exact_only'")
    unclear = t.alias_review.select(F.col("normalized_alias").alias("form"))
    return merge.alias_decisions(t.aliases, restricted, unclear).select("ingredient_id", "alias", "reason")


@check("flt_10_retired_aliases", """
    SELECT ingredient_id, alias FROM aliases WHERE ingredient_id IN (SELECT ingredient_id FROM rules WHERE regulatory_status <> 'PERMITTED_WITH_CONDITIONS')
      AND (normalized_alias IN (SELECT normalized_alias FROM alias_review) OR contains(normalized_alias, 'gear'))""")
def _(t):
    special = t.rules.where("regulatory_status <> 'PERMITTED_WITH_CONDITIONS'")
    unclear = t.alias_review.select(F.col("normalized_alias").alias("form"))
    return al.retired_by_note(t.aliases, special, unclear, "gear")[1].select("ingredient_id", "alias")


POSITIONED = "pa AS (SELECT *, ingredient_id * 10 + CASE source WHEN 'catalog' THEN 0 WHEN 'short' THEN 1 ELSE 2 END AS position FROM aliases)"


def positioned(t):
    place = F.when(F.col("source") == "catalog", 0).when(F.col("source") == "short", 1).otherwise(2)
    return t.aliases.withColumn("position", F.col("ingredient_id") * 10 + place)


@check("win_2_first_aliases", "WITH " + POSITIONED + """
    SELECT ingredient_id, language, normalized_alias, min(position) AS position FROM pa GROUP BY 1, 2, 3""")
def _(t):
    return al.first_aliases(positioned(t)).select("ingredient_id", "language", "normalized_alias", "position")


@check("win_3_quarantined_aliases", r"WITH " + POSITIONED + r""",
    o AS (SELECT DISTINCT * FROM (SELECT normalized_alias AS form, ingredient_id FROM aliases
      UNION ALL SELECT lower(name), ingredient_id FROM ingredients UNION ALL SELECT lower(name_en), ingredient_id FROM ingredients)),
    many AS (SELECT form FROM o GROUP BY 1 HAVING count(*) > 1),
    d AS (SELECT ingredient_id, normalized_alias, min(position) AS position FROM pa GROUP BY ingredient_id, language, normalized_alias)
    SELECT ingredient_id, normalized_alias, position, CASE WHEN normalized_alias IN (SELECT form FROM many) THEN 'ambiguous_name'
      WHEN length(regexp_replace(normalized_alias, '[^a-z]', '', 'g')) < 2 THEN 'name_fragment' END AS reason FROM d""")
def _(t):
    return al.quarantine(positioned(t), t.ingredients).select("ingredient_id", "normalized_alias", "position", "reason")


@check("prj_4_alias_rows", """
    SELECT ingredient_id, name AS alias, lower(name) AS normalized_alias, 'en' AS language, 'catalog' AS source, CAST(1 AS DECIMAL(3,2)) AS confidence FROM ingredients""")
def _(t):
    return al.alias_rows(t.ingredients, "ingredient_id", F.lit("en"), "name", F.lit("catalog")).drop("alias_id")


@check("set_6_first_wins", """
    SELECT ingredient_id, 'part' AS origin FROM ingredients WHERE is_active
    UNION ALL SELECT DISTINCT ingredient_id, 'exclusion' FROM exclusions WHERE ingredient_id NOT IN (SELECT ingredient_id FROM ingredients WHERE is_active)""")
def _(t):
    first = t.ingredients.where("is_active").select("ingredient_id", F.lit("part").alias("origin"))
    second = t.exclusions.select("ingredient_id", F.lit("exclusion").alias("origin")).distinct()
    return merge.first_wins([first, second], "ingredient_id")


@check("agg_17_counters", "SELECT regulatory_status, count(*) AS n FROM rules GROUP BY 1")
def _(t):
    return merge.counter(t.rules, "regulatory_status")


NEXT = """nxt AS (SELECT p_partkey AS ingredient_id, CASE WHEN p_size % 10 = 0 THEN upper(p_name) ELSE p_name END AS name,
      CASE WHEN p_size = 9 THEN NULL ELSE p_brand END AS brand FROM part WHERE p_partkey % 50 <> 3
      UNION ALL SELECT 200000000 + n_nationkey, n_name, 'new' FROM nation),
    prev AS (SELECT p_partkey AS ingredient_id, p_name AS name, p_brand AS brand FROM part)"""


def before_after(t):
    before = t.sql("SELECT p_partkey AS ingredient_id, p_name AS name, p_brand AS brand FROM part")
    after = t.sql(NEXT[NEXT.index("(") + 1:NEXT.index("),\n    prev")])
    return before, after


@check("jon_15_snapshot_diff", "WITH " + NEXT + """
    SELECT coalesce(n.ingredient_id, p.ingredient_id) AS ingredient_id, CASE WHEN p.ingredient_id IS NULL THEN 'added' WHEN n.ingredient_id IS NULL THEN 'deleted' ELSE 'changed' END AS change
    FROM prev p FULL JOIN nxt n ON p.ingredient_id = n.ingredient_id WHERE p.ingredient_id IS NULL OR n.ingredient_id IS NULL
      OR n.name IS DISTINCT FROM p.name OR n.brand IS DISTINCT FROM p.brand""")
def _(t):
    return changes.snapshot_diff(*before_after(t), "ingredient_id")


@check("snk_1_snapshot_counts", "WITH " + NEXT + """
    SELECT count(*) FILTER (WHERE p.ingredient_id IS NULL) AS inserted, count(*) FILTER (WHERE p.ingredient_id = n.ingredient_id
      AND (n.name IS DISTINCT FROM p.name OR n.brand IS DISTINCT FROM p.brand)) AS updated, count(*) FILTER (WHERE n.ingredient_id IS NULL) AS deleted
    FROM prev p FULL JOIN nxt n ON p.ingredient_id = n.ingredient_id""")
def _(t):
    return changes.snapshot_counts(*before_after(t), "ingredient_id")


@check("snk_3_changed_rows", "WITH " + NEXT + """
    SELECT n.* FROM nxt n LEFT JOIN prev p ON p.ingredient_id = n.ingredient_id
    WHERE p.ingredient_id IS NULL OR n.name IS DISTINCT FROM p.name OR n.brand IS DISTINCT FROM p.brand""")
def _(t):
    return changes.changed_rows(*before_after(t), "ingredient_id")


@check("jon_16_rule_changes", """
    WITH raw AS (SELECT rule_id, CASE WHEN rule_id % 3 = 0 THEN 'reference_only' ELSE evaluation END AS evaluation, regulatory_status FROM rules WHERE rule_id % 10 <> 1)
    SELECT c.rule_id, 'local_enrichment' AS change_kind, 'evaluation' AS field, r.evaluation AS before, c.evaluation AS after FROM rules c JOIN raw r ON c.rule_id = r.rule_id WHERE r.evaluation <> c.evaluation
    UNION ALL SELECT rule_id, 'local_seed_rule', 'evaluation', NULL, evaluation FROM rules WHERE rule_id % 10 = 1
    UNION ALL SELECT rule_id, 'local_seed_rule', 'regulatory_status', NULL, regulatory_status FROM rules WHERE rule_id % 10 = 1""")
def _(t):
    raw = t.rules.where("rule_id % 10 <> 1").withColumn(
        "evaluation", F.when(F.col("rule_id") % 3 == 0, "reference_only").otherwise(F.col("evaluation")))
    return changes.rule_changes(raw, t.rules, ["evaluation", "regulatory_status"])


PLAN = """cur AS (SELECT e_code AS code, ingredient_id AS id, name AS text FROM ingredients WHERE e_code IS NOT NULL),
    new AS (SELECT code, CASE WHEN id % 5 = 0 THEN text ELSE 'new ' || text END AS new_text FROM cur UNION ALL SELECT 'E9999', 'nothing'),
    exp AS (SELECT code, id, CASE WHEN id % 7 = 0 THEN 'other' ELSE text END AS text FROM cur)"""
DECIDED = PLAN + """,
    plan AS (SELECT n.code, c.id, n.new_text, CASE WHEN c.id IS NULL THEN 'missing' WHEN c.text = n.new_text THEN 'current' WHEN e.text = c.text THEN 'apply' ELSE 'stale' END AS decision
      FROM new n LEFT JOIN cur c ON n.code = c.code LEFT JOIN exp e ON n.code = e.code)"""


def update_plan(t):
    current = t.ingredients.where("e_code is not null").select(F.col("e_code").alias("code"), F.col("ingredient_id").alias("id"), F.col("name").alias("text"))
    texts = current.select("code", F.when(F.col("id") % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("new "), "text")).alias("new_text"))
    extra = t.region.select(F.lit("E9999").alias("code"), F.lit("nothing").alias("new_text")).distinct()
    expected = current.withColumn("text", F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("text")))
    return current, changes.plan_updates(current, texts.unionByName(extra), expected)


@check("jon_17_update_plan", "WITH " + DECIDED + "SELECT code, id, decision FROM plan")
def _(t):
    return update_plan(t)[1].select("code", "id", "decision")


@check("chg_14_checked_update", "WITH " + DECIDED + """
    SELECT cur.code, cur.id, coalesce(p.new_text, cur.text) AS text FROM cur LEFT JOIN plan p ON p.id = cur.id AND p.decision = 'apply'""")
def _(t):
    return changes.apply_plan(*update_plan(t))


@check("chg_14_update_violations", "WITH " + DECIDED + """
    SELECT code, id, text, 'unexpected_row' AS problem FROM cur WHERE id IN (SELECT id FROM plan WHERE decision = 'apply')
    UNION ALL SELECT code, id, new_text, 'missing_row' FROM plan WHERE decision = 'apply'""")
def _(t):
    current, plan = update_plan(t)
    return changes.update_violations(current, plan, current)


@check("chg_9_descriptions_by_code", """
    SELECT ingredient_id, e_code, CASE WHEN e_code IS NOT NULL AND ingredient_id % 2 = 0 THEN 'text of ' || e_code ELSE name_en END AS full_description FROM ingredients""")
def _(t):
    texts = t.ingredients.where("e_code is not null and ingredient_id % 2 = 0").select(
        F.col("e_code").alias("code"), F.concat(F.lit("text of "), "e_code").alias("new_text"))
    rows = t.ingredients.select("ingredient_id", "e_code", F.col("name_en").alias("full_description"))
    return changes.with_descriptions(rows, texts)


@check("chg_17_changed_snapshots", """
    SELECT 'all' AS snapshot, count(*) AS changed FROM ingredients WHERE e_code IS NOT NULL AND ingredient_id % 2 = 0
    UNION ALL SELECT 'active', count(*) FROM ingredients WHERE e_code IS NOT NULL AND ingredient_id % 2 = 0 AND is_active""")
def _(t):
    texts = t.ingredients.where("e_code is not null and ingredient_id % 2 = 0").select(
        F.col("e_code").alias("code"), F.concat(F.lit("text of "), "e_code").alias("new_text"))
    cols = ["ingredient_id", "e_code", F.col("name_en").alias("full_description")]
    uncoded = t.ingredients.where("e_code is null").select(*cols)
    return changes.changed_snapshots({
        "all": t.ingredients.select(*cols), "active": t.ingredients.where("is_active").select(*cols), "uncoded": uncoded,
    }, texts)


@check("prj_5_spelling_aliases", """
    SELECT count(*) AS n, count(DISTINCT alias) AS spellings FROM (SELECT unnest([e_code, 'Е' || substr(e_code, 2), 'E-' || substr(e_code, 2), 'E ' || substr(e_code, 2)]) AS alias
      FROM ingredients WHERE e_code IS NOT NULL)""")
def _(t):
    rows = t.ingredients.where("e_code is not null").select(F.explode(code_spellings(F.col("e_code"))).alias("alias"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("alias").alias("spellings"))


@check("prj_1_allowed_columns", """
    SELECT CAST(ingredient_id AS VARCHAR) AS ingredient_id, category, is_active, CAST(NULL AS VARCHAR) AS full_description, e_code FROM ingredients""")
def _(t):
    from provisor.schemas import conform

    rows = t.ingredients.withColumn("id", F.col("ingredient_id"))
    return conform(rows, "ingredients").select(F.col("id").alias("ingredient_id"), "category", "is_active", "full_description", "e_code")


def extracted_rules(t):
    """Rules as an extract would hold them: some from a table, some from a point, some loose."""
    return t.rules.select(
        "rule_id", "source_id", "ingredient_id", "title", "explanation",
        F.when(F.col("rule_id") % 5 == 0, "regulatory_text").otherwise("permitted_food_additive").alias("rule_type"),
        F.when(F.col("rule_id") % 3 == 0, "пункт 4").otherwise("list").alias("citation"), F.lit(None).cast("string").alias("source_text"),
        F.when(F.col("rule_id") % 4 == 0, F.lit(2)).alias("appendix"), F.lit(None).cast("int").alias("table"))


@check("prj_13_enriched_rules", """
    SELECT r.rule_id, CASE WHEN r.rule_id % 5 <> 0 AND (r.rule_id % 4 = 0 OR r.rule_id % 3 = 0) THEN 'normative_reference' ELSE 'source_fragment' END AS record_kind,
      CASE WHEN r.rule_id % 5 = 0 OR r.rule_id % 4 <> 0 THEN CASE WHEN r.rule_id % 3 = 0 THEN 'пункт 4' ELSE 'list' END
        ELSE s.code || ', приложение 2, позиция: ' || coalesce(r.explanation, r.title) END || ' | ' || s.url AS citation, sha256(coalesce(r.explanation, '')) AS source_text_sha256
    FROM rules r JOIN sources s ON r.source_id = s.source_id""")
def _(t):
    from provisor.plans.regulatory import enrich_references

    return enrich_references(extracted_rules(t), t.sources).select("rule_id", "record_kind", "citation", "source_text_sha256")


@check("prj_16_rules_and_fragments", """
    SELECT CASE WHEN rule_id % 5 <> 0 AND (rule_id % 4 = 0 OR rule_id % 3 = 0) THEN 'rules' ELSE 'fragments' END AS part, count(*) AS n FROM rules GROUP BY 1""")
def _(t):
    from provisor.plans.regulatory import enrich_references, split_fragments

    active, fragments = split_fragments(enrich_references(extracted_rules(t), t.sources))
    return active.select(F.lit("rules").alias("part")).unionByName(fragments.select(F.lit("fragments").alias("part"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def nested_rules(t):
    item = lambda n: F.struct(F.col("source_id"), F.lit("u").alias("url"), F.concat(F.lit(f"p{n} "), "title").alias("locator"), F.col("verification_status"))
    items = F.when(F.col("rule_id") % 2 == 0, F.array(item(1), item(2))).otherwise(F.array(item(1)))
    end = F.when(F.col("regulatory_status") == "PHASE_OUT", F.struct(F.lit(36).alias("months")))
    return t.rules.select("rule_id", "ingredient_id", F.struct("regulatory_status", "evaluation", items.alias("evidence"), end.alias("transition")).alias("conditions"))


@check("prj_2_flat_evidence", """
    SELECT rule_id, 'p1 ' || title AS locator FROM rules UNION ALL SELECT rule_id, 'p2 ' || title FROM rules WHERE rule_id % 2 = 0""")
def _(t):
    from provisor.plans.flatten import flatten_rules

    return flatten_rules(nested_rules(t))["rule_evidence"].select("rule_id", "locator")


@check("prj_2_flat_transitions", "SELECT rule_id, 36 AS months FROM rules WHERE regulatory_status = 'PHASE_OUT'")
def _(t):
    from provisor.plans.flatten import flatten_rules

    return flatten_rules(nested_rules(t))["rule_transitions"]


def merge_sides(t):
    primary = {
        "ingredients": t.ingredients.withColumn("position", F.col("ingredient_id")).withColumn("name_en", F.when(F.col("is_active"), F.col("name_en"))),
        "ingredient_aliases": t.aliases.withColumn("alias_id", F.concat_ws("/", F.col("ingredient_id").cast("string"), "alias")),
        "ingredient_rules": t.rules, "regulatory_sources": t.sources.withColumn("source_id", F.col("source_id") + 100),
    }
    old_rules = t.rules.withColumn("ingredient_id", F.col("ingredient_id") + 100000000).withColumn(
        "rule_type", F.when(F.col("regulatory_status") == "PERMITTED_WITH_CONDITIONS", "permitted_food_additive").otherwise("regulatory_status"))
    old = {
        "ingredients": legacy(t),
        "ingredient_aliases": t.aliases.withColumn("ingredient_id", F.col("ingredient_id") + 100000000).withColumn("alias_id", F.concat_ws("/", F.lit("old"), F.col("ingredient_id").cast("string"), "alias")),
        "ingredient_rules": old_rules, "regulatory_sources": t.sources,
    }
    return primary, old, t.alias_review.select(F.col("normalized_alias").alias("form"))


@check("chg_12_merged_rules", "WITH " + MATCHED + """
    SELECT r.rule_id, m.ingredient_id, r.regulatory_status FROM rules r JOIN m ON m.legacy_id = r.ingredient_id + 100000000""")
def _(t):
    from provisor.plans.merging import merge_catalogs

    tables, _ = merge_catalogs(*merge_sides(t))
    return tables["ingredient_rules"].select("rule_id", "ingredient_id", "regulatory_status")


@check("snk_7_merge_report", "WITH " + MATCHED + """
    SELECT 'status_counts' AS section, r.regulatory_status AS item, count(*) AS n FROM rules r JOIN m ON m.legacy_id = r.ingredient_id + 100000000 GROUP BY 2
    UNION ALL SELECT 'methods', method, count(*) FROM m WHERE method IS NOT NULL GROUP BY 2""")
def _(t):
    from provisor.plans.merging import merge_catalogs

    tables, report = merge_catalogs(*merge_sides(t))
    methods = tables["ingredient_matches"].groupBy("match_method").agg(F.count(F.lit(1)).alias("n"))
    return report["status_counts"].select(F.lit("status_counts").alias("section"), F.col("regulatory_status").alias("item"), "n").unionByName(
        methods.select(F.lit("methods").alias("section"), F.col("match_method").alias("item"), "n"))


@check("prj_17_supplemented_tags", """
    WITH have AS (SELECT DISTINCT ingredient_id FROM tags WHERE tag_type = 'origin')
    SELECT ingredient_id, name FROM tags WHERE tag_type = 'origin' UNION ALL
    SELECT ingredient_id, category FROM ingredients WHERE e_code IS NOT NULL AND ingredient_id NOT IN (SELECT ingredient_id FROM have)""")
def _(t):
    from provisor.plans.supplement import ensure_rows

    wanted = t.ingredients.where("e_code is not null").select("ingredient_id", F.lit("origin").alias("tag_type"), F.col("category").alias("name"))
    out, _ = ensure_rows(t.tags.where("tag_type = 'origin'"), wanted, ["ingredient_id", "tag_type"], [])
    return out.select("ingredient_id", "name")


@check("prj_18_removed_source", """
    SELECT ingredient_id, alias, CASE WHEN source <> 'short' THEN source END AS source FROM aliases""")
def _(t):
    from provisor.plans.flatten import remove_source

    tables = {
        "regulatory_sources": t.sources, "ingredients": t.ingredients, "ingredient_aliases": t.aliases,
        "ingredient_rules": t.rules, "rule_evidence": t.evidence,
    }
    out, _ = remove_source(tables, "short", ["other.example.org"], ["short"])
    return out["ingredient_aliases"].select("ingredient_id", "alias", "source")
