"""Label analysis: resolution, rules, verdicts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from provisor.operators import resolve, rules, verdict
from provisor.plans import analysis
from provisor.session import cut_lineage
from provisor_checks.registry import check
from provisor_checks.scalars import CORRECTED_SQL, corrected_texts

DAY = dt.date(2025, 6, 1)

VALID = """(r.effective_from IS NULL OR r.effective_from <= DATE '2025-06-01')
  AND (r.effective_to IS NULL OR r.effective_to >= DATE '2025-06-01')"""
SEVERITY = """CASE WHEN r.regulatory_status = 'BANNED' AND r.evaluation <> 'reference_only' THEN 3
  WHEN r.regulatory_status = 'PHASE_OUT' THEN 1 ELSE 0 END"""
NAME_OF = """CASE {w} WHEN 3 THEN 'forbidden' WHEN 2 THEN 'avoid' WHEN 1 THEN 'attention' WHEN 0 THEN 'neutral' ELSE 'unknown' END"""

# Dictionary, assessed rules and severities in SQL, shared by the queries below.
DICT_CTE = """
    owned AS (SELECT a.normalized_alias AS key, a.ingredient_id, max(a.confidence) AS confidence FROM aliases a
      JOIN ingredients i ON a.ingredient_id = i.ingredient_id WHERE i.is_active
      AND a.normalized_alias NOT IN (SELECT normalized_alias FROM alias_review) GROUP BY 1, 2),
    names AS (SELECT key, min(ingredient_id) AS ingredient_id, CAST(max(confidence) AS DOUBLE) AS score FROM owned GROUP BY key HAVING count(*) = 1),
    codes AS (SELECT lower(e_code) AS key, ingredient_id FROM ingredients WHERE is_active AND e_code IS NOT NULL),
    assessed AS (SELECT r.ingredient_id, r.rule_id, """ + SEVERITY + """ AS weight FROM rules r
      JOIN sources s ON r.source_id = s.source_id WHERE """ + VALID + """
      AND (s.effective_to IS NULL OR s.effective_to >= DATE '2025-06-01')),
    graded AS (SELECT i.ingredient_id, i.name, i.e_code, coalesce(max(a.weight), -1) AS weight, count(a.weight) AS rules
      FROM ingredients i LEFT JOIN assessed a ON i.ingredient_id = a.ingredient_id GROUP BY ALL)"""
KEYED = r"""
    keyed AS (SELECT product_id, pos, token, CASE WHEN token NOT LIKE 'without%' AND regexp_matches(token, 'E-?\d{3,4}')
      THEN lower('E' || regexp_extract(token, 'E-?(\d{3,4})', 1)) END AS code,
      trim(regexp_replace(lower(token), '[^a-z0-9_]+', ' ', 'g')) AS name FROM label_tokens)"""
RESOLVED = """
    resolved AS (SELECT k.product_id, k.pos, k.token, k.code, coalesce(c.ingredient_id, n.ingredient_id) AS ingredient_id,
      CASE WHEN c.ingredient_id IS NOT NULL THEN 'e_code' WHEN n.ingredient_id IS NOT NULL THEN 'alias' END AS matched_by
      FROM keyed k LEFT JOIN codes c ON k.code = c.key LEFT JOIN names n ON k.code IS NULL AND k.name = n.key)"""
HEAD = "WITH " + DICT_CTE + "," + KEYED + "," + RESOLVED
TEXT_KEYED = r"""
    parts AS (SELECT product_id, user_id, list_filter(list_transform(regexp_split_to_array(text, '[,;()]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM label_texts),
    keyed AS (SELECT product_id, pos, token, CASE WHEN token NOT LIKE 'without%' AND regexp_matches(token, 'E-?\d{3,4}')
      THEN lower('E' || regexp_extract(token, 'E-?(\d{3,4})', 1)) END AS code,
      trim(regexp_replace(lower(token), '[^a-z0-9_]+', ' ', 'g')) AS name
      FROM (SELECT product_id, unnest(p) AS token, generate_subscripts(p, 1) - 1 AS pos FROM parts))"""
TEXT_HEAD = "WITH " + DICT_CTE + "," + TEXT_KEYED + "," + RESOLVED

COUNTS = """
    folded AS (SELECT r.product_id, r.ingredient_id, max(g.weight) AS weight, count(*) AS n FROM resolved r
      LEFT JOIN graded g ON r.ingredient_id = g.ingredient_id GROUP BY 1, 2),
    counted AS (SELECT product_id, count(ingredient_id) AS matched,
      CAST(coalesce(sum(n) FILTER (WHERE ingredient_id IS NULL), 0) AS BIGINT) AS unmatched,
      count(*) FILTER (WHERE weight >= 1) AS reasons, coalesce(max(weight), -1) AS weight,
      count(*) FILTER (WHERE ingredient_id IS NOT NULL AND weight < 0) AS unknown FROM folded GROUP BY 1)"""
VERDICT = """
    SELECT product_id, matched, unmatched, reasons,
      CASE WHEN weight >= 2 THEN 'dangerous' WHEN weight = 1 THEN 'attention' ELSE 'unknown' END AS level,
      CASE WHEN weight < 1 THEN 0 ELSE least(100, CASE weight WHEN 3 THEN 95 WHEN 2 THEN 80 ELSE 45 END + greatest(0, reasons - 1) * 5 + unmatched) END AS risk_score,
      unmatched > 0 OR matched = 0 OR unknown > 0 AS incomplete FROM counted"""
VERDICT_COLUMNS = ["product_id", "matched", "unmatched", "reasons", "level", "risk_score", "incomplete"]


def dictionary(t):
    return cut_lineage(resolve.match_dictionary(t.ingredients, t.aliases, t.alias_review), "match-dictionary")


def assessed(t, by="ingredient_id"):
    return rules.assessed_rules(rules.valid_rules(t.rules, t.sources, DAY), t.transitions, DAY, by)


def graded(t):
    return rules.severity_of_ingredients(t.ingredients, assessed(t))


def keyed(t):
    return resolve.with_lookup_key(t.label_tokens.repartition("product_id"))


def catalog(t):
    return analysis.catalog_dictionary(t.ingredients, t.aliases, t.alias_review, t.rules, t.sources, t.transitions, DAY)


def resolved(t):
    return resolve.resolve_tokens(keyed(t), dictionary(t))


@check("analyse_labels", TEXT_HEAD + "," + COUNTS + VERDICT)
def _(t):
    """Flagship: label text to verdict."""
    out = analysis.analyse_labels(t.label_texts, catalog(t))
    return out.select(*VERDICT_COLUMNS)


@check("jon_1_code_matches", HEAD + """
    SELECT product_id, pos, ingredient_id, CAST(1.0 AS DOUBLE) AS match_score FROM resolved WHERE matched_by = 'e_code'""")
def _(t):
    hits = keyed(t).join(resolve.code_dictionary(t.ingredients), ["by", "key"])
    return hits.select("product_id", "pos", "ingredient_id", "match_score")


@check("jon_2_unique_names", "WITH " + DICT_CTE + "SELECT key AS normalized_alias, ingredient_id, score AS match_score FROM names")
def _(t):
    names = resolve.name_dictionary(t.ingredients, t.aliases, t.alias_review)
    return names.select(F.col("key").alias("normalized_alias"), "ingredient_id", "match_score")


@check("jon_3_resolved_tokens", HEAD + "SELECT product_id, pos, token, ingredient_id, matched_by FROM resolved")
def _(t):
    return resolved(t).select("product_id", "pos", "token", "ingredient_id", "matched_by")


@check("jon_4_valid_rules", f"""
    SELECT r.rule_id, r.ingredient_id, s.code AS source_code FROM rules r JOIN sources s ON r.source_id = s.source_id
    WHERE {VALID} AND (s.effective_to IS NULL OR s.effective_to >= DATE '2025-06-01')""")
def _(t):
    return rules.valid_rules(t.rules, t.sources, DAY).select("rule_id", "ingredient_id", "source_code")


@check("flt_5_valid_on_day", f"SELECT r.rule_id FROM rules r WHERE {VALID}")
def _(t):
    return t.rules.where(rules.valid_on(DAY)).select("rule_id")


@check("jon_5_rule_evidence", """
    SELECT e.rule_id, e.evidence_id, s.code AS source_code, s.title AS source_title, e.locator FROM evidence e
    JOIN sources s ON e.source_id = s.source_id WHERE e.rule_id IN (SELECT rule_id FROM rules)""")
def _(t):
    return rules.rule_evidence(t.rules, t.evidence, t.sources).select(
        "rule_id", "evidence_id", "source_code", "source_title", "locator"
    )


@check("jon_6_rule_transitions", """
    SELECT r.rule_id, x.months, x.transition_end FROM rules r LEFT JOIN transitions x ON r.rule_id = x.rule_id""")
def _(t):
    return rules.with_transition(t.rules, t.transitions).select(
        "rule_id", F.col("transition.months").alias("months"), F.col("transition.transition_end").alias("transition_end")
    )


@check("win_1_first_positions", HEAD + """
    SELECT product_id, ingredient_id, min(pos) AS pos FROM resolved WHERE ingredient_id IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return resolve.first_positions(resolved(t))


@check("agg_1_ordered_rules", "WITH " + DICT_CTE + """
    SELECT ingredient_id, rule_id, CASE weight WHEN 3 THEN 'forbidden' WHEN 1 THEN 'attention' ELSE 'neutral' END AS severity,
      row_number() OVER (PARTITION BY ingredient_id ORDER BY weight DESC, rule_id) AS rule_no FROM assessed""")
def _(t):
    ordered = rules.ordered_rules(assessed(t), F.floor(F.col("rule_id") / 4096))
    return ordered.select("ingredient_id", "rule_id", "severity", "rule_no")


@check("agg_2_highest_severity", "WITH " + DICT_CTE + "SELECT ingredient_id, " + NAME_OF.format(w="weight") + " AS severity, rules FROM graded")
def _(t):
    return graded(t).select("ingredient_id", "severity", "rules")


@check("agg_3_label_verdicts", HEAD + "," + COUNTS + VERDICT)
def _(t):
    scored = resolve.resolve_tokens(keyed(t), catalog(t))
    return verdict.verdicts(verdict.label_counts(scored)).select(*VERDICT_COLUMNS)


@check("agg_5_incomplete_labels", HEAD + "," + COUNTS + """
    SELECT product_id, unmatched > 0 OR matched = 0 OR unknown > 0 AS incomplete FROM counted""")
def _(t):
    scored = resolve.resolve_tokens(keyed(t), catalog(t))
    return verdict.verdicts(verdict.label_counts(scored)).select("product_id", "incomplete")


PERSONAL_SQL = TEXT_HEAD + """,
    hit AS (SELECT r.product_id, p.user_id, r.ingredient_id, max(g.weight) AS weight, count(*) AS n,
        bool_or(x.ingredient_id IS NOT NULL) AS personal, min(r.pos) AS pos
      FROM resolved r JOIN parts p ON r.product_id = p.product_id
      LEFT JOIN graded g ON r.ingredient_id = g.ingredient_id
      LEFT JOIN exclusions x ON x.user_id = p.user_id AND x.ingredient_id = r.ingredient_id GROUP BY 1, 2, 3)"""


@check("agg_4_personal_verdicts", PERSONAL_SQL + """,
    counted AS (SELECT product_id, user_id, count(ingredient_id) AS matched,
      CAST(coalesce(sum(n) FILTER (WHERE ingredient_id IS NULL), 0) AS BIGINT) AS unmatched,
      count(*) FILTER (WHERE ingredient_id IS NOT NULL AND weight >= 1) + count(*) FILTER (WHERE personal) AS reasons,
      count(*) FILTER (WHERE personal) AS hits, coalesce(max(weight) FILTER (WHERE ingredient_id IS NOT NULL), -1) AS w FROM hit GROUP BY 1, 2),
    scored AS (SELECT *, least(100, CASE WHEN w = 3 THEN 95 WHEN w = 2 THEN 80 WHEN hits > 0 THEN 65 WHEN w = 1 THEN 45 ELSE 10 END
      + greatest(0, reasons - 1) * 5 + unmatched) AS s FROM counted)
    SELECT product_id, user_id, matched, unmatched, reasons, CASE WHEN hits > 0 THEN 'risky_for_user' WHEN w >= 2 THEN 'dangerous'
      WHEN w = 1 THEN 'attention' ELSE 'unknown' END AS level,
      CASE WHEN hits > 0 THEN greatest(95, s) WHEN w < 1 THEN 0 ELSE s END AS risk_score FROM scored""")
def _(t):
    out = analysis.personal_verdicts(t.label_texts, catalog(t), t.exclusions)
    return out.select("product_id", "user_id", "matched", "unmatched", "reasons", "level", "risk_score")


SHOWN = {name: text.replace("'", "''") for name, text in verdict.DESCRIPTIONS.items()}
PLAIN_TEXT = f"""CASE WHEN w = 3 THEN '{SHOWN['forbidden']}' WHEN w = 2 THEN '{SHOWN['avoid']}' WHEN w = 1 THEN '{SHOWN['attention']}'
      WHEN unmatched > 0 OR matched = 0 OR unknown > 0 THEN '{SHOWN['incomplete']}' ELSE '{SHOWN['clear']}' END"""


@check("agg_3_descriptions", TEXT_HEAD + "," + COUNTS + "SELECT product_id, " + PLAIN_TEXT + " AS description FROM (SELECT *, weight AS w FROM counted)")
def _(t):
    return analysis.analyse_labels(t.label_texts, catalog(t)).select("product_id", "description")


@check("agg_4_descriptions", PERSONAL_SQL + """,
    c AS (SELECT product_id, user_id, count(ingredient_id) AS matched, coalesce(sum(n) FILTER (WHERE ingredient_id IS NULL), 0) AS unmatched,
      count(*) FILTER (WHERE personal) AS hits, coalesce(max(weight) FILTER (WHERE ingredient_id IS NOT NULL), -1) AS w,
      count(*) FILTER (WHERE ingredient_id IS NOT NULL AND weight < 0) AS unknown FROM hit GROUP BY 1, 2),
    named AS (SELECT h.product_id, h.user_id, string_agg(concat_ws(' ', i.e_code, i.name), ', ' ORDER BY h.pos) AS names
      FROM hit h JOIN ingredients i ON i.ingredient_id = h.ingredient_id WHERE h.personal GROUP BY 1, 2)
    SELECT c.product_id, c.user_id, CASE WHEN hits > 0 THEN '""" + SHOWN["personal"] + "' || names ELSE " + PLAIN_TEXT + """ END AS description
    FROM c LEFT JOIN named ON named.product_id = c.product_id AND named.user_id = c.user_id""")
def _(t):
    names = t.ingredients.select("ingredient_id", "e_code", "name")
    return analysis.personal_verdicts(t.label_texts, catalog(t), t.exclusions, names).select("product_id", "user_id", "description")


@check("jon_7_personal_hits", PERSONAL_SQL + "SELECT product_id, user_id, ingredient_id, pos FROM hit WHERE personal")
def _(t):
    tokens = resolve.with_lookup_key(resolve.label_tokens(t.label_texts, keys=("product_id", "user_id")))
    hits = verdict.with_personal_hits(resolve.resolve_tokens(tokens, dictionary(t)), t.exclusions).where("personal")
    return hits.groupBy("product_id", "user_id", "ingredient_id").agg(F.min("pos").cast("long").alias("pos"))


@check("prj_21_reason_texts", "WITH " + DICT_CTE + f"""
    SELECT ingredient_id, CASE WHEN regulatory_status = 'PHASE_OUT' AND transition_end <= DATE '2025-06-01' THEN 'ended'
      ELSE coalesce(explanation, title) END AS reason
    FROM (SELECT r.*, x.transition_end, row_number() OVER (PARTITION BY r.ingredient_id ORDER BY {SEVERITY} DESC, r.rule_id) AS n
      FROM rules r JOIN assessed a ON a.rule_id = r.rule_id LEFT JOIN transitions x ON x.rule_id = r.rule_id) WHERE n = 1""")
def _(t):
    from provisor.functions.severity import PHASE_OUT_NOTE

    ordered = rules.ordered_rules(assessed(t), F.floor(F.col("rule_id") / 4096))
    texts = rules.reason_texts(ordered)
    return texts.withColumn("reason", F.when(F.col("reason") == PHASE_OUT_NOTE, "ended").otherwise(F.col("reason")))


@check("verdict_reasons", PERSONAL_SQL + """
    SELECT product_id, user_id, ingredient_id, pos, 'personal' AS severity FROM hit WHERE personal
    UNION ALL SELECT product_id, user_id, ingredient_id, pos, CASE weight WHEN 3 THEN 'forbidden' WHEN 2 THEN 'avoid' ELSE 'attention' END
    FROM hit WHERE weight >= 1""")
def _(t):
    tokens = resolve.with_lookup_key(resolve.label_tokens(t.label_texts.repartition("product_id", "user_id"), keys=("product_id", "user_id")))
    scored = resolve.resolve_tokens(tokens, catalog(t))
    flagged = verdict.with_personal_hits(scored, t.exclusions)
    rows = verdict.reason_rows(flagged, t.ingredients.select("ingredient_id", "name"), ("product_id", "user_id"))
    return rows.select("product_id", "user_id", "ingredient_id", F.col("pos").cast("long").alias("pos"), "severity")


@check("flt_17_tokens_to_review", HEAD + """
    SELECT product_id, pos, token FROM resolved WHERE ingredient_id IS NULL OR token = '' OR product_id % 10 = 0""")
def _(t):
    return resolve.review_tokens(resolved(t), F.col("product_id") % 10 == 0).select("product_id", "pos", "token")


@check("prj_8_display_risk", "WITH " + DICT_CTE + """
    SELECT ingredient_id, CASE WHEN weight >= 2 THEN 'avoid' WHEN weight = 1 THEN 'warning' WHEN weight < 0 OR rules = 0 THEN 'unknown' ELSE 'neutral' END AS risk
    FROM graded""")
def _(t):
    return graded(t).select("ingredient_id", verdict.display_risk().alias("risk"))


@check("agg_6_best_of_compared", HEAD + "," + COUNTS + """,
    v AS (""" + VERDICT + """),
    placed AS (SELECT product_id // 4 AS comparison_id, (product_id % 4) * 700 AS position, risk_score FROM v)
    SELECT comparison_id, arg_min(position, risk_score * 100000 + position) AS winner_position, min(risk_score) AS winner_score, count(*) AS products
    FROM placed GROUP BY 1""")
def _(t):
    scored = resolve.resolve_tokens(keyed(t), catalog(t))
    placed = verdict.verdicts(verdict.label_counts(scored)).select(
        F.floor(F.col("product_id") / 4).alias("comparison_id"), (F.col("product_id") % 4 * 700).alias("position"), "risk_score"
    )
    return verdict.best_of(placed)


@check("chg_2_reanalysed_corrections", "WITH corrected AS (" + CORRECTED_SQL + r"""), """ + DICT_CTE + r""",
    parts AS (SELECT product_id, list_filter(list_transform(regexp_split_to_array(corrected, '[,;()]'), lambda x: trim(x)), lambda x: x <> '') AS p
      FROM corrected WHERE corrected IS NOT NULL),
    keyed AS (SELECT product_id, pos, token, CASE WHEN token NOT LIKE 'without%' AND regexp_matches(token, 'E-?\d{3,4}')
      THEN lower('E' || regexp_extract(token, 'E-?(\d{3,4})', 1)) END AS code,
      trim(regexp_replace(lower(token), '[^a-z0-9_]+', ' ', 'g')) AS name
      FROM (SELECT product_id, unnest(p) AS token, generate_subscripts(p, 1) - 1 AS pos FROM parts)),""" + RESOLVED + "," + COUNTS + VERDICT)
def _(t):
    fixed = corrected_texts(t.label_texts).where("corrected is not null").select("product_id", F.col("corrected").alias("text"))
    out = analysis.analyse_labels(fixed, catalog(t))
    return out.select(*VERDICT_COLUMNS)
