"""Personal exclusions."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisor.operators import preferences as prefs
from provisor_checks.registry import check

TARGETS = """
    targets AS (SELECT legacy_ingredient_id AS requested, ingredient_id FROM matches
      UNION SELECT alias, ingredient_id FROM aliases WHERE source = 'legacy_preference_id'
      UNION SELECT alias, ingredient_id FROM alias_review WHERE source = 'legacy_preference_id')"""
SINGLE = TARGETS + """,
    candidates AS (SELECT CAST(ingredient_id AS VARCHAR) AS requested, ingredient_id FROM ingredients WHERE is_active
      UNION SELECT t.requested, t.ingredient_id FROM targets t JOIN ingredients i ON t.ingredient_id = i.ingredient_id WHERE i.is_active),
    single AS (SELECT requested, min(ingredient_id) AS ingredient_id FROM candidates GROUP BY 1 HAVING count(DISTINCT ingredient_id) = 1)"""


def targets(t):
    return prefs.legacy_targets(t.matches, t.aliases, t.alias_review)


@check("jon_8_legacy_targets", "WITH " + TARGETS + "SELECT requested, ingredient_id FROM targets")
def _(t):
    return targets(t)


@check("set_1_widened_exclusions", "WITH " + TARGETS + """
    SELECT user_id, requested AS excluded_id FROM requested_ids
    UNION SELECT r.user_id, CAST(t.ingredient_id AS VARCHAR) FROM requested_ids r JOIN targets t ON r.requested = t.requested""")
def _(t):
    return prefs.widened_exclusions(t.requested_ids, targets(t))


@check("jon_9_imported_preferences", "WITH " + SINGLE + """
    SELECT r.user_id, r.requested, s.ingredient_id, CASE WHEN s.ingredient_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS outcome
    FROM requested_ids r LEFT JOIN single s ON r.requested = s.requested""")
def _(t):
    return prefs.import_outcome(t.requested_ids, t.ingredients, targets(t))


@check("set_3_unresolved_ids", "WITH " + SINGLE + """
    SELECT DISTINCT requested FROM requested_ids WHERE requested NOT IN (SELECT requested FROM single)""")
def _(t):
    out = prefs.import_outcome(t.requested_ids, t.ingredients, targets(t))
    return out.where("outcome = 'unresolved'").select("requested").distinct()


@check("jon_10_preference_catalog", "WITH " + TARGETS + """
    SELECT i.ingredient_id, i.name, coalesce(string_agg(DISTINCT t.requested, '|' ORDER BY t.requested), '') AS legacy_ids
    FROM ingredients i LEFT JOIN targets t ON i.ingredient_id = t.ingredient_id WHERE i.is_active GROUP BY 1, 2""")
def _(t):
    out = prefs.preference_catalog(t.ingredients, targets(t))
    return out.select("ingredient_id", "name", F.array_join("legacy_ids", "|").alias("legacy_ids"))


@check("jon_24_preference_snapshots", """
    SELECT c_custkey AS user_id, string_agg(CAST(x.ingredient_id AS VARCHAR), '|' ORDER BY x.ingredient_id) AS excluded,
      CAST(coalesce(max(p.revision), 0) AS INTEGER) AS revision, max(p.local_imported_at) IS NOT NULL AS local_imported
    FROM customer LEFT JOIN preferences p ON c_custkey = p.user_id LEFT JOIN exclusions x ON c_custkey = x.user_id GROUP BY 1""")
def _(t):
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    out = prefs.preference_snapshot(users, t.preferences, t.exclusions)
    return out.withColumn("excluded", F.array_join(F.transform("excluded", lambda x: x.cast("string")), "|"))


@check("jon_21_coded_exclusions", """
    SELECT x.user_id, x.ingredient_id, upper(i.e_code) AS e_code FROM exclusions x JOIN ingredients i ON x.ingredient_id = i.ingredient_id
    WHERE i.is_active AND i.e_code IS NOT NULL""")
def _(t):
    return prefs.coded_exclusions(t.exclusions, t.ingredients)


REPLACE = """
    requests AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN 99 ELSE c_nationkey END AS revision FROM customer),
    items AS (SELECT c_custkey AS user_id, c_custkey % 500 AS ingredient_id FROM customer UNION SELECT c_custkey, (c_custkey * 3) % 500 FROM customer),
    bad AS (SELECT user_id, count(*) AS n FROM items WHERE ingredient_id NOT IN (SELECT ingredient_id FROM ingredients WHERE is_active) GROUP BY 1),
    outcome AS (SELECT r.user_id, r.revision, CASE WHEN coalesce(p.revision, 0) <> r.revision THEN 'stale_revision'
      WHEN coalesce(b.n, 0) > 0 THEN 'inactive_ingredient' ELSE 'accepted' END AS outcome
      FROM requests r LEFT JOIN preferences p ON r.user_id = p.user_id LEFT JOIN bad b ON r.user_id = b.user_id)"""


def replacement(t):
    requests = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 4 == 0, 99).otherwise(F.col("c_nationkey")).alias("revision")
    )
    items = t.sql("SELECT c_custkey AS user_id, c_custkey % 500 AS ingredient_id FROM customer UNION SELECT c_custkey, (c_custkey * 3) % 500 FROM customer")
    return prefs.replace_exclusions(requests, items, t.exclusions, t.preferences, t.ingredients)


@check("set_7_replaced_exclusions", "WITH " + REPLACE + """
    SELECT user_id, ingredient_id FROM exclusions WHERE user_id NOT IN (SELECT user_id FROM outcome WHERE outcome = 'accepted')
    UNION ALL SELECT user_id, ingredient_id FROM items WHERE user_id IN (SELECT user_id FROM outcome WHERE outcome = 'accepted')""")
def _(t):
    return replacement(t)[0]


@check("set_7_replacement_outcomes", "WITH " + REPLACE + "SELECT user_id, revision, outcome FROM outcome")
def _(t):
    return replacement(t)[1]
