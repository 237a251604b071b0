"""Source fragments flattened into documents, links, tags, references and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisor.plans.flatten import flatten_fragments
from provisor_checks.registry import check


def fragments(t):
    """Documents, profiles and matches in turn; addresses repeat, lists hold repeats."""
    n = F.col("p_partkey")
    link = lambda head, of: F.concat(F.lit(f"https://{head}.example.org/"), of.cast("string"))
    tag = lambda name: F.struct(F.col(name).alias("title"), link("tag", F.col(name)).alias("url"))
    reference = lambda k: F.struct(
        link("doc", (n + k) % 60).alias("url"), F.concat(F.lit(f"ref {k} of "), n.cast("string")).alias("title"), F.lit("article_link").alias("relation"),
        F.lit(None).cast("string").alias("organization"))
    return t.part.select(
        n.alias("fragment_id"), F.element_at(F.array(*map(F.lit, ("document_reference", "additive_profile", "regulatory_match"))), (n % 3 + 1).cast("int")).alias("record_kind"),
        n.alias("ingredient_id"), F.lit(1).alias("source_id"), F.col("p_name").alias("title"), link("doc", n % 60).alias("url"), F.lit("x").alias("verification_status"),
        F.lit(None).cast("timestamp").alias("fetched_at"), F.array(link("law", n % 9), link("law", n % 9), link("law", n % 7)).alias("external_urls"),
        F.array(link("file", n)).alias("file_urls"), F.array(tag("p_brand"), tag("p_brand")).alias("categories"), F.array(tag("p_type")).alias("origins"),
        F.array(reference(0), reference(1)).alias("references"), F.array(link("page", n % 40), link("page", n % 40)).alias("related_urls"),
        link("page", n % 50).alias("source_url"), F.lit(True).alias("has_article"), F.lit("own").alias("full_description_status"),
        F.concat(F.lit("old-"), n.cast("string")).alias("legacy_id"), F.lit("exact_e_code").alias("method"))


DOCS = "p AS (SELECT p_partkey AS n, p_name, p_brand, p_type FROM part), d AS (SELECT * FROM p WHERE n % 3 = 0), a AS (SELECT * FROM p WHERE n % 3 = 1)"


@check("prj_3_document_links", "WITH " + DOCS + """
    SELECT n AS document_id, 'external' AS relation, 'https://law.example.org/' || (n % 9) AS url FROM d
    UNION SELECT n, 'external', 'https://law.example.org/' || (n % 7) FROM d UNION SELECT n, 'file', 'https://file.example.org/' || n FROM d""")
def _(t):
    return flatten_fragments(fragments(t))["document_links"].select("document_id", "relation", "url")


@check("prj_3_tags", "WITH " + DOCS + """
    SELECT n AS ingredient_id, 'category' AS tag_type, p_brand AS name, 'https://tag.example.org/' || p_brand AS url FROM a
    UNION ALL SELECT n, 'origin', p_type, 'https://tag.example.org/' || p_type FROM a""")
def _(t):
    return flatten_fragments(fragments(t))["ingredient_tags"].select("ingredient_id", "tag_type", "name", "url")


@check("prj_3_profiles_and_matches", """
    SELECT CASE p_partkey % 3 WHEN 1 THEN 'profile' ELSE 'match' END AS kind, p_partkey AS ingredient_id,
      CASE p_partkey % 3 WHEN 1 THEN 'https://page.example.org/' || (p_partkey % 50) ELSE 'old-' || p_partkey END AS value FROM part WHERE p_partkey % 3 <> 0""")
def _(t):
    out = flatten_fragments(fragments(t))
    return out["ingredient_profiles"].select(F.lit("profile").alias("kind"), "ingredient_id", F.col("source_url").alias("value")).unionAll(
        out["ingredient_matches"].select(F.lit("match"), "ingredient_id", "legacy_ingredient_id"))


@check("jon_22_references", "WITH " + DOCS + """,
    r AS (SELECT n, unnest([0, 1]) AS k FROM a), o AS (SELECT 'https://doc.example.org/' || (n % 60) AS url, max(n) AS document_id FROM d GROUP BY 1)
    SELECT n AS ingredient_id, u.url, 'ref ' || k || ' of ' || n AS title, document_id
    FROM (SELECT n, k, 'https://doc.example.org/' || ((n + k) % 60) AS url FROM r) u LEFT JOIN o ON o.url = u.url""")
def _(t):
    return flatten_fragments(fragments(t))["ingredient_references"].select("ingredient_id", "url", "title", "document_id")


@check("jon_22_relations", "WITH " + DOCS + """,
    o AS (SELECT 'https://page.example.org/' || (n % 50) AS url, max(n) AS owner FROM a GROUP BY 1)
    SELECT n AS ingredient_id, u.url AS related_url, owner AS related_ingredient_id
    FROM (SELECT n, 'https://page.example.org/' || (n % 40) AS url FROM a) u LEFT JOIN o ON o.url = u.url""")
def _(t):
    return flatten_fragments(fragments(t))["ingredient_relations"].select("ingredient_id", "related_url", "related_ingredient_id")
