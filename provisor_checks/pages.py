"""Stored pages, products and taxonomy lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisor.plans import profiles
from provisor.sources import pages as pg, products as pr, taxonomy as tx
from provisor.session import shared_dir
from provisor_checks.registry import check

LINKS = r"""lk AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
    ab AS (SELECT page_id, url, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^https?://[^/?#]+') || href ELSE href END AS target FROM lk)"""


def odd_markup(t):
    """The pages in markup that says the same: other quotes, case and order, comments, entities, dot segments.

    The address serves as key of the nodes, so it holds the page number.
    """
    link = F.regexp_replace("html", '<a href="/([^"]*)">', "<A class=nav HREF='/x/../$1' title=\"a > b\">")
    ghost = F.concat(link, F.lit('<!-- <a href="/ghost">ghost</a> --><script>var s = \'<a href="/script">s</a>\';</script>'))
    spaced = F.regexp_replace(ghost, "<h1>", "<h1\n class=title>")
    return t.pages.select("page_id", F.concat(F.lit("http://host.example.net/p/"), F.col("page_id").cast("string")).alias("url"), spaced.alias("html"))


NUMBERED = r"""pg AS (SELECT page_id, 'http://host.example.net/p/' || page_id AS url, html FROM pages)"""


@check("src_5_page_links", "WITH " + NUMBERED + r"""
    SELECT DISTINCT url AS page_key, 'http://host.example.net' || h AS target FROM (SELECT url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS h FROM pg)""")
def _(t):
    return pg.page_links(pg.page_nodes(odd_markup(t)))


def index_pages(t):
    """Cards in turn with the link before and after the code, one without code, one that is no card; a pager on some pages."""
    n = F.col("page_id").cast("string")
    cards = F.concat(
        F.lit('<div><a href="e'), n, F.lit('" class="big addicon__link"><img src=x></a><p><span class=\'addicon__name\'> E1'), F.lpad(n, 3, "0"), F.lit("</span></p></div>"),
        F.lit("<div><span class=addicon__name>E2"), F.lpad(n, 2, "0"), F.lit('</span><a class="addicon__link" href="../odd/./f'), n, F.lit('?a=1&amp;b=2">y</a></div>'),
        F.lit('<div><a class="addicon__link" href="/none">z</a></div><div><a class="addicon__links" href="/no">n</a><span class="addicon__name">E999</span></div>'))
    pager = F.when(F.col("page_id") % 3 == 0, F.lit('<ul class="pager x"><li><a name="top">.</a><a href=\'?page=2&amp;q=1\'>next</a><a href="?page=3">3</a></ul>')).otherwise("")
    html = F.when(F.col("page_id") % 5 == 4, "<p>nothing here</p>").otherwise(F.concat(cards, pager))
    return t.pages.select(F.concat(F.lit("https://s.example.org/ru/list/"), n, F.lit("?page=1")).alias("url"), html.alias("html"))


@check("src_5_index_entries", """
    WITH p AS (SELECT page_id AS n, 'https://s.example.org/ru/list/' || page_id || '?page=1' AS url FROM pages WHERE page_id % 5 <> 4)
    SELECT url AS page_key, 'https://s.example.org/ru/list/e' || n AS entry_url, 'E1' || lpad(substr(n::VARCHAR, 1, 3), 3, '0') AS code FROM p
    UNION ALL SELECT url, 'https://s.example.org/ru/odd/f' || n || '?a=1&b=2', 'E2' || lpad(substr(n::VARCHAR, 1, 2), 2, '0') FROM p
    UNION ALL SELECT url, 'https://s.example.org/none', NULL FROM p""")
def _(t):
    return pg.index_entries(pg.page_nodes(index_pages(t)))


@check("src_5_next_pages", """
    SELECT 'https://s.example.org/ru/list/' || page_id || '?page=1' AS page_key, 'https://s.example.org/ru/list/' || page_id || '?page=2&q=1' AS next_url
    FROM pages WHERE page_id % 5 <> 4 AND page_id % 3 = 0""")
def _(t):
    return pg.next_pages(pg.page_nodes(index_pages(t)))


@check("src_5_index_violations", """
    SELECT 'https://s.example.org/ru/list/' || page_id || '?page=1' AS page_key, CASE WHEN page_id % 5 = 4 THEN 'no_cards' ELSE 'invalid_code' END AS rule,
      CASE WHEN page_id % 5 <> 4 THEN 'https://s.example.org/none' END AS detail FROM pages""")
def _(t):
    pages = index_pages(t)
    return pg.index_violations(pages, pg.page_nodes(pages))


@check("src_6_page_heads", "WITH " + NUMBERED + r""",
    plain AS (SELECT page_id, regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g') AS h FROM pg)
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS title FROM plain""")
def _(t):
    pages = odd_markup(t)
    return pg.page_heads(pages, pg.page_nodes(pages)).select("page_id", "title")


def article_pages(t):
    """Article pages with tags, synonyms, noise, references, related articles and mentions; every seventh has none."""
    n = F.col("page_id").cast("string")
    html = F.concat(
        F.lit("<h1>E"), n, F.lit(" &ndash; Name &#8470;"), n, F.lit('</h1><article class="node node--additive"><span class="addicon__name"> E'), n, F.lit("</span>"),
        F.lit('<div class="addprop--origin"><a href="/o/1">plant</a></div><div class=addprop--category><a href=/c/2>dye</a><a href="/c/3">acid</a></div>'),
        F.lit('<div class="field--additive-synonyms"><div class="field__content">one, two;three</div></div><div class="field--additive-info"><p> </p><p>'),
        F.array_join(F.transform(F.sequence(F.lit(1), F.col("page_id") % 40 + 1), lambda i: F.concat(F.lit("w"), i.cast("string"))), " "),
        F.lit('<script>x("<p>no</p>")</script></p><div class="block--advert-block"><a href="https://ad.example.com/buy">ad</a><h2>Ad</h2></div><h2>Use</h2>'),
        F.lit('<p>See <a href="https://who.example.org/d?x=1&amp;y=2">first</a> <a href="https://who.example.org/d?x=1&amp;y=2">last</a><a href="mailto:a@b.example">m</a>'),
        F.lit('<a href="/ru/additives/e'), n, F.lit('a#top">own</a></p></div></article><div id="block-views-block-related-documents-related-documents">'),
        F.lit('<div class="node__content"><div class="field--node-link"><a href="/doc/'), n, F.lit('">Act</a></div><div class="field--country-organization">Org '), n,
        F.lit('</div></div><div class="node__content"><div class="field--node-link"><a href="/doc/none">Other</a></div></div></div>'))
    return t.pages.select(F.concat(F.lit("https://s.example.org/ru/additives/e"), n).alias("url"), F.when(F.col("page_id") % 7 == 6, "<h1>gone</h1>").otherwise(html).alias("html"))


ARTICLES = """a AS (SELECT page_id AS n, 'https://s.example.org/ru/additives/e' || page_id AS url FROM pages WHERE page_id % 7 <> 6)"""


@check("src_6_article_profiles", "WITH " + ARTICLES + """,
    w AS (SELECT *, list_transform(range(1, least(n % 40 + 1, 25) + 1), lambda i: 'w' || i) AS w FROM a)
    SELECT url AS source_url, 'E' || n AS e_code, 'Name №' || n AS name, array_to_string(w, ' ') || CASE WHEN n % 40 + 1 > 25 THEN '…' ELSE '' END AS description_excerpt,
      n % 40 + 1 > 25 AS excerpt_truncated, true AS has_article, 'one|two|three' AS synonyms, true AS valid FROM w""")
def _(t):
    rows = pg.article_profiles(pg.page_nodes(article_pages(t))).where("e_code is not null")
    return rows.withColumn("synonyms", F.array_join("synonyms", "|"))


@check("src_6_tags", "WITH " + ARTICLES + """
    SELECT url AS source_url, 'origin' AS tag_type, 'plant' AS title, 'https://s.example.org/o/1' AS url FROM a
    UNION ALL SELECT url, 'category', 'dye', 'https://s.example.org/c/2' FROM a UNION ALL SELECT url, 'category', 'acid', 'https://s.example.org/c/3' FROM a""")
def _(t):
    return pg.article_tags(pg.page_nodes(article_pages(t)))


@check("src_6_sections", "WITH " + ARTICLES + "SELECT url AS source_url, 'Use' AS section FROM a")
def _(t):
    return pg.article_sections(pg.page_nodes(article_pages(t))).select("source_url", "section")


@check("src_6_references", "WITH " + ARTICLES + """
    SELECT url AS source_url, 'https://who.example.org/d?x=1&y=2' AS url, 'last' AS title, 'article_link' AS relation, NULL::VARCHAR AS organization FROM a
    UNION ALL SELECT url, 'https://s.example.org/doc/' || n, 'Act', 'mentioned_in_document', 'Org ' || n FROM a
    UNION ALL SELECT url, 'https://s.example.org/doc/none', 'Other', 'mentioned_in_document', NULL FROM a""")
def _(t):
    return pg.article_references(pg.page_nodes(article_pages(t)))


@check("src_6_related", "WITH " + ARTICLES + "SELECT url AS source_url, url || 'a#top' AS related_url FROM a")
def _(t):
    return pg.related_articles(pg.page_nodes(article_pages(t)))


@check("src_6_article_violations", """
    WITH p AS (SELECT page_id AS n, 'https://s.example.org/ru/additives/e' || page_id AS page_key FROM pages)
    SELECT page_key, 'missing_article' AS rule, NULL::VARCHAR AS detail FROM p WHERE n % 7 = 6
    UNION ALL SELECT page_key, 'code_mismatch', CASE WHEN n % 7 <> 6 THEN 'E' || n END FROM p WHERE n % 4 = 1 OR n % 7 = 6""")
def _(t):
    pages = article_pages(t)
    n = F.regexp_extract("url", r"(\d+)$", 1).cast("long")
    expected = pages.select(F.col("url").alias("page_key"), F.concat(F.lit("E"), F.when(n % 4 == 1, "x").otherwise(n.cast("string"))).alias("e_code"))
    return pg.article_violations(pages, pg.page_nodes(pages), expected)


@check("src_7_document_links", """
    WITH p AS (SELECT page_id AS n, 'https://d.example.net/docs/' || page_id AS page_key FROM pages WHERE page_id % 6 <> 5)
    SELECT page_key, 'external' AS relation, 'https://law.example.org/' || n || '/a' AS target FROM p
    UNION ALL SELECT page_key, 'file', 'https://d.example.net/files/' || n || '.pdf' FROM p""")
def _(t):
    """Adverts, comments and a second article are outside; own pages and mail are no links of a document."""
    n = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<a href="https://ad.example.com/">ad</a><article><A HREF="https://law.example.org/'), n, F.lit('/./b/../a">x</A><a href="//law.example.org/'), n,
        F.lit('/a">again</a><!-- <a href="https://old.example.org/">o</a> --><a href="../files/'), n, F.lit('.pdf">f</a><a href="/docs/1">own</a><a href=mailto:x@y.example>m</a></article>'),
        F.lit('<article><a href="https://second.example.org/">s</a></article>'))
    pages = t.pages.select(F.concat(F.lit("https://d.example.net/docs/"), n).alias("url"), F.when(F.col("page_id") % 6 == 5, "<p>none</p>").otherwise(html).alias("html"))
    return pg.document_links(pg.page_nodes(pages), "d.example.net")


@check("src_8_reading_notes", "WITH " + ARTICLES + """
    SELECT url AS source_url, 'Введение' AS section, array_to_string(list_transform(range(1, n % 40 + 2), lambda i: 'w' || i), ' ') AS note FROM a
    UNION ALL SELECT url, 'Use', 'See first last m own' FROM a""")
def _(t):
    return pg.reading_notes(pg.page_nodes(article_pages(t)))


@check("src_9_unprocessed_pages", "SELECT page_id, sha256(url) AS page_key FROM pages WHERE page_id % 3 <> 0")
def _(t):
    done = t.pages.where("page_id % 3 = 0").select(F.sha2("url", 256).alias("page_key"))
    return pg.unprocessed(t.pages, done).select("page_id", "page_key")


PRODUCTS = """pr AS (SELECT CAST(p_partkey AS STRING) AS code, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS product_name, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_type END AS generic_name,
      p_brand AS brands, CASE WHEN p_size % 4 = 0 THEN ' ' WHEN p_size % 4 = 1 THEN NULL ELSE 'salt, ' || p_name END AS ingredients_text,
      CASE WHEN p_size % 5 = 0 THEN ' , ' || p_type || ',x' END AS categories, CASE WHEN p_size % 7 = 0 THEN NULL ELSE '10 g' END AS quantity FROM part)"""


def products(t):
    return t.sql(PRODUCTS[PRODUCTS.index("(") + 1:-1])


@check("src_11_lookup_outcomes", "WITH " + PRODUCTS + """,
    rq AS (SELECT DISTINCT CAST(l_partkey + l_linenumber * 50 AS STRING) AS barcode FROM lineitem)
    SELECT r.barcode, CASE WHEN p.code IS NOT NULL THEN coalesce(nullif(p.product_name, ''), p.generic_name, 'Продукт без названия') END AS product_name, p.brands AS brand,
      CASE WHEN trim(p.ingredients_text) <> '' THEN p.ingredients_text END AS ingredients_text,
      CASE WHEN p.code IS NULL THEN 'not_found' WHEN coalesce(trim(p.ingredients_text), '') = '' THEN 'no_composition' ELSE 'analysable' END AS outcome
    FROM rq r LEFT JOIN pr p ON r.barcode = p.code""")
def _(t):
    requests = t.lineitem.select((F.col("l_partkey") + F.col("l_linenumber") * 50).cast("string").alias("barcode")).distinct()
    return pr.lookup(requests, products(t))


@check("prj_6_display_fields", "WITH " + PRODUCTS + """
    SELECT code, coalesce(nullif(product_name, ''), generic_name, 'Продукт без названия') AS name, brands AS brand,
      CASE WHEN categories IS NOT NULL THEN trim(split_part(categories, ',', 2)) ELSE 'tag of ' || code END AS category, quantity FROM pr""")
def _(t):
    tagged = products(t).withColumn("categories_tags", F.array(F.concat(F.lit("en:tag-of-"), "code")))
    return pr.display_fields(tagged)


@check("prj_7_composition_text", "WITH " + PRODUCTS + """
    SELECT code, CASE WHEN coalesce(trim(ingredients_text), '') <> '' THEN ingredients_text ELSE 'sugar, cane ' || code || ', a, b, c, d, e, f, last ' || code || ', salt' END AS composition FROM pr""")
def _(t):
    deep = F.lit('{"ingredients":[{"text":"b","ingredients":[{"ingredients":[{"id":"fr:d","ingredients":[{"ingredients":[{"text":"f","ingredients":[{"text":"last ')
    close = F.lit('"}]}],"text":"e"}]}],"text":"c"}]}],"text":"a"}')
    tree = F.concat(F.lit('[{"text":"sugar","ingredients":[{"id":"en:cane '), "code", F.lit('"},'), deep, "code", close, F.lit(']},{"id":"en:salt"}]'))
    return pr.composition_text(products(t).withColumn("ingredients", tree))


@check("prj_11_short_descriptions", """
    SELECT p_partkey, p_name || ' (E' || p_partkey || ').' || CASE WHEN p_size % 2 = 0 THEN ' Функции: ' || p_type || '; ' || p_brand || '.' ELSE '' END
      || CASE WHEN p_size % 3 = 0 THEN ' ' || p_brand || '.' ELSE '' END AS description FROM part""")
def _(t):
    none = F.array().cast("array<string>")
    text = profiles.short_description(
        F.col("p_name"), F.concat(F.lit("E"), F.col("p_partkey").cast("string")),
        F.when(F.col("p_size") % 2 == 0, F.array("p_type", "p_brand")).otherwise(none), F.when(F.col("p_size") % 3 == 0, F.array("p_brand")).otherwise(none))
    return t.part.select("p_partkey", text.alias("description"))


def profile_records(t):
    return t.part.select(
        F.concat(F.lit("E"), (100 + F.col("p_partkey")).cast("string")).alias("e_code"), F.col("p_name").alias("name"),
        F.concat(F.lit("https://acts.example.org/"), F.col("p_partkey").cast("string")).alias("source_url"), (F.col("p_size") % 4 != 0).alias("has_article"),
        F.lit("first words").alias("description_excerpt"), F.array("p_type", "p_name").alias("synonyms"), F.array("p_type").alias("functions"),
        F.array("p_brand").alias("origins"), F.lit(1).alias("danger"))


def profile_texts(t):
    return t.part.where("p_size % 3 = 0").select(F.concat(F.lit("E"), (100 + F.col("p_partkey")).cast("string")).alias("code"), F.col("p_name").alias("new_text"))


@check("prj_12_profile_aliases", """
    SELECT DISTINCT p_partkey, alias FROM (SELECT p_partkey, unnest(['E' || (100 + p_partkey), p_name, p_type]) AS alias FROM part)""")
def _(t):
    bundle = profiles.profile_bundle(profile_records(t), profile_texts(t), "PROFILES")
    codes = bundle["ingredients"].select("ingredient_id", (F.substring("e_code", 2, 20).cast("long") - 100).alias("p_partkey"))
    return bundle["ingredient_aliases"].join(codes, "ingredient_id").select("p_partkey", "alias")


@check("agg_25_profile_completeness", """
    SELECT count(*) AS additives, count(*) FILTER (WHERE p_size % 4 <> 0) AS with_article, count(*) FILTER (WHERE p_size % 4 <> 0 AND p_size % 3 = 0) AS with_full_description,
      count(*) FILTER (WHERE p_size % 4 = 0) AS without_article FROM part""")
def _(t):
    return profiles.completeness(profiles.profile_bundle(profile_records(t), profile_texts(t), "PROFILES"))


@check("dq_8_profile_violations", """
    SELECT 'invalid_code' AS rule, 'ingredients' AS table_name, p_partkey AS part_no FROM part WHERE p_partkey >= 9900""")
def _(t):
    bundle = profiles.profile_bundle(profile_records(t), profile_texts(t), "PROFILES")
    codes = bundle["ingredients"].select(F.col("ingredient_id").alias("key"), (F.substring("e_code", 2, 20).cast("long") - 100).alias("part_no"))
    return profiles.profile_violations(bundle).join(codes, "key").select("rule", "table_name", "part_no")


@check("win_11_line_blocks", r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
    SELECT doc_id AS file, line_no, CAST(sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS block FROM l""")
def _(t):
    lines = tx.number_lines(t.documents, "doc_id", "text")
    return tx.with_blocks(lines).select("file", F.col("line_no").cast("long").alias("line_no"), "block")


TAXONOMY = r"""SELECT p_partkey, 'en: ' || p_name || ' ' || CAST(p_partkey % 500 AS STRING) || ', ' || p_type || CASE WHEN p_partkey % 9 = 0 THEN ', E' || CAST(100 + p_partkey AS STRING) ELSE '' END
    || chr(10) || 'vegan:en: ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || '< en: ' || p_type ELSE '' END || chr(10) AS text FROM part"""


@check("src_1_taxonomy_names", """
    WITH n AS (SELECT 'en:' || p_name || ' ' || CAST(p_partkey % 500 AS VARCHAR) AS key,
      unnest([p_name || ' ' || CAST(p_partkey % 500 AS VARCHAR), p_type, CASE WHEN p_partkey % 9 = 0 THEN 'E' || CAST(100 + p_partkey AS VARCHAR) END]) AS name FROM part)
    SELECT DISTINCT key, 'en' AS language, name FROM n WHERE name IS NOT NULL""")
def _(t):
    parsed = tx.parse_taxonomy(tx.number_lines(t.sql(TAXONOMY), "p_partkey", "text"))
    return parsed["names"].select("key", "language", "name")


@check("src_1_lines_of_files", """
    WITH l AS (SELECT p_partkey, p_name || ' ' || CAST(p_partkey % 500 AS VARCHAR) AS name, p_type, p_brand FROM part)
    SELECT 'en:' || name AS key, 'names' AS part, count(DISTINCT p_type) AS n FROM l GROUP BY name
    UNION ALL SELECT 'en:' || name, 'properties', count(DISTINCT p_brand) FROM l GROUP BY name""")
def _(t):
    """The same text in files, read in splits; blocks end at blank lines of the files."""
    folder = shared_dir(t.spark, "taxonomy-files")
    t.sql(TAXONOMY).repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey").select("text").write.text(folder)
    parsed = tx.parse_taxonomy(tx.read_lines(t.spark, folder))
    types = t.part.select(F.col("p_type").alias("name")).distinct()
    names = parsed["names"].join(types, "name", "left_semi").groupBy("key").agg(F.count_distinct("name").alias("n"))
    values = parsed["properties"].groupBy("key").agg(F.count_distinct("value").alias("n"))
    return names.select("key", F.lit("names").alias("part"), "n").unionByName(values.select("key", F.lit("properties").alias("part"), "n"))


@check("agg_15_merged_blocks", """
    SELECT 'en:' || p_name || ' ' || CAST(p_partkey % 500 AS VARCHAR) AS key, count(DISTINCT p_brand) AS properties FROM part GROUP BY 1""")
def _(t):
    parsed = tx.parse_taxonomy(tx.number_lines(t.sql(TAXONOMY), "p_partkey", "text"))
    return parsed["properties"].groupBy("key").agg(F.count(F.lit(1)).alias("properties"))


@check("agg_16_property_conflicts", """
    WITH p AS (SELECT DISTINCT 'en:' || p_name || ' ' || CAST(p_partkey % 500 AS VARCHAR) AS key, p_brand AS value FROM part)
    SELECT key, 'vegan' AS property, 'en' AS language, value FROM p WHERE key IN (SELECT key FROM p GROUP BY 1 HAVING count(*) > 1)""")
def _(t):
    parsed = tx.parse_taxonomy(tx.number_lines(t.sql(TAXONOMY), "p_partkey", "text"))
    return tx.property_conflicts(parsed["properties"]).select("key", "property", "language", "value")


@check("jon_14_matched_entries", """
    WITH b AS (SELECT 'en:' || p_name || ' ' || CAST(p_partkey % 500 AS VARCHAR) AS key, CASE WHEN p_partkey % 9 = 0 AND 100 + p_partkey <= 9999 THEN 'E' || CAST(100 + p_partkey AS VARCHAR) END AS code,
      p_partkey % 9 = 0 AND 100 + p_partkey <= 9999 AS code_like FROM part),
    k AS (SELECT key, min(code) AS lo, max(code) AS hi, bool_or(code_like) AS code_like FROM b GROUP BY 1)
    SELECT k.key, CASE WHEN k.lo = k.hi AND i.ingredient_id IS NOT NULL THEN 'exact_e_code' WHEN k.lo IS NOT NULL OR k.code_like THEN 'code_review_required' ELSE 'untranslated' END AS match_method
    FROM k LEFT JOIN ingredients i ON k.lo = k.hi AND i.e_code = k.lo""")
def _(t):
    from provisor.plans.taxonomy import match_entries

    parsed = tx.parse_taxonomy(tx.number_lines(t.sql(TAXONOMY), "p_partkey", "text"))
    known = t.ingredients.withColumn("ingredient_id", F.col("ingredient_id").cast("string"))
    return match_entries(parsed, known).select("key", "match_method")


@check("jon_13_resolved_parents", """
    WITH b AS (SELECT DISTINCT 'en:' || p_name || ' ' || CAST(p_partkey % 500 AS VARCHAR) AS key, p_type, p_partkey % 3 = 0 AS has_parent FROM part),
    o AS (SELECT p_type, count(DISTINCT key) AS n FROM b GROUP BY 1)
    SELECT DISTINCT b.key, 'en:' || b.p_type AS parent_reference, CASE WHEN o.n > 1 THEN 'ambiguous' END AS reason FROM b JOIN o ON b.p_type = o.p_type WHERE b.has_parent""")
def _(t):
    from provisor.plans.taxonomy import match_entries, resolve_parents

    parsed = tx.parse_taxonomy(tx.number_lines(t.sql(TAXONOMY), "p_partkey", "text"))
    known = t.ingredients.withColumn("ingredient_id", F.col("ingredient_id").cast("string"))
    entries = match_entries(parsed, known)
    return resolve_parents(parsed, entries).join(entries.select("entry_id", "key"), "entry_id").select("key", "parent_reference", "reason")


@check("chg_10_enriched_ingredients", """
    WITH k AS (SELECT DISTINCT 'en:' || p_name || ' ' || CAST(p_partkey % 500 AS VARCHAR) AS key FROM part)
    SELECT (SELECT count(*) FROM part) AS ingredients, (SELECT count(*) FROM k) AS entries""")
def _(t):
    from provisor.plans.taxonomy import enrich_catalog

    base = {
        "ingredients": t.ingredients.withColumn("ingredient_id", F.col("ingredient_id").cast("string")).withColumn("kind", F.lit("x")),
        "ingredient_aliases": t.aliases.where("source = 'catalog'").select(
            F.col("alias").alias("alias_id"), F.col("ingredient_id").cast("string").alias("ingredient_id"), "alias", "normalized_alias", "language", "source",
            F.lit(1).cast("decimal(3,2)").alias("confidence"), F.col("ingredient_id").alias("position")),
    }
    tables, _ = enrich_catalog(base, tx.number_lines(t.sql(TAXONOMY), "p_partkey", "text"), "TAXONOMY")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.lit(1).alias("_k"))
    return one(tables["ingredients"], "ingredients").join(one(tables["taxonomy_entries"], "entries"), "_k").drop("_k")


@check("chg_10_alias_decisions", r"""
    WITH b AS (SELECT 'en:' || p_name || ' ' || CAST(p_partkey % 500 AS VARCHAR) AS key, p_name || ' ' || CAST(p_partkey % 500 AS VARCHAR) AS name, p_type,
      CASE WHEN p_partkey % 9 = 0 THEN 'E' || CAST(100 + p_partkey AS VARCHAR) END AS given_code, CASE WHEN p_partkey % 9 = 0 AND 100 + p_partkey <= 9999 THEN 'E' || CAST(100 + p_partkey AS VARCHAR) END AS code FROM part),
    k AS (SELECT key, min(code) AS lo, max(code) AS hi FROM b GROUP BY 1),
    e AS (SELECT k.key, i.ingredient_id FROM k JOIN ingredients i ON k.lo = k.hi AND i.e_code = k.lo),
    n AS (SELECT e.ingredient_id, unnest([b.name, b.p_type, b.given_code]) AS name FROM e JOIN b ON b.key = e.key),
    f AS (SELECT ingredient_id, language, normalized_alias AS form FROM aliases UNION SELECT ingredient_id, 'ru', lower(name) FROM ingredients
      UNION SELECT ingredient_id, 'en', lower(name_en) FROM ingredients
      UNION SELECT ingredient_id, 'en', lower(name) FROM n WHERE name IS NOT NULL AND NOT (regexp_matches(name, '^E[0-9]{3,4}$') AND name NOT IN (SELECT e_code FROM ingredients WHERE e_code IS NOT NULL))),
    many AS (SELECT form FROM f GROUP BY 1 HAVING count(DISTINCT ingredient_id) > 1)
    SELECT CAST(f.ingredient_id AS VARCHAR) AS ingredient_id, f.language, f.form AS normalized_alias, CASE WHEN f.form IN (SELECT form FROM many) THEN 'ambiguous_name'
      WHEN regexp_matches(f.form, '^e[0-9]{3,4}$') AND upper(f.form) IS DISTINCT FROM i.e_code THEN 'e_code_mismatch'
      WHEN length(regexp_replace(f.form, '[^a-z]', '', 'g')) < 2 AND NOT regexp_matches(f.form, '^e[0-9]{3,4}$') THEN 'name_fragment' END AS reason
    FROM f JOIN ingredients i ON i.ingredient_id = f.ingredient_id""")
def _(t):
    """Every alias of the enriched catalog, active or under review, over the aliases of all sources."""
    from provisor.plans.taxonomy import enrich_catalog

    owner = F.col("ingredient_id").cast("string")
    base = {
        "ingredients": t.ingredients.withColumn("ingredient_id", owner).withColumn("kind", F.lit("x")),
        "ingredient_aliases": t.aliases.select(
            F.concat_ws("/", owner, "alias").alias("alias_id"), owner.alias("ingredient_id"), "alias", "normalized_alias", "language", "source",
            F.lit(1).cast("decimal(3,2)").alias("confidence"), (F.col("ingredient_id") * 10 + F.length("source") % 10).alias("position")),
    }
    tables, _ = enrich_catalog(base, tx.number_lines(t.sql(TAXONOMY), "p_partkey", "text"), "TAXONOMY")
    names = ["ingredient_id", "language", "normalized_alias"]
    return tables["ingredient_aliases"].select(*names, F.lit(None).cast("string").alias("reason")).unionByName(tables["ingredient_alias_review"].select(*names, "reason"))
