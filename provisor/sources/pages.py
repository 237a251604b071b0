"""Stored HTML pages: index entries, articles, documents, reading notes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from provisor.functions.names import excerpt
from provisor.functions.text import strip_invisible
from provisor.session import bound_batches, ship

NOTE_CHARS = 1600
FIRST_SECTION = "Введение"
HIDDEN = {"script", "style", "ins", "head", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4"}
BLOCKS = HEADINGS | {"p", "li"}
NAMED = ("addicon__name", "field__content", "field--country-organization")

NODE_SCHEMA = "page_key string, seq int, tag string, classes string, href string, text string, path string, inside array<int>"
# Nodes that a worker hands over at once, and their characters.
NODE_ROWS, NODE_CHARS = 2_000, 2_000_000
# Elements whose content is no part of an article.
NOISE = r"(^| )(script|style|ins)\.|block--advert-block"


class _Nodes(HTMLParser):
    """Text blocks and links of a page in document order, with the classes around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.open, self.out, self.elements = [], [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.handle_data(" ")
            return
        a = dict(attrs)
        if tag in BLOCKS and self.open and self.open[-1]["tag"] == tag == "p":
            self._close(len(self.stack) - 1)
        self.elements += 1
        self.stack.append((tag, a.get("class") or "", a.get("id") or "", self.elements))
        if tag in BLOCKS or tag == "article" or (tag == "a" and a.get("href")) or any(c in (a.get("class") or "") for c in NAMED):
            node = dict(tag=tag, classes=a.get("class") or "", href=a.get("href"), text=[], depth=len(self.stack),
                        path=" ".join(f"{t}.{c.replace(' ', '.')}#{i}" for t, c, i, _ in self.stack), inside=[n for *_, n in self.stack])
            self.open.append(node)
            self.out.append(node)

    def _close(self, depth):
        del self.stack[depth:]
        while self.open and self.open[-1]["depth"] > depth:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._close(i)
                return

    def handle_data(self, data):
        if any(t in HIDDEN or "block--advert-block" in c for t, c, *_ in self.stack):
            return
        for node in self.open:
            node["text"].append(data)


def in_pieces(rows: Iterator[tuple[tuple, int]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of rows that come with their sizes, so that a worker never holds all nodes of a batch."""
    held, size = [], 0
    for row, chars in rows:
        held.append(row)
        size += chars
        if len(held) >= NODE_ROWS or size >= NODE_CHARS:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    yield pd.DataFrame(held, columns=columns)


def page_nodes(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """Blocks and links of every page as rows: (page_key, seq, tag, classes, href, text, path, inside).

    ``inside`` numbers the elements around a node, its own number last.
    The tree walk has no built-in counterpart; it runs per row on Arrow batches, everything after
    it is columnar.
    """

    def nodes_of(batch: pd.DataFrame) -> Iterator[tuple[tuple, int]]:
        for page_key, source in zip(batch["k"], batch["h"]):
            parser = _Nodes()
            parser.feed(source or "")
            parser.close()
            for i, n in enumerate(parser.out):
                text = " ".join(n["text"])
                yield (page_key, i, n["tag"], n["classes"], n["href"], text, n["path"], n["inside"]), len(text) + len(n["path"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in NODE_SCHEMA.split(", ")]
        for batch in batches:
            yield from in_pieces(nodes_of(batch), columns)

    ship(pages.sparkSession)
    bound_batches(pages.sparkSession)
    nodes = pages.select(F.col(key).cast("string").alias("k"), F.col(html).alias("h")).mapInPandas(parse, NODE_SCHEMA)
    return nodes.withColumn("text", strip_invisible(F.col("text")))


def _without_dots(url: Column) -> Column:
    """Resolve ``.`` and ``..`` in the path of an absolute address."""
    root = F.regexp_extract(url, r"^(https?://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^https?://[^?#]*(.*)$", 1)
    parts = F.split(path, "/")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", up(done)).when(p == ".", done).otherwise(
        F.concat(done, F.array(p))))
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    dotted = path.rlike(r"/\.\.?(/|$)")
    return F.when(dotted, F.concat(root, F.array_join(ended, "/"), rest)).otherwise(url)


def absolute(href: Column, base: Column) -> Column:
    """Resolve a link against the address of its page."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^?#]*/)", 1)
    whole = (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.rlike("^[#?]"), F.concat(F.regexp_replace(base, F.when(href.startswith("#"), r"#.*$").otherwise(r"[?#].*$"), F.lit("")), href))
        .otherwise(F.concat(F.when(folder.isin("", "http://", "https://"), F.concat(root, F.lit("/"))).otherwise(folder), href))
    )
    return F.when(whole.rlike("^https?://"), _without_dots(whole)).otherwise(whole)


def page_links(nodes: DataFrame) -> DataFrame:
    """Distinct links of every page: (page_key, target)."""
    return nodes.where("tag = 'a' and href is not null").select(
        "page_key", absolute(F.col("href"), F.col("page_key")).alias("target")).distinct()


# Fixed value: form of a code on an index card.
CARD_CODE = r"^E\d{3,4}[a-z]*(?:\([ivx]+\))?$"


def index_entries(nodes: DataFrame) -> DataFrame:
    """(page_key, entry_url, code) of index pages: the first code inside the parent of a card's link.

    Of several cards with one address the last one counts.
    """
    cards = nodes.where(F.col("classes").rlike(r"(^|\s)addicon__link(\s|$)") & F.col("href").isNotNull()).select(
        "page_key", "seq", "href", F.element_at("inside", F.greatest(-F.size("inside"), F.lit(-2))).alias("parent"))
    codes = nodes.where(F.col("classes").rlike(r"(^|\s)addicon__name(\s|$)")).select(
        "page_key", F.col("seq").alias("_seq"), "text", F.explode("inside").alias("parent"))
    first = codes.groupBy("page_key", "parent").agg(F.min_by("text", "_seq").alias("code"))
    rows = cards.join(first, ["page_key", "parent"], "left").withColumn("entry_url", absolute(F.col("href"), F.col("page_key")))
    return rows.groupBy("page_key", "entry_url").agg(F.max_by(F.struct("code"), "seq")["code"].alias("code"))


def index_violations(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_key, rule, detail): index pages without cards, and cards without a valid code."""
    entries = index_entries(nodes)
    wrong = entries.where(F.col("code").isNull() | ~F.col("code").rlike(CARD_CODE)).select(
        "page_key", F.lit("invalid_code").alias("rule"), F.col("entry_url").alias("detail"))
    bare = pages.select(F.col("url").alias("page_key")).join(entries, "page_key", "left_anti")
    return wrong.unionAll(bare.select("page_key", F.lit("no_cards").alias("rule"), F.lit(None).cast("string").alias("detail")))


def next_pages(nodes: DataFrame) -> DataFrame:
    """(page_key, next_url): the first link of a pager; pages without one have no row."""
    pager = nodes.where((F.col("tag") == "a") & F.col("href").isNotNull() & F.col("path").rlike(r"\.pager[.#]"))
    return pager.groupBy("page_key").agg(F.min_by("href", "seq").alias("href")).select(
        "page_key", absolute(F.col("href"), F.col("page_key")).alias("next_url"))


def page_heads(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Content hash and title (first heading) of every page: (page_id, url, page_sha256, title)."""
    title = nodes.where("tag = 'h1'").groupBy(F.col("page_key").alias("url")).agg(F.min_by("text", "seq").alias("title"))
    return pages.select("page_id", "url", F.sha2("html", 256).alias("page_sha256")).join(title, "url", "left")


def article_violations(pages: DataFrame, nodes: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(page_key, rule, detail): pages without an article, and with ``expected(page_key, e_code)``
    those whose article has another code or whose title doesn't begin with it."""
    urls = pages.select(F.col("url").alias("page_key"))
    none = urls.join(nodes.where("tag = 'article'"), "page_key", "left_anti").select(
        "page_key", F.lit("missing_article").alias("rule"), F.lit(None).cast("string").alias("detail"))
    if expected is None:
        return none
    found = article_profiles(nodes).select(F.col("source_url").alias("page_key"), F.col("e_code").alias("_found"), "valid")
    known = expected.join(found, "page_key")
    other = known.where(~F.col("e_code").eqNullSafe(F.col("_found"))).select("page_key", F.lit("code_mismatch").alias("rule"), F.col("_found").alias("detail"))
    title = known.where(F.col("e_code").eqNullSafe(F.col("_found")) & ~F.col("valid")).select(
        "page_key", F.lit("missing_title").alias("rule"), F.col("_found").alias("detail"))
    return none.unionAll(other).unionAll(title)


def article_profiles(nodes: DataFrame, body: str = "field--additive-info") -> DataFrame:
    """One row per article: code, name, excerpt of the first paragraph and synonyms."""
    inside = F.col("path").contains(body)
    first = F.min(F.when(inside & (F.col("tag") == "p") & (F.col("text") != ""), F.struct("seq", "text")))["text"]
    code = F.min(F.when(F.col("classes").contains("addicon__name"), F.struct("seq", "text")))["text"]
    heading = F.min(F.when(F.col("tag") == "h1", F.struct("seq", "text")))["text"]
    synonyms = F.min(F.when(F.col("path").contains("field--additive-synonyms") & F.col("classes").contains("field__content"), F.struct("seq", "text")))["text"]
    rows = nodes.groupBy("page_key").agg(code.alias("e_code"), heading.alias("heading"), first.alias("first"), synonyms.alias("synonyms"))
    parts = F.transform(F.split("synonyms", r"[,;\n]"), lambda s: F.btrim(s))
    return rows.withColumn("_x", excerpt(F.col("first"))).select(
        F.col("page_key").alias("source_url"), "e_code",
        F.regexp_replace(F.expr("substring(heading, length(e_code) + 1)"), r"(?U)^[\s–—-]+", "").alias("name"),
        F.col("_x.excerpt").alias("description_excerpt"), F.coalesce("_x.truncated", F.lit(False)).alias("excerpt_truncated"),
        F.col("_x.excerpt").isNotNull().alias("has_article"), F.filter(parts, lambda s: s != "").alias("synonyms"),
        (F.col("e_code").isNotNull() & F.col("heading").startswith(F.col("e_code"))).alias("valid"))


def article_tags(nodes: DataFrame) -> DataFrame:
    """Origin and category links of articles: (source_url, tag_type, title, url)."""
    kind = F.when(F.col("path").contains("addprop--origin"), "origin").when(F.col("path").contains("addprop--category"), "category")
    return nodes.where("tag = 'a'").withColumn("tag_type", kind).where("tag_type is not null").select(
        F.col("page_key").alias("source_url"), "tag_type", F.col("text").alias("title"), absolute(F.col("href"), F.col("page_key")).alias("url")).distinct()


def article_sections(nodes: DataFrame) -> DataFrame:
    body = F.col("path").contains("field--additive-info") & F.col("tag").isin("h2", "h3", "h4") & ~F.col("path").rlike(NOISE)
    return nodes.where(body).select(F.col("page_key").alias("source_url"), "seq", F.col("text").alias("section"))


def article_references(nodes: DataFrame, article_path: str = "/ru/additives/") -> DataFrame:
    """Outgoing links of articles and mentioned documents with their organization.

    Of several links to one address the last one counts, mentions after the article's own links.
    """
    inside = F.col("path").contains("field--additive-info") & ~F.col("path").rlike(NOISE)
    listed = F.col("path").contains("#block-views-block-related-documents") & F.col("path").contains("node__content")
    mentioned = listed & F.col("path").contains("field--node-link")
    # The entry of a mention: the element that holds its link and its organization.
    entry = F.element_at("inside", F.size(F.split(F.regexp_extract("path", r"^(.*?node__content[^ ]*)", 1), " ")))
    organization = nodes.where(listed & F.col("classes").contains("field--country-organization")).groupBy(
        F.col("page_key").alias("source_url"), entry.alias("entry")).agg(F.min_by("text", "seq").alias("organization"))
    rows = nodes.where((F.col("tag") == "a") & (inside | mentioned)).select(
        F.col("page_key").alias("source_url"), "seq", F.col("text").alias("title"), absolute(F.col("href"), F.col("page_key")).alias("url"),
        F.when(mentioned, "mentioned_in_document").otherwise("article_link").alias("relation"), F.when(mentioned, entry).alias("entry"))
    kept = rows.where(
        (F.col("relation") == "mentioned_in_document")
        | (F.col("url").rlike("^https?:") & ~F.coalesce(F.try_parse_url("url", F.lit("PATH")).startswith(article_path), F.lit(False))))
    last = kept.groupBy("source_url", "url").agg(F.max_by(F.struct("title", "relation", "entry"), F.struct(F.col("relation") == "mentioned_in_document", "seq")).alias("r"))
    return last.select("source_url", "url", "r.title", "r.relation", "r.entry").join(organization, ["source_url", "entry"], "left").drop("entry")


def related_articles(nodes: DataFrame, pattern: str = r"^/ru/additives/e\d+[a-z]*$") -> DataFrame:
    inside = (F.col("tag") == "a") & F.col("path").contains("field--additive-info") & ~F.col("path").rlike(NOISE)
    href = F.regexp_replace("href", "[?#].*$", "")
    return nodes.where(inside & href.rlike(pattern)).select(
        F.col("page_key").alias("source_url"), absolute(F.col("href"), F.col("page_key")).alias("related_url")).distinct()


def document_links(nodes: DataFrame, host: str, file_path: str = "/files/") -> DataFrame:
    """External and file links in the first article of document pages: (page_key, relation, target), distinct."""
    article = nodes.where("tag = 'article'").groupBy("page_key").agg(F.min_by(F.element_at("inside", -1), "seq").alias("_article"))
    inside = nodes.where("tag = 'a' and href is not null").join(article, "page_key").where(F.array_contains("inside", F.col("_article")))
    links = inside.select("page_key", absolute(F.col("href"), F.col("page_key")).alias("target"))
    own = F.try_parse_url("target", F.lit("HOST")) == host
    file = own & F.coalesce(F.try_parse_url("target", F.lit("PATH")).startswith(file_path), F.lit(False))
    relation = F.when(file, "file").when(F.col("target").rlike("^https?://") & ~F.coalesce(own, F.lit(False)), "external")
    return links.select("page_key", relation.alias("relation"), "target").where("relation is not null").distinct()


def reading_notes(nodes: DataFrame, body: str = "field--additive-info") -> DataFrame:
    """Text per section of an article, each cut at the note limit: (source_url, section, note).

    A section is opened by its heading; text before the first heading has a fixed title. Notes
    are short by definition, so only as many pieces as the limit needs are collected.
    """
    from pyspark.sql import Window

    inside = nodes.where(F.col("path").contains(body) & F.col("tag").isin("h2", "h3", "h4", "p", "li"))
    along = Window.partitionBy("page_key").orderBy("seq")
    heading = F.last(F.when(F.col("tag").startswith("h"), F.col("text")), ignorenulls=True).over(along)
    rows = inside.withColumn("section", F.coalesce(heading, F.lit(FIRST_SECTION))).where(~F.col("tag").startswith("h") & (F.col("text") != ""))
    used = F.sum(F.length("text") + 1).over(
        Window.partitionBy("page_key", "section").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("_used", F.coalesce(used, F.lit(0))).where(F.col("_used") < NOTE_CHARS)
    pieces = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return kept.groupBy("page_key", "section").agg(
        F.substring(F.array_join(F.transform(pieces, lambda p: p["text"]), " "), 1, NOTE_CHARS).alias("note")
    ).withColumnRenamed("page_key", "source_url")


def unprocessed(pages: DataFrame, done: DataFrame, refresh: bool = False) -> DataFrame:
    """Pages whose key (hash of the address) is not among the processed keys."""
    keyed = pages.withColumn("page_key", F.sha2("url", 256))
    return keyed if refresh else keyed.join(done.select("page_key"), "page_key", "left_anti")
