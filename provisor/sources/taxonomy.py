"""Taxonomy text: blank-line blocks of names, parents and properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from provisor.functions.names import escaped_names, taxonomy_key
from provisor.operators.spread import running_total
from provisor.session import cut_lineage

# Line shapes of the taxonomy format.
LANGUAGE = r"[a-z]{2,3}(?:[-_][a-z]+)*"
NAMES = rf"(?U)^({LANGUAGE}):\s*(.+)$"
PARENT = rf"(?U)^<\s*({LANGUAGE}):\s*(.+)$"
PROPERTY = rf"(?U)^([\w.-]+):({LANGUAGE}):\s*(.*)$"
DIRECTIVE = r"^(?:synonyms|stopwords):"

EDGES = r"(?U)^\s+|\s+$"
INNER_ENDS = r"[\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"

LINES_PER_BUCKET = 4096


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each file with one-based numbers: (file, line_no, line).

    Files are read in splits, so one file may be many tasks' work. Rows of a split keep their order and
    know where it starts; a line's number is the running count of lines in that order. Characters
    that end a line for a text editor only (such as a form feed) count as line ends too. The lines
    are written once, because the numbers inside a split belong to that one read.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("no"), F.split("value", INNER_ENDS).alias("parts"))
    kept = cut_lineage(raw, "taxonomy-text")
    counted = running_total(
        kept, ["file"], F.struct("at", F.floor(F.col("no") / LINES_PER_BUCKET)), "no", F.size("parts"), "upto")
    rows = counted.select("file", (F.col("upto") - F.size("parts")).alias("before"), F.posexplode("parts").alias("i", "line")).select(
        "file", (F.col("before") + F.col("i") + 1).alias("line_no"), "line")
    plain = F.when(F.col("line_no") == 1, F.regexp_replace("line", "^\\x{feff}", "")).otherwise(F.col("line"))
    return rows.select("file", "line_no", F.regexp_replace(plain, EDGES, "").alias("line"))


def number_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    clean = F.regexp_replace(text, "^\\x{feff}", "")
    lines = F.posexplode(F.split(clean, r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\x{2028}\x{2029}]"))
    return texts.select(F.col(key).alias("file"), lines.alias("line_no", "line")).select(
        "file", (F.col("line_no") + 1).alias("line_no"),
        F.regexp_replace("line", EDGES, "").alias("line"))


def with_blocks(lines: DataFrame) -> DataFrame:
    """Add the block number of each line: blank lines so far in its file."""
    return running_total(
        lines, ["file"], F.floor(F.col("line_no") / LINES_PER_BUCKET), "line_no", F.col("line") == "", "block")


def classify(blocks: DataFrame) -> DataFrame:
    """Non-blank, non-comment lines with ``kind`` and their parts (property, language, value)."""
    line = F.col("line")
    kind = (
        F.when(line.rlike(DIRECTIVE), "directive")
        .when(line.startswith("<"), F.when(line.rlike(PARENT), "parent").otherwise("unparsed"))
        .when(line.rlike(PROPERTY), "property").when(line.rlike(NAMES), "names").otherwise("unparsed")
    )
    rows = blocks.where((line != "") & ~line.startswith("#")).withColumn("kind", kind)
    k = F.col("kind")

    def part(parent: int | None, prop: int | None, names: int | None):
        out = F.lit(None).cast("string")
        for name, pattern, group in (("parent", PARENT, parent), ("property", PROPERTY, prop), ("names", NAMES, names)):
            if group:
                out = F.when(k == name, F.regexp_extract(line, pattern, group)).otherwise(out)
        return out

    return rows.select(
        "file", "block", "line_no", "kind", "line", part(None, 1, None).alias("property"), part(1, 2, 1).alias("language"),
        F.btrim(part(2, 3, 2)).alias("value"))


def parse_taxonomy(lines: DataFrame) -> dict[str, DataFrame]:
    """Entries of a taxonomy, all long: blocks of one key are merged.

    ``names`` is unique per (key, language, name) with the position of its first occurrence.
    A block without names gives no entry; ``empty_names`` lists the lines that should have some.
    Classified lines, names and keys of blocks are written once; every part reads them.
    """
    rows = cut_lineage(classify(with_blocks(lines)), "taxonomy-classified")
    named = cut_lineage(rows.where("kind = 'names'").select(
        "file", "block", "line_no", "language", F.posexplode(escaped_names(F.col("value"))).alias("i", "name")), "taxonomy-named")
    # The key comes from English, else Russian, else the first language; then the first name.
    rank = F.when(F.col("language") == "en", 0).when(F.col("language") == "ru", 1).otherwise(2)
    head = named.groupBy("file", "block").agg(F.min(F.struct(rank.alias("rank"), "language", "line_no", "i", "name")).alias("h"))
    start = rows.groupBy("file", "block").agg(F.min("line_no").alias("line"))
    keyed = cut_lineage(head.select(
        "file", "block", taxonomy_key(F.col("h.language"), F.col("h.name")).alias("key")).join(start, ["file", "block"]), "taxonomy-keyed")
    first = keyed.groupBy("key").agg(F.min(F.struct("file", "line")).alias("f"))
    position = F.struct("file", "line_no", "i")
    with_key = lambda kind: rows.where(F.col("kind") == kind).join(keyed.select("file", "block", "key"), ["file", "block"])
    blocks = keyed.join(first, "key").select(
        "key", "file", "line", ((F.col("file") != F.col("f.file")) | (F.col("line") != F.col("f.line"))).alias("repeat"))
    return {
        "entries": first.select("key", F.col("f.line").alias("line")),
        "names": named.join(keyed.select("file", "block", "key"), ["file", "block"]).groupBy("key", "language", "name").agg(
            F.min(position).alias("position")),
        "parents": with_key("parent").select("key", "language", F.col("value").alias("name")).distinct(),
        "properties": with_key("property").select("key", "property", "language", "value").distinct(),
        "duplicate_blocks": blocks.where("repeat").select("key", "line"),
        "ignored_directives": rows.where("kind = 'directive'").select("line_no", "line"),
        "empty_names": rows.where("kind = 'names'").where(F.size(escaped_names(F.col("value"))) == 0).select("line_no", "line"),
        "unparsed_lines": rows.where("kind = 'unparsed'").select("line_no", "line"),
    }


def first_names(names: DataFrame, language: str, out: str) -> DataFrame:
    return names.where(F.col("language") == language).groupBy("key").agg(F.min_by("name", "position").alias(out))


def property_conflicts(properties: DataFrame) -> DataFrame:
    """Values of properties that have more than one value per entry and language, long."""
    many = properties.groupBy("key", "property", "language").agg(F.count(F.lit(1)).alias("values")).where("values > 1")
    return properties.join(many.drop("values"), ["key", "property", "language"], "left_semi")
