"""Removal of lines that repeat another line, exactly or nearly; DataFrame operations only.

A line's set holds the ``GRAM`` characters that begin at each of its places; a shorter line is its
own only member. One hash deals a shingle to one of ``BINS`` bins, which keep their minima under
three orders; an empty bin takes those of the next one. A half signature joins a minimum of three
bins, each in another order. Eight groups have three half signatures each, and any two of a group
make a band: in simulation, two lines with similarity 0.8 meet in one of the 24 bands with
probability 0.998 from fifty shingles on, 0.99 with twenty and 0.96 with ten, and with 0.9 always.
Lines that meet are verified on their sets and united by union-find. The first line of a component,
in order of doc_id and line number, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provisor.llm.common import beside, key_bits, link_groups, marks, maybe_in, semi_join, shielded, surely_few
from provisor.session import cut_lineage, scratch

#: Characters of a shingle, and bytes of a character where all have the same length.
GRAM, WIDTH = 5, 4
#: Compressed bytes of lines that one task cuts into shingles, about: each of its lines has up to 24 rows in a hash table.
LINE_BYTES = 2 << 20
#: Groups of half signatures, half signatures of a group, and bins: one for each half signature.
GROUPS, HALVES = 8, 3
BINS = GROUPS * HALVES


def _wide(line: Column) -> Column:
    """A line as bytes in which each place is found at once, however long the line is."""
    return F.encode(line, "UTF-32")


def _places(wide: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(wide) - WIDTH * GRAM), F.lit(WIDTH))


def _gram(wide: Column, place: Column) -> Column:
    return F.xxhash64(F.substring(wide, place + 1, F.lit(WIDTH * GRAM)))


def grams(line: Column) -> Column:
    """Hashes of all character shingles of a line, repeats included."""
    return F.flatten(F.transform(F.array(_wide(line)), lambda w: F.transform(_places(w), lambda i: _gram(w, i))))


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line and its hash ``lid``; lines of white space only are left out."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(
        F.col("line").rlike(r"\S")).withColumn("lid", F.xxhash64("line"))


def _halves(lines: DataFrame) -> DataFrame:
    """lid -> its half signatures. Lines meet by their hash first, so equal ones are read once and no minima are moved."""
    wide = lines.groupBy("lid").agg(F.first("line").alias("line")).select("lid", _wide(F.col("line")).alias("wide"))
    places = wide.select("lid", "wide", F.explode(_places(F.col("wide"))).alias("i"))
    hashes = places.select("lid", _gram(F.col("wide"), F.col("i")).alias("x"))
    bin_ = F.pmod(F.shiftrightunsigned("x", 40), F.lit(BINS)).cast("int")
    lows = hashes.groupBy("lid", bin_.alias("bin")).agg(
        F.min("x").alias("m0"), *[F.min(F.xxhash64("x", F.lit(k))).alias(f"m{k}") for k in (1, 2)])
    # One column per bin and order: numbers only, so a line costs 600 bytes of a hash table and no objects.
    full = lows.groupBy("lid").agg(*[F.max(F.when(F.col("bin") == b, F.col(f"m{k}"))).alias(f"m{k}_{b}") for k in range(3) for b in range(BINS)])

    def low(b, k):
        return F.coalesce(*[f"m{k}_{(b + step) % BINS}" for step in range(BINS)])

    return full.select("lid", F.array(*[F.hash(*[low(h + BINS * k // 3, k) for k in range(3)]) for h in range(BINS)]).alias("halves"))


def _bands(halves: Column) -> Column:
    """The hashes of the bands: two half signatures of one group."""
    return F.array(*[F.xxhash64(F.lit(g * HALVES * HALVES + x * HALVES + y), halves[g * HALVES + x], halves[g * HALVES + y])
                     for g in range(GROUPS) for x in range(HALVES) for y in range(x + 1, HALVES)])


def similar_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(id, root): line hashes of each component of two or more different lines."""
    with scratch(docs.sparkSession) as own:
        lines = split_lines(docs).select("lid", "line")
        with scratch(docs.sparkSession, LINE_BYTES) as start:
            bands = cut_lineage(_halves(lines), "halves").select("lid", F.explode(_bands(F.col("halves"))).alias("bucket"))
            shared = cut_lineage(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "shared")
            met = start.keep(surely_few(bands, "bucket", shared).join(shared, "bucket"), "met")
        # The line that others were copied from comes first: its bands are the most widely shared.
        ranks = cut_lineage(met.groupBy("lid").agg((-F.sum("sets")).cast("double").alias("rank")), "ranks")
        texts = semi_join(lines, ranks, "lid").groupBy("lid").agg(F.first("line").alias("line"))
        texts = cut_lineage(texts.select("lid", "line", F.size(F.array_distinct(grams(F.col("line")))).cast("long").alias("n")), "line-texts")
        sized = ranks.join(texts.select("lid", "n"), "lid")
        rows = met.select("bucket", "lid").join(sized, "lid").select("bucket", F.col("lid").alias("id"), "n", F.lit(True).alias("inner"), "rank")

        def test(pairs):
            both = F.size(F.array_intersect(grams(F.col("line_a")), grams(F.col("line_b")))).cast("long")
            return beside(pairs, texts, "lid", "line", "n").where((100 + percent) * both >= percent * (F.col("n_a") + F.col("n_b")))

        def marked(ids):
            open_ = semi_join(texts, ids.withColumnRenamed("id", "lid"), "lid")
            return marks(open_.select(F.col("lid").alias("id"), F.explode(F.array_distinct(grams(F.col("line")))).alias("x")))

        return own.keep(link_groups(cut_lineage(rows, "starts"), test, percent, marked=marked), "similar-lines")


def repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_lines (with text) and ``removed``, the ascending numbers of the lines to remove.

    Every doc_id of ``docs(doc_id, text)`` has a row unless its text is null or has no line with
    text. Lines without text are never removed. Rows with one doc_id count as one document whose
    equally numbered lines are told apart by their text. A null doc_id comes first.
    """
    docs = docs.select("doc_id", "text").where("text is not null")
    places = cut_lineage(split_lines(docs).select("doc_id", "line_no", "lid"), "lines")
    roots = similar_lines(docs, percent)
    rooted = places.join(roots, places["lid"] == roots["id"], "left").select(
        "doc_id", "line_no", "lid", F.coalesce("root", "lid").alias("root"))
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "line_no", "lid")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    judged = rooted.join(first, "root", "left").withColumn(
        "gone", F.col("first").isNotNull() & ~F.struct("doc_id", "line_no", "lid").eqNullSafe(F.col("first")))
    return judged.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_set(F.when(F.col("gone"), F.col("line_no")))).alias("removed"))


def remove_repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with their columns, without repeated lines; ``n_chars``, where present, follows.

    Every row stays, also when no line is left. Only documents that lose a line are moved.
    Other columns may have any names. See ``repeated_lines``.
    """
    docs, names = shielded(docs, "doc_id", "text", "n_chars")
    with scratch(docs.sparkSession) as own:
        lost = own.keep(repeated_lines(docs, percent).where("size(removed) > 0").select(
            F.col("doc_id").alias("_id"), F.col("removed").alias("_removed")), "removed-lines")
    marked = maybe_in(docs, F.col("doc_id"), key_bits(lost, "_id"), "_maybe")
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    touched = marked.where("_maybe").select(*others, F.split("text", "\n").alias("_lines"))
    touched = touched.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_removed", F.array().cast("array<int>")))
    touched = touched.withColumn("text", F.array_join(F.transform(kept, lambda i: F.element_at("_lines", i + 1)), "\n"))
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return touched.select(*docs.columns).unionAll(marked.where("not _maybe").select(*docs.columns)).toDF(*names)
