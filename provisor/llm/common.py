"""Building blocks of the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from provisor.session import bound_batches, cut_lineage, scratch, ship

_SLOTS = 1 << 25


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with the package at hand on every worker and batches of bounded size.

    The session's own limit stays if it is smaller.
    """
    spark = df.sparkSession
    ship(spark)
    bound_batches(spark)
    return df.mapInArrow(function, schema)


def shielded(docs: DataFrame, *own: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with all columns but ``own`` named by their place, so that no name of theirs clashes, and the former names."""
    return docs.toDF(*[c if c in own else f"c{i}" for i, c in enumerate(docs.columns)]), docs.columns


#: Packed tables of counters that one task adds up.
FAN_IN = 128


def summed(told: DataFrame, key: str) -> DataFrame:
    """(key, counts) from ``told(key, part, counts)``: packed 64-bit counters of every task, added up.

    ``part`` is the task's number. Tables are added ``FAN_IN`` at a time, so no task gathers
    those of all others.
    """
    ship(told.sparkSession)
    parts = told.rdd.getNumPartitions()
    while True:
        told = told.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy(key, "part").applyInArrow(
            _added, f"{key} int, part int, counts binary")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return told.select(key, "counts")


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column(2))
    return pa.Table.from_arrays([*(table.column(c)[:1] for c in (0, 1)), pa.array([total.tobytes()], pa.binary())], table.column_names)


def key_bits(keys: DataFrame, key: str, turn: int = 0) -> DataFrame:
    """A bitmap of hashed keys: at most 1,024 rows of 4 KB, whatever the number of keys."""
    slot = F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(_SLOTS))
    return keys.select(slot.alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))


def maybe_in(df: DataFrame, key: Column, bits: DataFrame, flag: str, turn: int = 0) -> DataFrame:
    """``df`` with a boolean: false only for keys that are surely not in the bitmap.

    The bitmap has a fixed size (4 MB), so it may be broadcast. When more keys than slots come,
    it only filters less. Another ``turn`` hashes anew.
    """
    slot = F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(_SLOTS))
    place = F.bitmap_bit_position(slot)
    byte = F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))
    number = F.when(F.bitmap_count(byte) > 0, F.conv(F.hex(byte), 16, 10).cast("int"))
    return (
        df.withColumn("_bucket", F.bitmap_bucket_number(slot))
        .join(F.broadcast(bits), "_bucket", "left")
        .withColumn(flag, F.coalesce(F.getbit(number, (place % 8).cast("int")) == 1, F.lit(False)))
        .drop("_bucket", "_bits")
    )


def beside(pairs: DataFrame, table: DataFrame, key: str, *columns: str) -> DataFrame:
    """``pairs(a, b)`` with columns of both sides; only rows of ``table`` that may be asked for move."""
    bits = key_bits(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    few = maybe_in(table, F.col(key), bits, "_maybe").where("_maybe")
    for side in "ab":
        pairs = pairs.join(few.select(F.col(key).alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs.select("a", "b", *[f"{c}_{side}" for c in columns for side in "ab"])


def surely_few(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys``, and about one in ten thousand others.

    For ``keys`` that are a written table: two bitmaps, the second one on what the first lets by.
    """
    for turn in (0, 1):
        df = maybe_in(df, F.col(key), key_bits(keys, key, turn), "_maybe", turn).where("_maybe").drop("_maybe")
    return df


def semi_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys``; most others leave before the shuffle."""
    few = maybe_in(df, F.col(key), key_bits(keys, key), "_maybe").where("_maybe").drop("_maybe")
    return few.join(keys.select(key), key, "left_semi")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node that has a smaller neighbour has only one, which has none itself."""
    sides = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = sides.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of an edge, ``edges(a, b)``; root is the component's smallest id.

    Union-find by alternating stars: every larger neighbour of a node is tied to the smallest
    node around it, then every smaller one. Only minima are aggregated, so a hub with millions
    of neighbours is combined on the map side. Each round is a written table. A root is listed
    as its own node.
    """
    now = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(now):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(
            low.select("a", F.col("m").alias("b"))).distinct()
        now = cut_lineage(small, "edges")
    tied = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return tied.unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


#: By how much more ids of a bucket meet all its others in each later round.
GROWTH = 8
#: Such rounds, before all ids outside a bucket's largest component meet all its others.
ROUNDS = 2
#: 64-bit words of a set's marks.
MARKS = 32


def prefix_sizes(n: Column, percent: int) -> tuple[Column, Column]:
    """How many of a set's n grams, in a common order, must hold one that a linked set shares.

    The first number is for a partner that is not smaller, the second for any partner.
    """
    inner = n - F.ceil(2 * percent * n / (100 + percent)) + 1
    return inner.cast("long"), (n - F.ceil(percent * n / 100) + 1).cast("long")


def marks(hashes: DataFrame) -> DataFrame:
    """``hashes(id, x)`` -> id, ``b0`` to ``b31`` and ``ones``: each member of a set flags one of 2,048 bits."""
    word, bit = F.shiftrightunsigned("x", 6).bitwiseAND(F.lit(MARKS - 1)), F.col("x").bitwiseAND(F.lit(63)).cast("int")
    words = hashes.groupBy("id", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    return words.groupBy("id").agg(
        *[F.coalesce(F.max(F.when(F.col("word") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"b{k}") for k in range(MARKS)],
        F.sum(F.bit_count("bits")).alias("ones"))


def may_link(n: Column, ones: Column, bits: list[Column], n_: Column, ones_: Column, bits_: list[Column], percent: int) -> Column:
    """Whether the marks of two sets allow their Jaccard similarity; never false for a linked pair.

    Every bit that only one set has stands for at least one member that the other lacks.
    """
    both = sum((F.bit_count(x.bitwiseAND(y)) for x, y in zip(bits, bits_)), F.lit(0))
    return (100 + percent) * (F.least(n - ones, n_ - ones_) + both) >= percent * (n + n_)


def link_groups(rows: DataFrame, test, percent: int, rest=None, marked=None) -> DataFrame:
    """(id, root) of the components of all linked pairs that share a bucket.

    ``rows(bucket, id, n, inner, rank)``: sets of size ``n`` and the grams that start them;
    ``inner`` marks those of the shorter start (see ``prefix_sizes``). ``test(pairs(a, b))``
    gets a written table and returns the pairs that are linked. In the first round the id of
    lowest ``rank`` of each bucket meets the bucket's other ids. An id that has met all others of
    its bucket leaves it, and a bucket ends when all its ids are in one component. What is open
    then goes to ``rest`` at once, where it is given; it returns candidate pairs. Without it, later
    rounds have ``GROWTH`` times as many leaders each, whatever the bucket's size. There, ids of
    different components meet whose marks allow a link; ``marked(ids)`` gives those (see ``marks``)
    for the ids that are still open. So a family costs a few tests per member before it is one
    component; then the ids outside a bucket's largest component meet all of it, which ends the
    bucket. Of these meetings only those that ``may_link`` are written, and no pair that sizes,
    starts and marks allow goes untested.

    Ids are not null and (bucket, id) is unique; rows of one bucket alone give nothing.
    """
    own = ["bucket", "id", "n", "inner", "rank"]
    rows, met = rows.select(*own, F.col("id").alias("root")), F.lit(True)
    links, roots, done = None, None, 0
    while True:
        with scratch(rows.sparkSession) as step:
            if done == 0:
                lead = rows.groupBy("bucket").agg(F.min(F.struct("rank", "id", "n", "inner", "root")).alias("lead"))
                others = rows.join(lead, "bucket")
                left = others.where("id <> lead.id")
            else:
                held = cut_lineage(rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("_m")), "held")
                size = held.groupBy("bucket").agg(F.sum("_m").alias("_n"), F.max_by("root", F.struct("_m", "root")).alias("_largest"))
                # An id leads with a probability that its own hash decides; the lowest hash leads in any case.
                turn = F.pmod(F.xxhash64("id", F.lit(done)), F.lit(1 << 30))
                dealt = rows.withColumn("_turn", turn).join(size.join(rows.groupBy("bucket").agg(F.min(turn).alias("_first")), "bucket"), "bucket")
                chosen = (F.col("_turn") * F.col("_n") < F.lit(GROWTH ** (done - 1) << 30)) | (F.col("_turn") == F.col("_first"))
                if done > ROUNDS:
                    chosen = F.col("root") != F.col("_largest")
                dealt = cut_lineage(dealt.select(*own, "root", chosen.alias("chosen")), "dealt")
                lead = dealt.where("chosen").select("bucket", F.struct(*own[1:], "root").alias("lead"))
                others = dealt.join(lead, "bucket")
                left = dealt.where("not chosen" if done <= ROUNDS else "false")
            sized = (100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")) & F.when(
                F.col("n") < F.col("lead.n"), F.col("inner")).when(F.col("n") > F.col("lead.n"), F.col("lead.inner")).otherwise(
                F.col("inner") | F.col("lead.inner"))
            pairs = cut_lineage(others.where(sized & (F.col("root") != F.col("lead.root")) & met).select(
                F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct(), "pairs")
            found = step.keep(test(pairs).select("a", "b"), "links")
            links = found if links is None else links.unionAll(found)
            if roots is None or not found.isEmpty():
                roots = step.keep(components(links), "roots")
            left = left.select(*own).join(roots, "id", "left").select(*own, F.coalesce("root", "id").alias("root"))
            open_ = left.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
            rows = step.keep(left.join(open_, "bucket", "left_semi"), "open")
        done += 1
        if rows.isEmpty():
            return roots
        if rest is not None:
            found = cut_lineage(test(cut_lineage(rest(rows), "pairs")).select("a", "b"), "links")
            return components(links.unionAll(found))
        if marked is not None and done == 1:
            rows = cut_lineage(rows.join(marked(rows.select("id").distinct()), "id"), "open-marks")
            words = [f"b{k}" for k in range(MARKS)]
            own += ["ones", *words]
            met = may_link(F.col("n"), F.col("ones"), [F.col(c) for c in words], F.col("lead.n"), F.col("lead.ones"),
                           [F.col(f"lead.{c}") for c in words], percent)
