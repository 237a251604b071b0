"""Merkle manifest of a table: a tree per source, a tree over the sources, and a proof of every row.

Three nodes that follow one another become their hash, level by level, until one is left. The
leaves are ranked by a range sort, so a run of 81 leaves is one group and four levels of it are
hashed at once. Every node below the root then holds a pointer to its parent and the siblings that
its hash needs. Pointer jumping doubles the distance: a node takes over its ancestor's pointer and
appends the ancestor's siblings to its own, by a self-join of the pointer table, until all leaves
point at the root. Nodes that no later round asks for are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from provisor.session import cut_lineage

#: Nodes of a run, and levels that one job hashes.
FAN, STEP = 3, 4
#: Bytes of the ancestors' side of a round, by its proven number of nodes, up to which it is broadcast.
BROADCAST_BYTES = 8 << 20
#: The tree over the sources.
TOP = -1


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _ranked(rows: DataFrame, order: list[Column], purpose: str) -> DataFrame:
    """``rows`` in ranges of ``order``; ``_at`` ascends along it, with the range's number above bit 33."""
    return cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), purpose)


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k).cast("long") for k in range(40)]), lambda x: x < n)).cast("long")


def _up(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), ""), 256))


def _blocks(nodes: DataFrame, base: int) -> DataFrame:
    """Runs of ``FAN ** STEP`` nodes of level ``base`` with the levels above them, ``a0`` to ``a<STEP>``."""
    kids = F.sort_array(F.collect_list(F.struct("idx", "hash", "doc_id", "other")))
    out = nodes.groupBy("sid", "height", F.expr(f"idx div {FAN ** STEP}").alias("block")).agg(kids.alias("kids"))
    out = out.withColumn("a0", F.transform("kids", lambda k: k["hash"]))
    for j in range(STEP):
        out = out.withColumn(f"a{j + 1}", F.when(F.col("height") > base + j, _up(F.col(f"a{j}"))))
    return cut_lineage(out, f"tree-{base}")


def _pointers(blocks: DataFrame, base: int) -> DataFrame:
    """One row per node below its tree's top: its parent and the siblings left and right of it."""

    def level(j: int) -> Column:
        nodes, first = F.col(f"a{j}"), F.col("block") * FAN ** (STEP - j)

        def one(x, i):
            at, leaf = i % FAN, base + j == 0
            kid = F.element_at("kids", i + 1)
            none = F.lit(None)
            return F.struct(
                F.lit(base + j).cast("long").alias("level"), (first + i).alias("idx"), F.floor((first + i) / FAN).cast("long").alias("up_idx"),
                F.unhex(F.array_join(F.slice(nodes, i - at + 1, at), "")).alias("left"),
                F.unhex(F.array_join(F.slice(nodes, i + 2, F.lit(FAN - 1) - at), "")).alias("right"),
                (x if leaf else none.cast("string")).alias("leaf"), (kid["doc_id"] if leaf else none.cast("long")).alias("doc_id"),
                (kid["other"] if leaf else none.cast("string")).alias("other"))

        return F.when(F.col("height") > base + j, F.transform(nodes, one))

    told = F.filter(F.array(*[level(j) for j in range(STEP)]), lambda a: a.isNotNull())
    return blocks.select("sid", "height", F.explode(F.flatten(told)).alias("p")).select("sid", "height", "p.*")


def _tree(nodes: DataFrame, highest: int) -> tuple[DataFrame | None, DataFrame]:
    """Pointers inside trees of ``nodes(sid, height, idx, hash, doc_id, other)``, and (sid, hash) of their tops."""
    tops = nodes.where("height = 0").select("sid", "hash")
    pointers = None
    for base in range(0, highest, STEP):
        blocks = _blocks(nodes.where(F.col("height") > base), base)
        told = _pointers(blocks, base)
        pointers = told if pointers is None else pointers.unionAll(told)
        ready = F.col("height").between(base + 1, base + STEP)
        top = F.element_at(F.array(*[F.element_at(f"a{j}", 1) for j in range(1, STEP + 1)]), (F.col("height") - base).cast("int"))
        tops = tops.unionAll(blocks.where(ready).select("sid", top.alias("hash")))
        nodes = blocks.where(F.col("height") > base + STEP).select(
            "sid", "height", F.col("block").alias("idx"), F.element_at(f"a{STEP}", 1).alias("hash"), F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("string").alias("other"))
    return pointers, tops


@dataclass
class Manifest:
    """``sources`` (source, leaves, subroot), the ``root``, and ``proofs``: every row with its way to the root."""

    sources: DataFrame
    root: str | None
    proofs: DataFrame


PROOFS = "doc_id long, leaf string, other string, height long, steps array<struct<left: binary, right: binary>>"


def manifest(leaves: DataFrame) -> Manifest:
    """Trees over ``leaves(source, doc_id, leaf, other)``; ``other`` is a further digest that is carried along.

    Leaves of a source ascend by doc_id, null first; equal ids ascend by leaf. Sources ascend by
    their UTF-8 bytes, null first. Rows that are there twice are two leaves. ``steps`` hold the
    siblings left and right of the way as raw digests, lowest level first; the first ``height`` of
    them lead to the source's subroot. No rows give no root. Only counts, the greatest height and
    the root reach the driver.
    """
    spark = leaves.sparkSession
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("_row").asc()]
    placed = _ranked(leaves.select("source", F.col("doc_id").cast("long").alias("doc_id"), "leaf", "other").withColumn(
        "_row", F.monotonically_increasing_id()), order, "leaves").withColumn("part", F.shiftright("_at", 33))
    runs = cut_lineage(placed.groupBy("source", "part").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")), "runs")
    sizes = runs.groupBy("source").agg(F.sum("n").alias("leaves"))
    named = _ranked(sizes, [F.col("source").asc_nulls_first()], "sources").withColumn("part", F.shiftright("_at", 33))
    starts = named.groupBy("part").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = starts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sources = cut_lineage(named.join(starts, "part").select(
        "source", "leaves", (F.col("_at") - F.col("first") + F.col("offset")).alias("sid"), _height(F.col("leaves")).alias("height")), "numbered")
    n_sources, n_leaves, highest = sources.agg(F.count(F.lit(1)), F.sum("leaves"), F.max("height")).first()
    if not n_sources:
        return Manifest(spark.createDataFrame([], "source string, leaves long, subroot string"), None, spark.createDataFrame([], PROOFS))
    above = max(k for k in range(41) if k == 0 or FAN ** (k - 1) < n_sources)

    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).join(
        sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"), F.col("part").alias("_part"), "first", "offset", "sid", "height")
    # A run is the part of a source in one range, so a large source is many keys here.
    nodes = placed.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part"))).select(
        "sid", "height", (F.col("_at") - F.col("first") + F.col("offset")).alias("idx"), F.col("leaf").alias("hash"), "doc_id", "other")
    pointers, tops = _tree(nodes, highest)
    tops = cut_lineage(tops, "subroots")
    over = tops.select(F.lit(TOP).cast("long").alias("sid"), F.lit(above).cast("long").alias("height"), F.col("sid").alias("idx"), "hash",
                       F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("other"))
    links, peak = _tree(over, above)
    root = peak.first()["hash"]

    own = ["sid", "level", "idx", "up_sid", "up_level", "up_idx", "left", "right", "doc_id", "leaf", "other", "height"]
    told = []
    if pointers is not None:
        told.append(pointers.withColumn("up_sid", F.col("sid")).withColumn("up_level", F.col("level") + 1).select(*own))
    alone = nodes.where("height = 0").select("sid", F.col("hash").alias("leaf"), "doc_id", "other")
    if links is not None:
        links = cut_lineage(links, "links")
        up = [F.lit(TOP).cast("long").alias("up_sid"), (F.col("level") + 1).alias("up_level"), "up_idx", "left", "right"]
        told.append(links.where("level > 0").select("sid", "level", "idx", *up, "doc_id", "leaf", "other", "height"))
        # A source's top is a leaf of the tree over the sources, and goes by its place in its own tree.
        first = links.where("level = 0").select(F.col("idx").alias("sid"), *up)
        first = first.join(sources.select("sid", F.col("height").alias("level"), "height"), "sid").join(alone, "sid", "left")
        told.append(first.withColumn("idx", F.lit(0).cast("long")).select(*own))
    listed = sources.join(tops, "sid").select("source", "leaves", F.col("hash").alias("subroot"))
    if not told:
        return Manifest(listed, root, alone.select("doc_id", "leaf", "other", F.lit(0).cast("long").alias("height"), F.expr(
            "cast(array() as array<struct<left: binary, right: binary>>)").alias("steps")))
    every = told[0]
    for more in told[1:]:
        every = every.unionAll(more)
    last = (TOP, above) if above else (0, highest)
    arrived = lambda sid, level: (F.col(sid) == last[0]) & (F.col(level) == last[1])
    now = every.withColumn("steps", F.array(F.struct("left", "right"))).withColumn("done", arrived("up_sid", "up_level")).drop("left", "right")
    now, step, depth = cut_lineage(now, "pointers-1"), 1, highest + above
    while step < depth:
        wide = 2 * step
        asking = F.col("leaf").isNotNull() if wide >= depth else (F.col("sid") == TOP) | (F.col("level") % wide == 0)
        left = now.where(asking)
        right = now.where((F.col("sid") == TOP) | ((F.col("level") % step == 0) & (F.col("level") > 0))).select(
            F.col("sid").alias("up_sid"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), F.col("up_sid").alias("to_sid"),
            F.col("up_level").alias("to_level"), F.col("up_idx").alias("to_idx"), F.col("steps").alias("more"), F.col("done").alias("there"))
        most = 2 * (n_leaves // FAN**step) + (highest + 4) * n_sources
        right = F.broadcast(right) if most * (120 + 100 * step) <= BROADCAST_BYTES else right
        jumped = left.where("not done").join(right, ["up_sid", "up_level", "up_idx"]).select(
            "sid", "level", "idx", F.col("to_sid").alias("up_sid"), F.col("to_level").alias("up_level"), F.col("to_idx").alias("up_idx"),
            "doc_id", "leaf", "other", "height", F.concat("steps", "more").alias("steps"), F.col("there").alias("done"))
        now, step = cut_lineage(jumped.unionAll(left.where("done").select(*jumped.columns)), f"pointers-{wide}"), wide
    return Manifest(listed, root, now.where("leaf is not null").select("doc_id", "leaf", "other", "height", "steps"))


def fold(leaf: Column, steps: Column) -> Column:
    """The digest that a leaf and its siblings lead to."""
    text = lambda raw: F.lower(F.hex(raw))
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(text(s["left"]), h, text(s["right"])), 256))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Every row of ``docs(doc_id, source, lang, n_chars, text)`` as a leaf, with its proof checked.

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified. Where 2 divides
    the CRC-32 of the decimal doc_id, the text is read without its newlines, as a tampered one;
    folding that leaf with the original siblings gives folded_root. A null doc_id is read as it
    is, and so is a null text. Each row stays, repeated ones too (see ``manifest`` for their
    order); no rows give no rows. Other columns are ignored.
    """
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = docs.select("source", "doc_id", row_digest(*rest, F.col("text")).alias("leaf"), F.when(
        hit & F.contains("text", F.lit("\n")), row_digest(*rest, F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("other"))
    made = manifest(leaves)
    siblings = F.array_join(F.transform("steps", lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), "")
    way = made.proofs.select(
        "doc_id", "leaf", "other", "steps", "height", F.lit(made.root).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.col("leaf"), F.slice("steps", F.lit(1), F.col("height").cast("int"))).alias("subroot"))
    above = F.slice("steps", F.col("height").cast("int") + 1, F.size("steps"))
    folded = F.when(F.col("other").isNull(), fold(F.col("subroot"), above)).otherwise(fold(F.col("other"), F.col("steps")))
    return way.withColumn("folded_root", folded).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
