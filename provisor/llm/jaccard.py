"""Exact join of documents whose word n-gram sets have a Jaccard similarity of at least a threshold.

* Documents with equal sets form a class, which goes on as one set named by its 64-bit digest.
* Two linked sets share a gram among the first ``n - ceil(t n) + 1`` of each, whatever the common
  order of grams. Frequent grams go last, so passages that many documents share rarely start a
  bucket. Frequencies come from a table of 2**20 counters over all documents; it only steers the
  order, never the result.
* Grams are hashed into ``GROUPS`` groups, or multiples of it for large sets. The group counts of a document are a point; the sum of
  coordinate minima bounds the overlap of two sets. Inside a bucket that stars of tests leave
  open, points are packed into R-trees, whole nodes are left out by the bound on their upper
  corners, and the surviving pairs are verified on the full sets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from provisor.llm import words as W
from provisor.llm.common import arrow_map, beside, components, key_bits, link_groups, maybe_in, prefix_sizes, semi_join, summed, surely_few
from provisor.session import cut_lineage, scratch, ship

#: Groups of the smallest sets and of the trees; counters of gram frequencies and how they are dealt.
GROUPS, COUNTERS, SLICE = 256, 1 << 20, 1 << 16
#: Points of a tree, of a leaf, and of the queries that meet a tree together; rows that one call of the R-tree join takes, about.
BLOCK, LEAF, QUERIES, ROWS = 512, 16, 8_192, 20_000


def _count(k: int, lower: bool):
    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, hashes, first in W.doc_words(batch.column(0), lower):
                grams, _ = W.shingle_hashes(hashes, first, k)
                total += np.bincount((grams >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        slices = COUNTERS // SLICE
        yield pa.RecordBatch.from_arrays([
            pa.array(range(slices), pa.int32()), pa.array([TaskContext.get().partitionId()] * slices, pa.int32()),
            pa.array([total[i:i + SLICE].tobytes() for i in range(0, COUNTERS, SLICE)], pa.binary())], ["slice", "part", "counts"])

    return run


def frequent(docs: DataFrame, k: int, lower: bool) -> np.ndarray:
    """Flags of the counters that stand out from what evenly spread rare grams would give."""
    told = arrow_map(docs.select("text"), _count(k, lower), "slice int, part int, counts binary")
    rows = summed(told, "slice").collect()  # 8 MB, whatever the input
    total = np.zeros(COUNTERS, np.int64)
    for r in rows:
        total[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    usual = float(np.median(total))
    return total > usual + 8 * usual**0.5 + 16


def _digest(grams: np.ndarray) -> int:
    """64 bits that name a set of hashes: its members under two mixings, added up."""
    total = np.array([grams.sum(dtype=np.uint64)]) * W._P + W.mixed(grams ^ W._K1).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(W.mixed(total).view(np.int64)[0])


def _point(grams: np.ndarray) -> bytes:
    """Group counts of a set; large sets have four times as many groups.

    The first byte holds the binary logarithm of the number; a count takes one byte, or four
    where one doesn't fit. Most counts are small, so the whole is deflated.
    """
    bits = 8 + 2 * (len(grams) >= 4000)
    counts = np.bincount((grams & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return zlib.compress(bytes([bits]) + counts.astype("u1" if counts.max() < 256 else "<u4").tobytes(), 6)


def _plain(point: bytes) -> bytes:
    return zlib.decompress(point) if point[:1] == b"\x78" else point


def _unpacked(point: bytes, groups: int | None = None) -> np.ndarray:
    """Group counts, added up to fewer groups where asked for."""
    point = _plain(point)
    counts = np.frombuffer(point, "u1" if len(point) - 1 == 1 << point[0] else "<u4", offset=1).astype(np.int64)
    return counts if groups is None else counts.reshape(-1, groups).sum(0)


def _points(column) -> np.ndarray:
    return np.array([_unpacked(x, GROUPS) for x in column.to_pylist()], np.int64).reshape(-1, GROUPS)


def _sets(k: int, lower: bool, percent: int, often):
    """text -> n, class digest, group counts and the grams that start buckets."""

    def run(batches):
        for batch in batches:
            late = often.value
            for i, j, hashes, first in W.doc_words(batch.column(1), lower):
                grams, where = W.shingle_hashes(hashes, first, k)
                n, digest, points, heads = [], [], [], []
                for d in range(j - i):
                    own = np.unique(grams[where[d]:where[d + 1]])
                    n.append(len(own))
                    digest.append(_digest(own))
                    points.append(_point(own))
                    size = len(own) - (percent * len(own) + 99) // 100 + 1 if len(own) else 0
                    flag = late[(own >> np.uint64(44)).astype(np.int64)]
                    rare = own[~flag]
                    heads.append(rare[:size] if len(rare) >= size else np.concatenate([rare, own[flag][:size - len(rare)]]))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(digest, pa.int64()), pa.array(points, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, heads)]), pa.int32()), pa.array(np.concatenate(heads).view(np.int64) if heads else [], pa.int64()))],
                    ["doc_id", "n", "id", "point", "heads"])

    return run


def _own_text(k: int, lower: bool):
    """(id, text) rows whose text has the set that the id names."""

    def run(batches):
        for batch in batches:
            ok = []
            for i, j, hashes, first in W.doc_words(batch.column(1), lower):
                grams, where = W.shingle_hashes(hashes, first, k)
                ok += [_digest(np.unique(grams[where[d]:where[d + 1]])) for d in range(j - i)]
            yield batch.filter(pa.array(np.array(ok, np.int64) == batch.column(0).to_numpy()))

    return run


def _need(na, nb, percent: int):
    """Least overlap of two linked sets: 100 i >= percent (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


def _bound(percent: int):
    """(a, b, na, nb, pa, pb) -> pairs whose summed coordinate minima allow the overlap."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = []
            for x, y in zip(map(_plain, batch.column(4).to_pylist()), map(_plain, batch.column(5).to_pylist())):
                groups = 1 << min(x[0], y[0])
                most.append(np.minimum(_unpacked(x, groups), _unpacked(y, groups)).sum())
            yield batch.select(["a", "b"]).filter(pa.array(np.array(most, np.int64) >= _need(na, nb, percent)))

    return run


def _verify(k: int, lower: bool, percent: int):
    """(a, b, text of a, text of b) -> pairs whose sets are similar enough."""

    def sets(column):
        for i, j, hashes, first in W.doc_words(column, lower):
            grams, where = W.shingle_hashes(hashes, first, k)
            for d in range(j - i):
                yield np.unique(grams[where[d]:where[d + 1]])

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def tree(points: np.ndarray, size: np.ndarray):
    """R-tree of a block: point order, and per node its first and last point, upper corner and least size.

    Points are packed by size and then by their largest coordinate; a node is entered only if the
    sum of minima of its upper corner and the query reaches the least overlap.
    """
    order = np.lexsort((points.argmax(1), size // np.maximum(1, size.max() // 8)))
    starts = np.arange(0, len(order), LEAF)
    corner = np.maximum.reduceat(points[order], starts, axis=0)
    least = np.minimum.reduceat(size[order], starts)
    levels = [(starts, corner, least)]
    while len(levels[-1][0]) > LEAF:
        s, c, m = levels[-1]
        up = np.arange(0, len(s), LEAF)
        levels.append((up, np.maximum.reduceat(c, up, axis=0), np.minimum.reduceat(m, up)))
    return order, levels[::-1]


def search(order, levels, points, size, query, n: int, percent: int) -> np.ndarray:
    """Indices of the points that may have the overlap with one query point."""
    at = np.arange(len(levels[0][0]))
    for depth, (starts, corner, least) in enumerate(levels):
        ok = np.minimum(corner[at], query).sum(1) >= _need(n, least[at], percent)
        at = at[ok]
        if depth + 1 < len(levels):
            wide = len(levels[depth + 1][0])
            at = (starts[at][:, None] + np.arange(LEAF)).ravel()
            at = at[at < wide]
    one = (levels[-1][0][at][:, None] + np.arange(LEAF)).ravel()
    one = order[one[one < len(order)]]
    return one[np.minimum(points[one], query).sum(1) >= _need(n, size[one], percent)]


def _tree_join(percent: int):
    """Rows of whole (bucket, block, part) sets -> candidate pairs of different components.

    Points of side 0 form a set's tree, those of side 1 are its queries.
    """

    def run(table: pa.Table) -> pa.Table:
        names = [table.column(c).to_numpy() for c in ("side", "part", "block", "bucket")]
        order = np.lexsort(names)
        side, *name = (x[order] for x in names)
        ids, roots, size = (table.column(c).to_numpy()[order] for c in ("id", "root", "n"))
        inner, points = table.column("inner").to_numpy(zero_copy_only=False)[order], _points(table.column("point"))[order]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in name], axis=0)) + 1
        low, high = [], []
        for lo, hi in zip([0, *cuts], [*cuts, len(order)]):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            if mid == lo:
                continue
            own, sizes = points[lo:mid], size[lo:mid]
            packed, levels = tree(own, sizes)
            for q in range(mid, hi):
                hit = search(packed, levels, own, sizes, points[q], int(size[q]), percent) + lo
                first = np.where(size[hit] < size[q], inner[hit], np.where(size[hit] > size[q], inner[q], inner[hit] | inner[q]))
                hit = ids[hit[first & (roots[hit] != roots[q])]]
                low.append(np.minimum(hit, ids[q]))
                high.append(np.maximum(hit, ids[q]))
        return pa.table({"a": pa.array(np.concatenate([np.zeros(0, np.int64), *low])), "b": pa.array(np.concatenate([np.zeros(0, np.int64), *high]))})

    return run


def similar_sets(docs: DataFrame, k: int = 5, percent: int = 80, lower: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs(doc_id, text)``.

    A set holds the distinct ``k``-word grams of the whole text (``lower``: of its A-Z lower-cased
    form), or the whole sequence of a shorter text. Sets link at a Jaccard similarity of
    ``percent`` / 100; component_id is the smallest doc_id reachable by links. Null text is empty;
    an empty set links with nothing. Rows with one doc_id are one node. A row without doc_id
    takes no part and has no component. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(spark) as own:
        often = spark.sparkContext.broadcast(frequent(docs, k, lower))
        with scratch(spark) as start:
            begun = cut_lineage(arrow_map(docs, _sets(k, lower, percent, often), "doc_id long, n long, id long, point binary, heads array<long>"), "begun")
            sets = start.keep(begun.drop("heads"), "sets")
            firsts = begun.where("n > 0 and doc_id is not null").select(
                "id", "n", F.size("heads").alias("heads"), F.posexplode("heads").alias("at", "bucket"))
            shared = cut_lineage(firsts.groupBy("bucket").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("bucket"), "shared")
            met = surely_few(firsts, "bucket", shared).groupBy("bucket", "id", "n", "heads").agg(F.min("at").alias("at"))
            met = cut_lineage(met, "met")
            several = met.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
            rows = cut_lineage(met.join(several, "bucket"), "buckets")
            common = rows.groupBy("id", "n").agg(F.count(F.lit(1)).alias("common"))
            rows = rows.join(common, ["id", "n"]).select("bucket", "id", "n", (F.col("at") < prefix_sizes(F.col("n"), percent)[0]).alias("inner"),
                                                         ((F.col("heads") - F.col("common")) / F.col("n")).alias("rank"))
            rows = start.keep(rows, "starts")
        known = sets.where("n > 0 and doc_id is not null")
        member = known.select("doc_id", "id").distinct()
        wanted = rows.select("id").distinct()
        chosen = semi_join(known.select("doc_id", "id", "n", "point"), wanted, "id").groupBy("id").agg(
            F.min(F.struct("doc_id", "n", "point")).alias("one"))
        chosen = cut_lineage(chosen.select("id", "one.*"), "chosen")
        repeated = not known.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").isEmpty()

        def test(pairs):
            """Only texts of pairs that their points allow are moved."""
            near = arrow_map(beside(pairs, chosen, "id", "n", "point"), _bound(percent), "a long, b long")
            near = cut_lineage(near, "near")
            asked = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            asked = cut_lineage(semi_join(chosen.select("doc_id", "id"), asked, "id"), "asked")
            named = maybe_in(docs, F.col("doc_id"), key_bits(asked, "doc_id"), "_maybe").where("_maybe").select("doc_id", "text")
            texts = named.join(asked, "doc_id").select("id", "text")
            if repeated:
                texts = arrow_map(texts, _own_text(k, lower), "id long, text string")  # an id may have several texts
            texts = cut_lineage(texts, "texts")
            return arrow_map(beside(near, texts, "id", "text"), _verify(k, lower, percent), "a long, b long").distinct()

        def rest(open_):
            """R-trees of each open bucket's blocks, searched by the ids outside its largest component."""
            parts = open_.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("bucket").agg(
                F.max_by("root", F.struct("m", "root")).alias("largest"), F.sum("m").alias("m"), (F.sum("m") - F.max("m")).alias("ask"))
            parts = cut_lineage(parts.select("bucket", "largest", "m", "ask", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"),
                                             F.ceil(F.col("ask") / QUERIES).cast("int").alias("parts")), "blocks")
            tasks = -(-(parts.agg(F.sum(F.col("m") * F.col("parts") + F.col("ask") * F.col("blocks"))).first()[0] or 1) // ROWS)
            held = open_.select("bucket", "id", "root", "inner").join(chosen.select("id", "n", "point"), "id").join(parts, "bucket")
            to = lambda c: F.pmod(F.xxhash64("id", F.lit(c)), F.col(c)).cast("int")
            columns = ["id", "root", "n", "inner", "point"]
            stored = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(to("blocks").alias("block"), i.alias("part"), F.lit(0).alias("side")))
            asking = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("block"), to("parts").alias("part"), F.lit(1).alias("side")))
            places = F.when(F.col("root") == F.col("largest"), stored).otherwise(F.concat(stored, asking))
            dealt = held.select("bucket", F.explode(places).alias("place"), *columns).select("bucket", "place.*", *columns)
            dealt = dealt.withColumn("task", F.pmod(F.xxhash64("bucket", "block", "part"), F.lit(tasks)))
            return dealt.groupBy("task").applyInArrow(_tree_join(percent), "a long, b long").distinct()

        roots = link_groups(rows, test, percent, rest)
        twice = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("hi")).where("a < hi")
        if not twice.isEmpty():
            ties = twice.join(member, "doc_id").select("a", F.col("id").alias("b")).where("a <> b")
            roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionAll(ties))
        tied = cut_lineage(member.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("root")).distinct(), "members")
        least = tied.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        node = tied.join(least, "root").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        return own.keep(sets.select("doc_id", F.col("n").alias("n_shingles")).join(node, "doc_id", "left").select(
            "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "similar-sets")
