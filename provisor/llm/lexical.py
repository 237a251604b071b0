"""Exact top-k lexical search of all documents for a set of items, by dual-tree search.

A document is a sparse vector of saturated term frequencies, an item one of term weights; their
product is the score. Items and documents form hierarchies whose nodes hold coordinate maxima, so
the product of two nodes bounds the score of every pair below them. A pair of nodes whose bound is
below the weakest k-th best score of the items in it is left out as a whole, down to a leaf of
documents and one item; all other pairs are scored in 64-bit integers, held as doubles while they
are below 2**53 and so just as exact.

Items are searched in blocks of bounded size. Their tree is built once per block and sent to the
tasks, which build trees of their own documents as they come and carry the best scores along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from provisor.llm import words as W
from provisor.llm.common import arrow_map
from provisor.session import cut_lineage, ship

#: Slots of the bitmap of all items' terms: 4 MB.
SLOTS = 1 << 25
#: Items and terms of a block of items, about. A longer item is a block's bulk by itself.
ITEMS, TERMS = 2_048, 16_384
#: Nodes or members of a node of either tree; numbers that a block of documents takes at most.
ITEM_LEAF, DOC_LEAF, FAN, DENSE = 8, 16, 8, 4 << 20
#: Whole numbers that a double holds exactly; factor that keeps a rounded bound above the true one.
EXACT, ABOVE = 1 << 53, 1 + 1e-9

#: Bytes between terms: ASCII other than digits and letters.
BETWEEN = np.array([b < 0x80 and not bytes([b]).isalnum() for b in range(256)])


def _counted(column: pa.Array, keep=None):
    """Per run of texts: (i, j, terms of each text, distinct (text, term) with their counts); ``keep`` filters hashes."""
    for i, j, hashes, first in W.doc_words(column, True, between=BETWEEN):
        seg = W.segment_of(first)
        if keep is not None:
            ok = keep(hashes)
            hashes, seg = hashes[ok], seg[ok]
        order = np.lexsort((hashes, seg))
        hashes, seg = hashes[order].view(np.int64), seg[order]
        new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (seg[1:] != seg[:-1])]) if len(seg) else np.zeros(0, np.int64)
        times = np.diff(np.r_[new, len(seg)])
        yield i, j, np.diff(first), seg[new], hashes[new], times


def _vectors(bits):
    """(key columns, text) -> the same key columns, n terms, the distinct terms that pass the bitmap, and their counts."""

    def run(batches):
        flags = None if bits is None else np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        keep = None if flags is None else lambda h: flags[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
        for batch in batches:
            for i, j, n, seg, terms, times in _counted(batch.column("text"), keep):
                cuts = pa.array(np.searchsorted(seg, np.arange(j - i + 1)), pa.int32())
                keys = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(n, pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(terms)), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))],
                    [*batch.schema.names[:-1], "n", "terms", "times"])

    return run


def _bitmap(terms: DataFrame) -> bytes:
    """Flags of the low bits of all terms, 4 MB whatever their number."""
    slot = F.col("term").bitwiseAND(F.lit(SLOTS - 1)) + 1
    told = terms.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out, wide = bytearray(SLOTS // 8), 4096
    for r in told:
        out[(r["bucket"] - 1) * wide:r["bucket"] * wide] = r["bits"]
    return bytes(out)


class ItemTree:
    """Items of a block: leaves of similar items, groups of leaves, and the coordinate maxima of both."""

    def __init__(self, keys: list[int], vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.vocabulary = np.unique(np.concatenate([t for t, _ in vectors])) if vectors else np.zeros(0, np.int64)
        most = max((int(w.sum()) for _, w in vectors), default=0) * 1_000_000
        self.kind = np.float64 if most < EXACT else np.int64
        own = [(np.searchsorted(self.vocabulary, t), w) for t, w in vectors]
        order = sorted(range(len(own)), key=lambda i: (int(own[i][0][own[i][1].argmax()]), keys[i]))
        self.keys = np.array([keys[i] for i in order], np.int64)
        self.leaves = []
        for lo in range(0, len(order), ITEM_LEAF):
            few = [own[i] for i in order[lo:lo + ITEM_LEAF]]
            at = np.unique(np.concatenate([t for t, _ in few]))
            weights = np.zeros((len(at), len(few)), self.kind)
            for k, (t, w) in enumerate(few):
                weights[np.searchsorted(at, t), k] = w
            self.leaves.append((slice(lo, lo + len(few)), at, weights))
        self.groups = []
        for lo in range(0, len(self.leaves), FAN):
            few = self.leaves[lo:lo + FAN]
            at = np.unique(np.concatenate([x[1] for x in few]))
            corners = np.zeros((len(at), len(few)))
            for k, (_, t, w) in enumerate(few):
                corners[np.searchsorted(at, t), k] = w.max(1)
            self.groups.append((lo, at, corners, corners.max(1)))


class Best:
    """The k best documents of every item so far: score descending, then doc_id, null last."""

    def __init__(self, items: int, k: int):
        self.k, last = k, np.iinfo(np.int64).max
        self.score, self.doc, self.none = np.zeros((items, k), np.int64), np.full((items, k), last), np.ones((items, k), bool)

    def weakest(self, items: slice) -> int:
        return int(self.score[items, -1].min())

    def offer(self, item: int, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        kth, last, empty = self.score[item, -1], self.doc[item, -1], self.none[item, -1]
        ok = (score > 0) & ((score > kth) | ((score == kth) & ((none < empty) | ((none == empty) & (doc < last)))))
        if ok.any():
            s, d, e = (np.concatenate(x) for x in ((self.score[item], score[ok]), (self.doc[item], doc[ok]), (self.none[item], none[ok])))
            first = np.lexsort((d, e, -s))[:self.k]
            self.score[item], self.doc[item], self.none[item] = s[first], d[first], e[first]


def search(tree: ItemTree, best: Best, doc: np.ndarray, none: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[int, int]:
    """Offer documents, given as (row, coordinate, value), to all items; returns pairs of a leaf and an item: (scored, in all)."""
    # Documents whose strongest coordinates agree share a leaf.
    top = np.zeros(len(doc), np.int64)
    rising = np.argsort(value, kind="stable")
    top[row[rising]] = at[rising]
    order = np.argsort(top, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    dense = np.zeros((-(-len(doc) // DOC_LEAF) * DOC_LEAF, len(tree.vocabulary)), np.float32 if tree.kind is np.float64 else np.int64)
    dense[place[row], at] = value  # at most 1,000,000, which 32 bits hold exactly
    doc, none = doc[order], none[order]
    leaf = dense.reshape(-1, DOC_LEAF, dense.shape[1]).max(1)
    starts = np.arange(0, len(leaf), FAN)
    group = np.maximum.reduceat(leaf, starts, axis=0)
    scored = 0
    for lo, columns, corners, peak in tree.groups:
        slices = [tree.leaves[lo + k][0] for k in range(corners.shape[1])]
        bound = ABOVE * (group[:, columns].astype(np.float64) @ peak)
        for g in np.argsort(-bound, kind="stable"):
            if bound[g] <= 0 or bound[g] < min(best.weakest(s) for s in slices):
                continue
            nodes = np.arange(starts[g], min(starts[g] + FAN, len(leaf)))
            finer = ABOVE * (leaf[np.ix_(nodes, columns)].astype(np.float64) @ corners)
            for flat in np.argsort(-finer, axis=None, kind="stable"):
                n, k = divmod(int(flat), len(slices))
                if finer[n, k] <= 0:
                    break
                if finer[n, k] < best.weakest(slices[k]):
                    continue
                items, own, weights = tree.leaves[lo + k]
                docs = slice(nodes[n] * DOC_LEAF, min((nodes[n] + 1) * DOC_LEAF, len(doc)))
                alone = leaf[nodes[n], own].astype(tree.kind) @ weights
                live = np.flatnonzero((alone > 0) & (alone >= best.score[items, -1]))
                if not len(live):
                    continue
                scores = (dense[docs][:, own].astype(tree.kind) @ weights[:, live]).astype(np.int64)
                scored += len(live)
                for c, i in enumerate(live):
                    if scores[:, c].max() >= best.score[items.start + i, -1]:
                        best.offer(items.start + i, scores[:, c], doc[docs], none[docs])
    return scored, len(leaf) * len(tree.keys)


def _searched(trees, n_docs: int, n_terms: int, k: int):
    """(doc_id, n, terms, times) -> (key, doc_id, score): the best of this task's documents for every item."""

    def run(batches):
        tree = trees.value
        best = Best(len(tree.keys), k)
        rows = max(DOC_LEAF, DENSE // max(1, len(tree.vocabulary)))
        for whole in batches:
            for lo in range(0, len(whole), rows):
                batch = whole.slice(lo, rows)
                terms, counts = (batch.column(c).flatten().to_numpy() for c in ("terms", "times"))
                row = np.repeat(np.arange(len(batch)), np.asarray(batch.column("terms").value_lengths()))
                at = np.minimum(np.searchsorted(tree.vocabulary, terms), len(tree.vocabulary) - 1)
                ok = tree.vocabulary[at] == terms
                row, at, tf = row[ok], at[ok], counts[ok].astype(np.int64)
                m = 100 - 25 + (25 * batch.column("n").to_numpy() * n_docs) // max(1, n_terms)
                value = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
                ids = batch.column("doc_id")
                search(tree, best, ids.fill_null(np.iinfo(np.int64).max).to_numpy(), np.asarray(ids.is_null()), row, at, value)
        item, nth = np.nonzero(best.score > 0)
        ids = pa.array(best.doc[item, nth], pa.int64(), mask=best.none[item, nth])
        yield pa.RecordBatch.from_arrays([pa.array(tree.keys[item], pa.int64()), ids, pa.array(best.score[item, nth])], ["key", "doc_id", "score"])

    return run


def best_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` documents with the highest score above 0 for every item.

    Terms are runs of bytes other than ASCII signs, spaces and controls, with A-Z lower-cased.
    With N documents that have a term, L terms in all, n terms of a document, df documents with a
    term and tf occurrences: a term weighs floor(1000 ln((2 N + 2) / (2 df + 1))), a document has
    m = 75 + 25 n N div L, and each term of an item, repeats included, adds
    weight * (10**9 tf div (1000 tf + 12 m)). All statistics cover all documents.

    Equal scores go by ascending doc_id, null last. Null or empty texts have no terms: such a
    document is never found, such an item has no rows. Each row of ``docs`` is a document, also
    where ids or texts repeat. Rows of ``items`` that agree in item_id and text count once; other
    texts of the same item_id are ranked for themselves. Other columns are ignored. Terms stand
    as 64-bit hashes.

    One block of items at a time reaches the driver, with the bitmap of terms and two sums.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).distinct()
    kind = asked.schema["item_id"].dataType.simpleString()
    asked = asked.select("item_id", F.xxhash64("item_id", "text").alias("key"), "text")
    shape = "n long, terms array<long>, times array<int>"
    asked = cut_lineage(arrow_map(asked, _vectors(None), f"item_id {kind}, key long, {shape}").where("n > 0"), "items")
    bits = spark.sparkContext.broadcast(_bitmap(asked.select(F.explode("terms").alias("term"))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = cut_lineage(arrow_map(texts, _vectors(bits), f"doc_id long, {shape}").where("n > 0"), "vectors")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    each = asked.select("key", F.explode(F.arrays_zip("terms", "times")).alias("t")).select("key", F.col("t.terms").alias("term"), F.col("t.times").alias("times"))
    each = cut_lineage(each.join(held, "term"), "weights")
    n_items, wide = each.agg(F.count_distinct("key"), F.count(F.lit(1))).first()
    blocks = max(-(-n_items // ITEMS), -(-wide // TERMS))
    found = None
    for block in range(blocks):
        rows = each.where(F.pmod("key", F.lit(blocks)) == block).groupBy("key").agg(
            F.collect_list("term").alias("terms"), F.collect_list(F.struct("times", "df")).alias("told")).collect()
        tree = []
        for r in rows:
            times, df = (np.array([t[c] for t in r["told"]], np.int64) for c in ("times", "df"))
            weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64) * times
            if (weight > 0).any():
                tree.append((r["key"], (np.array(r["terms"], np.int64)[weight > 0], weight[weight > 0])))
        if tree:
            trees = spark.sparkContext.broadcast(ItemTree([key for key, _ in tree], [v for _, v in tree]))
            one = arrow_map(vectors, _searched(trees, n_docs, n_terms, k), "key long, doc_id long, score long")
            found = one if found is None else found.unionAll(one)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
