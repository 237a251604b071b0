"""MinHash fingerprints of documents, and the near copies that their bands bring together."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from provisor.llm import words as W
from provisor.llm.common import MARKS, arrow_map, beside, key_bits, link_groups, maybe_in, surely_few
from provisor.llm.jaccard import _verify
from provisor.session import cut_lineage

PERMUTATIONS, WORDS = 128, 5
#: Permutations of a band: 32 bands miss a pair of similarity 0.8 with probability 5e-8.
BAND = 4
_ODD = W.mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_ADD = W.mixed(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64)).astype(np.uint32)


def signatures(shingles: np.ndarray, where: np.ndarray) -> np.ndarray:
    """One row per document: the low 16 bits of each permutation's smallest value.

    A permutation is x -> a x + b modulo 2**32 with odd a, over the upper half of the shingle
    hashes. A document without shingles has 0xFFFF throughout.
    """
    out = np.full((len(where) - 1, PERMUTATIONS), 0xFFFF, np.uint16)
    full = np.flatnonzero(np.diff(where))
    if len(full):
        x, starts = (shingles >> np.uint64(32)).astype(np.uint32), where[full]
        y = np.empty_like(x)
        for p in range(PERMUTATIONS):
            np.multiply(x, _ODD[p], out=y)
            y += _ADD[p]
            out[full, p] = np.minimum.reduceat(y, starts).astype(np.uint16)
    return out


def of_texts(column: pa.Array) -> np.ndarray:
    """Fingerprint row of every text; shingles are five words, or all words of a shorter text."""
    rows = [signatures(*W.shingle_hashes(hashes, first, WORDS)) for _, _, hashes, first in W.doc_words(column)]
    return np.concatenate(rows) if rows else np.zeros((0, PERMUTATIONS), np.uint16)


def _squeeze(batches):
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [press.compress(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(2)], ["doc_id", "packed", "id"])


_ROWS = "kind string, part int, doc_id long, id long, n_chars long, edited binary, own binary, other binary, next binary, packed binary"
#: Documents that one task edits and fingerprints at once.
RUN = 500


def _row(kind, part, doc_id, id=None, text=None, own=None, edited=None, other=None, following=None, packed=None):
    return {"kind": kind, "part": part, "doc_id": doc_id, "id": id, "n_chars": None if text is None else len(text), "edited": edited, "own": own,
            "other": other, "next": following, "packed": packed}


def _edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _walk(batches):
    """Sorted documents of a range -> fingerprints; the first and the last also as rows that carry their text."""
    part, last, schema = TaskContext.get().partitionId(), None, pa.schema(
        [("kind", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.binary()) for c in ("edited", "own", "other", "next", "packed"))])
    for batch in batches:
        for lo in range(0, len(batch), RUN):
            piece = batch.slice(lo, RUN)
            packed = piece.column(1).to_pylist()
            texts = [zstandard.decompress(x).decode(errors="replace") for x in packed]
            own = of_texts(pa.array(texts, pa.large_string()))
            held = list(zip(piece.column(0).to_pylist(), texts, own, packed, piece.column(2).to_pylist()))
            rows = []
            if last is None:
                rows.append(_row("head", part, held[0][0], own=held[0][2].tobytes(), packed=held[0][3]))
            else:
                held.insert(0, last)
            edited = [_edit(a[1], b[1]) for a, b in zip(held, held[1:])]
            other = of_texts(pa.array(edited, pa.large_string()))
            for a, b, e, o in zip(held, held[1:], edited, other):
                rows.append(_row("done", part, a[0], a[4], a[1], a[2].tobytes(), hashlib.sha256(e.encode()).digest(), o.tobytes(), b[2].tobytes()))
            last = held[-1]
            yield pa.RecordBatch.from_pylist(rows, schema)
    if last is not None:
        yield pa.RecordBatch.from_pylist([_row("tail", part, last[0], last[4], last[1], last[2].tobytes(), packed=last[3])], schema)


def _close(batches):
    """(doc_id, id, own, packed, next, next_packed) of a range's last document and the one after it."""
    for batch in batches:
        for doc_id, id, own, packed, following, after in zip(*(c.to_pylist() for c in batch.columns)):
            text, other = (zstandard.decompress(x).decode(errors="replace") for x in (packed, after))
            edited = _edit(text, other)
            yield pa.RecordBatch.from_pylist([{
                "doc_id": doc_id, "id": id, "n_chars": len(text), "edited": hashlib.sha256(edited.encode()).digest(), "own": own,
                "other": of_texts(pa.array([edited], pa.large_string()))[0].tobytes(), "next": following}],
                pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.binary()) for c in ("edited", "own", "other", "next"))]))


def _likeness(batches):
    for batch in batches:
        sides = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, PERMUTATIONS) for c in ("own", "other", "next")}
        hexed = {c: pa.array([x.hex() for x in batch.column(c).to_pylist()]) for c in ("own", "other", "edited")}
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("n_chars"), hexed["edited"], hexed["own"], hexed["other"],
            pa.array((sides["own"] == sides["other"]).mean(1)), pa.array((sides["own"] == sides["next"]).mean(1)),
            batch.column("component_id")],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"])


def _banded(batches):
    """(id, fingerprint) -> the hashes of its bands; a text without shingles has none."""
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)
        some = (rows != 0xFFFF).any(1)
        bands = np.ascontiguousarray(rows[some]).view(np.uint64)
        bands = W.mixed(bands ^ W.mixed(np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * W._P)).view(np.int64)
        ids = batch.column(0).filter(pa.array(some))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1) * bands.shape[1], pa.int32()), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays([ids, lists], ["id", "bands"])


_MARKED = "id long, n long, ones long, " + ", ".join(f"b{k} long" for k in range(MARKS))


def _marked(batches):
    """(id, text) -> size of the shingle set and its marks (see ``common.marks``)."""
    for batch in batches:
        for i, j, hashes, first in W.doc_words(batch.column(1)):
            grams, where = W.shingle_hashes(hashes, first, WORDS)
            flags, n = np.zeros((j - i, MARKS * 64), np.uint8), np.zeros(j - i, np.int64)
            for d in range(j - i):
                own = np.unique(grams[where[d]:where[d + 1]])
                n[d] = len(own)
                flags[d, (own & np.uint64(MARKS * 64 - 1)).astype(np.int64)] = 1
            bits = np.packbits(flags, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(flags.sum(1, dtype=np.int64)), *(pa.array(x) for x in bits.T)],
                                             ["id", "n", "ones", *(f"b{k}" for k in range(MARKS))])


def near_copies(docs: DataFrame, prints: DataFrame, percent: int = 80) -> DataFrame:
    """(id, component_id) of every text that stands twice or is linked to another one.

    ``docs(doc_id, text, id)`` has the texts and their hashes, ``prints(doc_id, id, own)`` the
    fingerprint of each row. Texts whose fingerprints share a band are verified on their full
    shingle sets and link at a Jaccard similarity of ``percent`` / 100. component_id is the
    smallest doc_id of the component.
    """
    texts = cut_lineage(prints.groupBy("id").agg(F.first("own").alias("own"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "texts")
    bands = arrow_map(texts.select("id", "own"), _banded, "id long, bands array<long>").select("id", F.explode("bands").alias("bucket"))
    bands = cut_lineage(bands, "bands")
    shared = cut_lineage(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "shared")
    met = cut_lineage(surely_few(bands, "bucket", shared).join(shared, "bucket"), "met")
    # The text that others were copied from comes first: its bands are the most widely shared.
    ranks = cut_lineage(met.groupBy("id").agg((-F.sum("sets")).cast("double").alias("rank")), "ranks")
    held = maybe_in(docs, F.col("id"), key_bits(ranks, "id"), "_maybe").where("_maybe").groupBy("id").agg(F.first("text").alias("text"))
    held = cut_lineage(held, "near-texts")
    marks = cut_lineage(arrow_map(held, _marked, _MARKED), "near-marks")
    sized = ranks.join(marks.select("id", "n"), "id")
    rows = met.select("bucket", "id").join(sized, "id").select("bucket", "id", "n", F.lit(True).alias("inner"), "rank")

    def test(pairs):
        return arrow_map(beside(pairs, held, "id", "text"), _verify(WORDS, False, percent), "a long, b long").distinct()

    roots = link_groups(cut_lineage(rows, "starts"), test, percent, marked=lambda ids: ids.join(marks.drop("n"), "id"))
    tied = cut_lineage(texts.select("id", "least", "rows").join(roots, "id", "left").select("id", "least", "rows", F.coalesce("root", "id").alias("root")), "tied")
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("n")).where("n > 1")
    return tied.select("id", "root").join(least, "root").select("id", "component_id")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of each text with its second half exchanged.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of
    the next document's, in ascending doc_id; the first document follows the last. Columns:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited and
    near_next (equal share of the permutations), component_id. Null text is empty; null ids come first; rows
    with equal ids follow a hash of their texts. Each row stays. Other columns are ignored.

    component_id is the smallest doc_id among the rows that links reach: equal texts, and texts
    whose sets of five-word shingles have a Jaccard similarity of 0.8 (see ``near_copies``). A
    text without words links only with its equals. Each text is a node of its own, also where
    doc_ids repeat.

    The texts are moved once, compressed, into ranges of doc_id. A range hands over only its
    first and last document. Texts whose bands meet others are moved again.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("id", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("packed")]
    ranged = arrow_map(docs, _squeeze, "doc_id long, packed binary, id long").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut_lineage(arrow_map(ranged, _walk, _ROWS), "fingerprints")
    heads = rows.where("kind = 'head'").select("part", F.col("own").alias("next"), F.col("packed").alias("after"))
    along = Window.orderBy("part")  # one narrow row per range
    parts = heads.select("part", F.lead("part").over(along).alias("_lead"), F.min("part").over(Window.partitionBy()).alias("_least"))
    follow = parts.select("part", F.coalesce("_lead", "_least").alias("_next"))
    tails = rows.where("kind = 'tail'").select("part", "doc_id", "id", "own", "packed").join(follow, "part").join(
        heads.withColumnRenamed("part", "_next"), "_next").select("doc_id", "id", "own", "packed", "next", "after")
    done = rows.where("kind = 'done'").select("doc_id", "id", "n_chars", "edited", "own", "other", "next")
    closed = arrow_map(tails, _close, "doc_id long, id long, n_chars long, edited binary, own binary, other binary, next binary")
    near = cut_lineage(near_copies(docs, rows.where("kind <> 'head'").select("doc_id", "id", "own")), "near-copies")
    marked = maybe_in(done.unionAll(closed), F.col("id"), key_bits(near, "id"), "_maybe")
    own = ["doc_id", "n_chars", "edited", "own", "other", "next"]
    touched = marked.where("_maybe").join(near, "id", "left").select(*own, F.coalesce("component_id", "doc_id").alias("component_id"))
    every = touched.unionAll(marked.where("not _maybe").select(*own, F.col("doc_id").alias("component_id")))
    return arrow_map(every, _likeness, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                     "edited_fingerprint string, near_edited double, near_next double, component_id long")
