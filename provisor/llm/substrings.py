"""Removal of passages that an earlier document already has.

Every window of ``words`` consecutive words gets a 64-bit Rabin-Karp hash. The hashes of a run of
documents are sorted, thinned to the smallest document of each hash, cut into hash ranges and
packed, so a range reaches its task as a few binary rows and a hash that is everywhere arrives
once per run, not once per document. The task of a range finds the smallest document of every
hash and answers with the hashes that each later document repeats; overlapping repeated windows
of a document merge into maximal intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provisor.llm import words as W
from provisor.llm.common import arrow_map, key_bits, maybe_in
from provisor.session import cut_lineage, ship

#: Windows that one task compares at once, and the least number of hash ranges.
RANGE_WINDOWS, LEAST_RANGES = 1 << 22, 64


def _per_document(ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """One row per document with its hashes, packed."""
    order = np.argsort(ids, kind="stable")
    ids, hashes = ids[order], hashes[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][:len(ids)])
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [
        None, pa.py_buffer(np.append(first, len(ids)).astype(np.int64) * 8), pa.py_buffer(np.ascontiguousarray(hashes))])
    return pa.RecordBatch.from_arrays([pa.array(ids[first]), packed.cast(pa.binary())], ["doc_id", "hashes"])


def _pack(k: int, bits: int):
    """Documents -> (key, ids, docs, gaps, hashes): what a run of documents tells a hash range.

    A key below zero marks hashes that repeat inside the run; they need no range.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            for i, j, hashes, first in W.doc_words(batch.column(1).take(pa.array(order)), limit=4 * W.PIECE):
                window, where = W.window_hashes(hashes, first, k)
                if not len(window):
                    continue
                own = ids[order[i:j]]
                doc = W.segment_of(where)
                by = np.argsort(window, kind="stable")  # documents stay ascending inside a hash
                window, doc = window[by], doc[by]
                new = np.r_[True, window[1:] != window[:-1]]
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                again = own[doc] > own[doc[lead]]
                rows = []
                if again.any():
                    h, d = window[again], own[doc[again]]
                    keep = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
                    h, d = h[keep], d[keep]
                    rows.append((-1 - int(h[0] >> np.uint64(40)), d.tobytes(), b"", b"", h.tobytes()))
                window, doc = window[new], doc[new]
                cuts = np.searchsorted(window, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                cuts = np.append(cuts, len(window))
                for r in range(1 << bits):
                    lo, hi = cuts[r], cuts[r + 1]
                    if lo < hi:
                        gap = np.diff(window[lo:hi], prepend=np.uint64(r << (64 - bits)))
                        wide = max(1, (int(gap.max()).bit_length() + 7) // 8)
                        rows.append((r, own.tobytes(), doc[lo:hi].astype(np.uint32 if len(own) > 65535 else np.uint16).tobytes(),
                                     gap.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes(), b""))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[c] for x in rows], t) for c, t in enumerate([pa.int64()] + [pa.binary()] * 4)],
                    ["key", "ids", "docs", "gaps", "hashes"])

    return run


def _compare(bits: int):
    """All rows of a hash range -> (doc_id, hashes) that repeat a smaller document's window."""

    def run(table: pa.Table) -> pa.Table:
        hashes, docs = [], []
        for key, ids, doc, gaps, plain in zip(*(table.column(c).to_pylist() for c in range(5))):
            own = np.frombuffer(ids, np.int64)
            if key < 0:
                return pa.Table.from_batches([_per_document(
                    np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column(1)]),
                    np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column(4)]))])
            at = np.frombuffer(doc, np.uint32 if len(own) > 65535 else np.uint16)
            wide = len(gaps) // len(at)
            full = np.zeros((len(at), 8), np.uint8)
            full[:, :wide] = np.frombuffer(gaps, np.uint8).reshape(-1, wide)
            hashes.append(np.cumsum(full.view(np.uint64)[:, 0]) + np.uint64(key << (64 - bits)))
            docs.append(own[at])
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        least = np.repeat(np.minimum.reduceat(d, start), np.diff(np.append(start, len(h))))
        late = d > least
        return pa.Table.from_batches([_per_document(d[late], h[late])])

    return run


def _covered(n: int, hits: np.ndarray, k: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, hits, 1)
    np.add.at(step, hits + k, -1)
    return np.cumsum(step[:-1]) > 0


def _finish(k: int, text: bool):
    """(doc_id, text, marks) -> removal intervals and either the kept text or its digest."""

    def run(batches):
        for batch in batches:
            ids, texts, marks = batch.column(0), batch.column(1), batch.column(2)
            out = []
            for i in range(len(batch)):
                raw = texts[i].as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                words = raw.split()
                n, spans, marked = len(words), [], marks[i].as_py()
                if marked:
                    data = np.frombuffer(raw, np.uint8)
                    s, e, first = W.word_bounds(data, np.array([0, len(raw)]))
                    window, _ = W.window_hashes(W.span_hashes(data, s, e), first, k)
                    bad = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in marked]))
                    gone = _covered(n, np.flatnonzero(np.isin(window, bad)), k)
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    spans = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                    words = [w for w, g in zip(words, gone) if not g]
                kept = b" ".join(words)
                out.append((n, n - len(words), spans, kept.decode() if text else hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array([x[c] for x in out], t) for c, t in enumerate(kinds))],
                ["doc_id", "n_words", "n_removed", "removed", "kept" if text else "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, words: int = 13, text: bool = True) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, removed intervals of words
    (start, end) and ``kept``, the kept words joined by one space (``text=False``: kept_sha256).

    A word goes when a window over it also starts in a document with a smaller doc_id. Null text
    has no words. Rows with one doc_id count as one document, so they do not repeat each other;
    each keeps its row. A row without doc_id neither loses words nor counts as earlier. Other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    ship(spark)
    known = docs.where("doc_id is not null and text is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, size / 6 / RANGE_WINDOWS)
    bits = int(np.ceil(np.log2(ranges)))
    told = arrow_map(known, _pack(words, bits), "key long, ids binary, docs binary, gaps binary, hashes binary")
    late = cut_lineage(told.groupBy("key").applyInArrow(_compare(bits), "doc_id long, hashes binary"), "late-windows")
    marks = late.groupBy("doc_id").agg(F.collect_list("hashes").alias("marks"))
    split = maybe_in(docs, F.col("doc_id"), key_bits(late, "doc_id"), "_late")
    joined = split.where("_late").join(marks, "doc_id", "left").select("doc_id", "text", "marks")
    clean = split.where("not _late").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("marks"))
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, "
    return arrow_map(joined.unionAll(clean), _finish(words, text), schema + ("kept string" if text else "kept_sha256 string"))
