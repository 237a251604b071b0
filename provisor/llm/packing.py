"""Best-fit packing of documents into training sequences.

Pieces are alike when they are equally long, so the packing is planned on the counts per length
(one row per length, however large the corpus) and then applied to the pieces: a piece's running
number among its length finds its sequence and place in the plan. Bins with the same residual
capacities are planned as one group, which gives what vector best-fit decreasing would give piece
by piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from provisor.llm.common import arrow_map
from provisor.llm.tokens import encoded
from provisor.session import cut_lineage

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end: int | None, size: int):
    def run(batches):
        for batch in batches:
            for i, j, ids, first in encoded(batch.column(1), path):
                if end is not None:
                    ids = np.insert(ids, first[1:], end)
                    first = first + np.arange(len(first))
                length = np.diff(first)
                n = -(-length // size)
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * size
                own = np.minimum(size, length[doc] - start)
                raw, at = memoryview(ids.astype("<u4")).cast("B"), first[doc] + start
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + own).tolist())]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                    pa.array(own), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, end: int | None = 0, size: int = 2048) -> DataFrame:
    """Token pieces of at most ``size`` ids: doc_id, piece, start, length, ids_crc32.

    ``end`` is appended to each document. Null text is empty; a document without any id has no
    piece. Each row is a document of its own, also when ids repeat or are null.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(docs, _cut(path, end, size), _PIECES)


def plan(counts: dict[int, int], size: int, max_docs: int, max_cost: int, weights=(1.0, 1.0, 1.0), rule: str = "norm") -> np.ndarray:
    """Rows (length, first number, first bin, bins, pieces per bin, offset) for all pieces.

    Each piece needs (length, 1, length**2) of a bin's (size, max_docs, max_cost). Lengths go in
    descending order. ``norm`` takes the feasible bin with the smallest weighted norm of what is
    left after the piece, ``dot`` the one with the largest weighted dot product of need and
    residual, both relative to the capacities. A new bin is opened when no bin is feasible.
    """
    cap = np.array([size, max_docs, max_cost], np.int64)
    groups: dict[tuple, list] = {}
    rows, bins = [], 0
    for length in sorted(counts, reverse=True):
        need, left, number = np.array([length, 1, length * length], np.int64), counts[length], 0
        if (need > cap).any():
            raise ValueError(f"a piece of {length} ids doesn't fit an empty sequence")
        while left:
            states = np.array(list(groups), np.int64).reshape(-1, 3)
            fits = np.flatnonzero((states >= need).all(1))
            rest = (states[fits] - need) / cap
            score = (np.asarray(weights) * rest**2).sum(1) if rule == "norm" else -(np.asarray(weights) * need / cap * states[fits] / cap).sum(1)
            order = fits[np.argsort(score, kind="stable")]
            if not len(order):
                fresh = -(-left // int((cap // need).min()))
                groups.setdefault(tuple(cap.tolist()), []).append((bins, fresh))
                bins += fresh
                continue
            for g in order[:1] if rule == "dot" else order:
                state = tuple(states[g].tolist())
                each = int((states[g] // need).min()) if rule == "norm" else 1
                for lo, n in groups.pop(state):
                    for k, m in ((each, min(n, left // each)), (left % each, 1)):
                        if k and m and n and left >= k * m:
                            rows.append((length, number, lo, m, k, size - state[0]))
                            after = tuple((states[g] - k * need).tolist())
                            groups.setdefault(after, []).append((lo, m))
                            number, left, lo, n = number + k * m, left - k * m, lo + m, n - m
                    if n:
                        groups.setdefault(state, []).append((lo, n))
                if not left:
                    break
    return np.array(rows, np.int64).reshape(-1, 6)


def _place(table):
    def run(batches):
        rows = table.value
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows = rows[order]
        lengths, group = np.unique(rows[:, 0], return_index=True)
        ends = np.append(group[1:], len(rows))
        for batch in batches:
            length, number = batch.column(batch.schema.get_field_index("length")).to_numpy(), batch.column(batch.schema.get_field_index("_number")).to_numpy()
            at = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            kinds, first = np.unique(length[order], return_index=True)
            for value, own in zip(kinds, np.split(order, first[1:])):
                lo, hi = group[k := np.searchsorted(lengths, value)], ends[k]
                at[own] = lo + np.searchsorted(rows[lo:hi, 1], number[own], "right") - 1
            row = rows[at]
            nth = number - row[:, 1]
            seq, off = row[:, 2] + nth // row[:, 4], row[:, 5] + nth % row[:, 4] * length
            names = [n for n in batch.schema.names if n != "_number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(seq), pa.array(off)],
                                             [*names, "sequence_id", "offset"])

    return run


def _numbered():
    """Number the rows of a task per length."""

    def run(batches):
        seen, task = {}, TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            order = np.argsort(length, kind="stable")
            kinds, first, n = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(first - [seen.get(k, 0) for k in kinds.tolist()], n)
            for k, m in zip(kinds.tolist(), n.tolist()):
                seen[k] = seen.get(k, 0) + m
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), task, np.int32)), pa.array(nth)],
                                             [*batch.schema.names, "_task", "_nth"])

    return run


def pack(items: DataFrame, size: int = 2048, max_docs: int | None = None, max_cost: int | None = None,
         weights=(1.0, 1.0, 1.0), rule: str = "norm") -> DataFrame:
    """``items`` (any columns with a long ``length``) plus sequence_id and offset.

    Capacities of a sequence: ``size`` tokens, ``max_docs`` pieces (default: as many as tokens)
    and ``max_cost`` of summed squared lengths (default: size**2, which never binds). A null
    length or one below 1 takes no part and is left out. Only counts per length, at most ``size``
    rows, reach the driver.
    """
    spark = items.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    items = cut_lineage(arrow_map(items.where("length > 0"), _numbered(), f"{schema}, _task int, _nth long"), "pieces")
    per = items.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = per.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows = plan(counts, size, max_docs or size, max_cost or size * size, weights, rule)
    placed = items.join(base.select("length", "_task", "_base"), ["length", "_task"]).withColumn("_number", F.col("_base") + F.col("_nth"))
    placed = placed.select(*[c for c in items.columns if c not in ("_task", "_nth")], "_number")
    return arrow_map(placed, _place(spark.sparkContext.broadcast(rows)), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end: int | None = 0, size: int = 2048, **capacities) -> DataFrame:
    """Cut ``docs(doc_id, text)`` into pieces and pack them; see ``pieces`` and ``pack``."""
    return pack(pieces(docs, path, end, size), size, **capacities)
