"""Token-id files: documents as range-coded blocks, written and read by Spark.

A data set is a folder with two Parquet tables. ``table`` is the shared frequency table (id,
freq). ``blocks`` has one row per block: part, block, n_ids, doc_ids, doc_sizes and the coded
payload (see ``rans``). Parts and their blocks follow ascending doc_id. A block holds whole
documents, about ``BLOCK_IDS`` ids of them or one longer document, and can be read alone.
Documents without an id are in blocks of their own, whose doc_ids are null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from provisor.llm import rans
from provisor.llm.common import arrow_map
from provisor.llm.tokens import encoded, encoder
from provisor.operators.spread import running_total
from provisor.session import cut_lineage, shared_dir

BLOCK_IDS = 1 << 20
_BLOCKS = "part int, block int, n_ids long, doc_ids binary, doc_sizes binary, payload binary"


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """One binary value per document from its slice of ``values``."""
    where = (first * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(values))])


def _tokenise(path: str, end: int | None, kind: str):
    def run(batches):
        for batch in batches:
            for i, j, ids, first in encoded(batch.column(1), path):
                if end is not None:
                    ids = np.insert(ids, first[1:], end)
                    first = first + np.arange(len(first))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(first)), packed(ids.astype(kind), first)],
                    ["doc_id", "n_ids", "ids"])

    return run


def tokenise(docs: DataFrame, path: str, end: int | None = None) -> tuple[DataFrame, str]:
    """(doc_id, n_ids, ids) per row and the numpy type of the packed ids. Null text is empty."""
    most = max(encoder(path).tokenizer.get_vocab_size(), end or 0)
    kind = "<u2" if most < 1 << 16 else "<u4"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(docs, _tokenise(path, end, kind), "doc_id long, n_ids long, ids binary"), kind


def _count(kind: str):
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column(0):
                own = np.bincount(np.frombuffer(value.as_buffer(), kind))
                if len(own) > len(total):
                    own, total = total, own.astype(np.int64)
                total[:len(own)] += own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    return run


def _encode(kind: str, table, block_ids: int):
    def run(batches):
        part, block, held, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)]),
                pa.array([None if names[0] is None else np.array(names, np.int64).tobytes()], pa.binary()),
                pa.array([np.array([len(x) for x in held], np.uint64).tobytes()], pa.binary()),
                pa.array([rans.encode(ids, table.value)], pa.binary())],
                ["part", "block", "n_ids", "doc_ids", "doc_sizes", "payload"])

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(value.as_buffer(), kind)
                if held and (size + len(ids) > block_ids or (name is None) != (names[0] is None)):
                    yield row()
                    held, names, size, block = [], [], 0, block + 1
                held.append(ids)
                names.append(name)
                size += len(ids)
        if held:
            yield row()

    return run


def write_ids(docs: DataFrame, path: str, end: int | None, target: str, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs(doc_id, text)`` with the tokenizer file ``path`` into the data set ``target``.

    ``end`` is appended to every document. Documents are in ascending doc_id order; equal ids
    follow their token bytes, null ids come first. Every row becomes a document, empty ones too.
    The texts are encoded once; the frequency table counts all ids. Other columns are ignored.
    """
    spark = docs.sparkSession
    tokens, kind = tokenise(docs, path, end)
    tokens = cut_lineage(tokens, "token-ids")
    counts = arrow_map(tokens.select("ids"), _count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # one row per vocabulary entry at most
    n = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    n[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    table = rans.Table.of_counts(n)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(table.freq) if f], "id long, freq long").coalesce(1).write.parquet(f"{target}/table")
    ordered = tokens.select("doc_id", "ids").repartitionByRange("doc_id", F.crc32("ids")).sortWithinPartitions(
        "doc_id", F.crc32("ids"), "ids")
    arrow_map(ordered, _encode(kind, spark.sparkContext.broadcast(table), block_ids), _BLOCKS).write.option(
        "compression", "none").parquet(f"{target}/blocks")


def read_table(spark: SparkSession, target: str) -> rans.Table:
    found = spark.read.schema("id long, freq long").parquet(f"{target}/table").toPandas()
    freq = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    freq[found["id"].to_numpy(np.int64)] = found["freq"].to_numpy(np.int64)
    return rans.Table(freq)


def _decode(table, digest: bool):
    def run(batches):
        for batch in batches:
            for part, block, _, names, sizes, payload in zip(*(batch.column(c).to_pylist() for c in range(6))):
                ids = rans.decode(payload, table.value).astype("<u4")
                first = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.uint64))]).astype(np.int64)
                n = len(first) - 1
                own = pa.nulls(n, pa.int64()) if names is None else pa.array(np.frombuffer(names, np.int64))
                if digest:
                    raw = memoryview(ids).cast("B")
                    last = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, block, np.int32)), own,
                    pa.array(first[:-1]), pa.array(np.diff(first)), last],
                    ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_ids(spark: SparkSession, target: str, digest: bool = False) -> DataFrame:
    """Documents of a data set: doc_id, start (ids before it), n_tokens and ids.

    ``digest`` gives ids_crc32 instead of the ids. Every block is checked against its checksum.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(f"{target}/blocks")
    docs = arrow_map(blocks, _decode(spark.sparkContext.broadcast(read_table(spark, target)), digest),
                     "part int, block int, doc_id long, at long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))
    starts = running_total(blocks.select("part", "block", "n_ids"), [], F.col("part"), "block", F.col("n_ids"), "upto").select(
        "part", "block", (F.col("upto") - F.col("n_ids")).alias("_before"))
    return docs.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", docs.columns[-1])


def new_folder(spark: SparkSession) -> str:
    return shared_dir(spark, "id-files")
