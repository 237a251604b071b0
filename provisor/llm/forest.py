"""Approximate nearest neighbours with a hash-prefix forest.

Each tree gives a vector a string of ``BITS`` bits, the sides of random hyperplanes through the
medians of a bounded sample. A query descends every tree to its longest matching prefix and then
ascends all trees together, one bit at a time, until they hold ``share`` of the index between
them (counts per prefix of up to ``LEVELS`` bits, a table of fixed size). All vectors with those
prefixes are candidates: no limit cuts them. Every block of the index keeps one sorted array of
strings per tree; candidates are ranges of them, and are compared by exact distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from provisor.llm.common import arrow_map, summed
from provisor.session import cut_lineage, ship

TREES, BITS, LEVELS = 64, 48, 12
#: Vectors of the sample that places the hyperplanes.
SAMPLE = 2_000
#: Vectors of a block of the index, and queries that meet a block at once.
BLOCK, QUERIES = 4_096, 8_192


def planes(sample: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    normal = np.random.default_rng(seed).normal(size=(sample.shape[1], TREES * BITS))
    return normal, np.median(sample @ normal, axis=0)


def strings(vectors: np.ndarray, model) -> np.ndarray:
    """(n, TREES) bit strings, first bit highest."""
    normal, middle = model
    out = np.empty((len(vectors), TREES), np.int64)
    weight = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for i in range(0, len(vectors), 1024):
        bits = (vectors[i:i + 1024] @ normal > middle).reshape(-1, TREES, BITS)
        out[i:i + 1024] = bits @ weight
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _counts(model, dim: int):
    def run(batches):
        total = np.zeros((TREES, 1 << LEVELS), np.int64)
        for batch in batches:
            top = strings(_matrix(batch.column(0), dim), model.value) >> (BITS - LEVELS)
            for t in range(TREES):
                total[t] += np.bincount(top[:, t], minlength=1 << LEVELS)
        yield pa.RecordBatch.from_arrays([
            pa.array(range(TREES), pa.int32()), pa.array([TaskContext.get().partitionId()] * TREES, pa.int32()),
            pa.array([x.tobytes() for x in total], pa.binary())], ["tree", "part", "counts"])

    return run


def depths(own: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """Common prefix length of each query: the longest at which all trees hold ``least`` vectors."""
    out = np.zeros(len(own), np.int64)
    level = counts
    for depth in range(LEVELS, 0, -1):
        held = sum(level[t][own[:, t] >> (BITS - depth)] for t in range(TREES))
        out = np.where((out == 0) & (held >= least), depth, out)
        level = level.reshape(TREES, -1, 2).sum(2)
    return out


def _search(model, counts, dim: int, least: int, keep: int):
    """One block of the index against one block of queries -> each query's nearest of the block."""

    def run(_, index: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query": [], "rep": [], "score": []}
        if len(index) and len(asked):
            points, queries = (_matrix(x.column("embedding").combine_chunks(), dim) for x in (index, asked))
            ids, names = index.column("rep").to_numpy(), asked.column("rep").to_numpy()
            first = index.column("first").to_numpy()
            own, want = strings(points, model.value), strings(queries, model.value)
            depth = depths(want, counts.value, least)
            order = np.argsort(own, axis=0)
            ranked = np.take_along_axis(own, order, axis=0)
            low = (want >> (BITS - depth)[:, None]) << (BITS - depth)[:, None]
            high = low + (np.int64(1) << (BITS - depth))[:, None]
            lo = np.stack([np.searchsorted(ranked[:, t], low[:, t]) for t in range(TREES)], 1)
            hi = np.stack([np.searchsorted(ranked[:, t], high[:, t]) for t in range(TREES)], 1)
            for q in range(len(queries)):
                hit = np.zeros(len(ids), bool)
                for t in range(TREES):
                    hit[order[lo[q, t]:hi[q, t], t]] = True
                found = np.flatnonzero(hit)
                score = np.sqrt(((points[found] - queries[q]) ** 2).sum(1))
                best = np.lexsort((first[found], score))[:keep]
                out["query"] += [names[q]] * len(best)
                out["rep"] += ids[found][best].tolist()
                out["score"] += score[best].tolist()
        return pa.table({"query": pa.array(out["query"], pa.int64()), "rep": pa.array(out["rep"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = 0.5, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest found for every row of ``queries``.

    Both tables have vec_id and embedding. Nearness is the Euclidean distance in double precision,
    ties go to the smaller vec_id, and a query never finds its own id. Rows whose id or vector is
    null, or whose vector is zero, has null or non-finite components or another length than most
    vectors, take no part. A row that is there twice counts once. Fewer candidates than ``k``
    give fewer rows; an empty table gives none. Other columns are ignored.

    Equal vectors are searched once: only the ``k + 1`` smallest ids of each can be among anyone's
    nearest. Only the sample, the prefix counts and the vector length reach the driver.
    """
    spark = vectors.sparkSession
    ship(spark)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(
        "embedding", lambda x: x != 0)

    def valid(df):
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
            F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)

    lengths = valid(vectors).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    dim = lengths["n"]
    rows = valid(vectors).where(F.size("embedding") == dim)
    ranked = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("_nth", F.dense_rank().over(ranked)).where(F.col("_nth") <= k + 1).select("vec_id", "embedding").distinct()
    index = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = cut_lineage(index.withColumn("rep", F.xxhash64("embedding")), "index")
    asked = valid(queries).where(F.size("embedding") == dim).distinct()
    asked = cut_lineage(asked.withColumn("rep", F.xxhash64("embedding")), "queries")

    sample = index.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    model = spark.sparkContext.broadcast(planes(np.array(sample.tolist(), np.float64), seed))
    told = summed(arrow_map(index.select("embedding"), _counts(model, dim), "tree int, part int, counts binary"), "tree").collect()
    counts = np.zeros((TREES, 1 << LEVELS), np.int64)
    for r in told:
        counts[r["tree"]] = np.frombuffer(r["counts"], np.int64)
    n = int(counts[0].sum())
    least = max(int(np.ceil(share * n)), TREES * (k + 6))
    sides = {"index": max(1, -(-n // BLOCK)), "asked": max(1, -(-asked.count() // QUERIES))}

    def blocks(df, own, other, columns):
        other_block = F.explode(F.sequence(F.lit(0), F.lit(sides[other] - 1))).alias(other)
        return df.select(F.pmod("rep", F.lit(sides[own])).cast("int").alias(own), *columns).select("*", other_block)

    left = blocks(index, "index", "asked", ["rep", F.array_min("ids").alias("first"), "embedding"])
    right = blocks(asked.select("rep", "embedding").distinct(), "asked", "index", ["rep", "embedding"])
    found = left.groupBy("index", "asked").cogroup(right.groupBy("index", "asked")).applyInArrow(
        _search(model, spark.sparkContext.broadcast(counts), dim, least, k + 1), "query long, rep long, score double")
    spread = found.join(index.select("rep", F.explode("ids").alias("vec_id")), "rep").select("query", "vec_id", "score")
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    short = cut_lineage(spread.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= k + 1).drop("_nth"), "nearest")
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")).join(short, "query").where("query_id <> vec_id")
    best = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
