"""Exact join of embedding vectors whose cosine is at least a threshold, by subspace pigeonholes.

Two unit vectors with cosine c are sqrt(2 - 2c) apart, and a rotation keeps that. The rotated
vectors (random signs, then a Walsh-Hadamard butterfly: only sums and differences, so a vector's
coordinates are the same in every task) are split into blocks of ``DIMS`` coordinates. If a pair
is near enough, at least one block's squared distance is within the block's proportional share of
the squared budget. Each block is range-joined by itself: its space is cut into k-d cells, a
vector lives in one cell and visits every cell within the block's radius, and a cell compares its
residents, in k-d leaves of their own, with the visitors that come near a leaf. What a block lets through is checked by the cosine of the original
vectors, in double precision. A pair that several blocks find counts in the first of them only, so
links are counted without being written: a task returns a count per resident and a spanning forest
of its links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provisor.llm.common import arrow_map, components
from provisor.session import cut_lineage, ship

#: Coordinates of a block, and vectors that a cell is meant to hold.
DIMS, CELL = 8, 16_384
#: Vectors of the sample that places the cells' borders, and cells of a block at most: 4 MB of borders.
#: Both only steer where a pair meets, never whether.
SAMPLE, CELLS = 20_000, 2_048
#: Visitors that share one copy of a cell's residents, about.
VISITORS = 1 << 18
#: Residents of a leaf inside a cell, cells or leaves that are measured at once, and pairs that are checked at once.
LEAF, TILE, PAIRS = 256, 1 << 20, 1 << 14
#: What a block lets through beyond its share, and what the first look in single precision adds; rounding is far below.
SLACK, ROUGH = 1e-9, 1e-5


def rotated(vectors: np.ndarray, seed: int = 7) -> np.ndarray:
    """Unit vectors, turned; coordinates are padded with zeros to a power of two and to whole blocks."""
    norm = np.sqrt((vectors * vectors).sum(1))[:, None]
    wide = max(DIMS, 1 << max(0, vectors.shape[1] - 1).bit_length())
    out = np.zeros((len(vectors), wide))
    out[:, :vectors.shape[1]] = vectors / norm
    out *= np.random.default_rng(seed).choice([-1.0, 1.0], wide)
    half = 1
    while half < wide:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(out), wide)
        half *= 2
    return out / np.sqrt(wide)


def borders(points: np.ndarray, cells: int) -> np.ndarray:
    """k-d cells of a block: (cells, DIMS, 2) lower and upper borders, by medians along the widest coordinate."""
    box = np.stack([np.full(DIMS, -np.inf), np.full(DIMS, np.inf)], 1)
    parts = [(points, box)]
    while len(parts) < cells:
        halves = []
        for own, limits in parts:
            at = int((own.max(0) - own.min(0)).argmax()) if len(own) else 0
            cut = float(np.median(own[:, at])) if len(own) else 0.0
            cut = min(max(cut, limits[at, 0]), limits[at, 1])
            low, high = limits.copy(), limits.copy()
            low[at, 1] = high[at, 0] = cut
            halves += [(own[own[:, at] < cut], low), (own[own[:, at] >= cut], high)]
        parts = halves
    return np.array([limits for _, limits in parts])


def places(points: np.ndarray, cells: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) for the cell of every point and for each further cell within the budget."""
    rows, found, homes = [], [], []
    step = max(1, TILE // len(cells))
    for i in range(0, len(points), step):
        part = points[i:i + step]
        far = np.zeros((len(part), len(cells)))
        inside = np.ones((len(part), len(cells)), bool)
        for d in range(DIMS):
            x, low, high = part[:, d, None], cells[None, :, d, 0], cells[None, :, d, 1]
            far += np.square(np.maximum(np.maximum(low - x, x - high), 0.0))
            inside &= (x >= low) & ((x < high) | (high == np.inf))
        row, cell = np.nonzero(inside | (far <= budget + SLACK))
        rows.append(row + i)
        found.append(cell)
        homes.append(inside[row, cell])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(homes)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _dealt(model, dim: int, budget: float, parts: int):
    """(id, times, embedding) -> a row per block and cell: residents once for each part, visitors in their part."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                piece = batch.slice(lo, 1024)
                turned = rotated(_matrix(piece.column("embedding"), dim))
                part = piece.column("id").to_numpy() % parts
                for b, cells in enumerate(model.value):
                    row, cell, home = places(turned[:, b * DIMS:(b + 1) * DIMS], cells, budget)
                    own = np.flatnonzero(home)
                    out = np.concatenate([np.repeat(own, parts), np.flatnonzero(~home)])
                    to = np.concatenate([np.tile(np.arange(parts), len(own)), part[row[~home]]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(out), b, np.int32)), pa.array(cell[out].astype(np.int32)), pa.array(to.astype(np.int32)),
                         pa.array((~home[out]).astype(np.int32)), piece.column("id").take(row[out]), piece.column("times").take(row[out]),
                         piece.column("embedding").take(row[out])], ["block", "cell", "part", "visits", "id", "times", "embedding"])

    return run


def _merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give both ends of every link the smaller label, down to the roots."""
    while True:
        a, b = label[x], label[y]
        open_ = a != b
        if not open_.any():
            return
        low = np.minimum(a, b)[open_]
        np.minimum.at(label, a[open_], low)
        np.minimum.at(label, b[open_], low)
        while True:
            deeper = label[label]
            if (deeper == label).all():
                break
            label[:] = deeper


class _Cell:
    """The residents of one cell and what has been found about them."""

    def __init__(self, block: int, part: int, budget: float, least: float, dim: int):
        self.block, self.part, self.budget, self.least, self.dim = block, part, budget, least, dim
        self.ids, self.times, self.raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim))
        self.turned = np.zeros((0, 1))
        self.ready = None  # links inside the cell, once the residents are complete

    def settle(self, batch: pa.RecordBatch) -> None:
        raw = _matrix(batch.column("embedding"), self.dim)
        turned = rotated(raw)
        self.turned = np.concatenate([self.turned, turned]) if len(self.ids) else turned
        self.ids, self.raw = np.concatenate([self.ids, batch.column("id").to_numpy()]), np.concatenate([self.raw, raw])
        self.times = np.concatenate([self.times, batch.column("times").to_numpy()])

    def _open(self) -> None:
        """Cut the residents into k-d leaves of their own and put them in that order."""
        points = self.turned[:, self.block * DIMS:(self.block + 1) * DIMS]
        self.leaves = borders(points, 1 << max(0, -(-len(points) // LEAF) - 1).bit_length())
        row, leaf, home = places(points, self.leaves, -1.0)
        order = row[home][np.argsort(leaf[home], kind="stable")]
        self.cuts = np.searchsorted(np.sort(leaf[home]), np.arange(len(self.leaves) + 1))
        self.ids, self.times, self.raw, self.turned = (x[order] for x in (self.ids, self.times, self.raw, self.turned))
        points = points[order]
        self.rough = np.concatenate([-2 * points, np.square(points).sum(1)[:, None], np.ones((len(points), 1))], 1).astype(np.float32).T
        self.ready, self.found = np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64)

    def links(self, raw, turned, first):
        """Index pairs (visitor, resident) that link in this block first, leaf by leaf."""
        x = turned[:, self.block * DIMS:(self.block + 1) * DIMS]
        rough = np.concatenate([x, np.ones((len(x), 1)), np.square(x).sum(1)[:, None]], 1).astype(np.float32)
        row, leaf, _ = places(x, self.leaves, self.budget)
        order = np.argsort(leaf, kind="stable")
        row, starts = row[order], np.searchsorted(leaf[order], np.arange(len(self.leaves) + 1))
        for k in range(len(self.leaves)):
            near = row[starts[k]:starts[k + 1]]
            if not len(near) or self.cuts[k] == self.cuts[k + 1]:
                continue
            vs, rs = np.nonzero(rough[near] @ self.rough[:, self.cuts[k]:self.cuts[k + 1]] <= np.float32(self.budget + ROUGH))
            vs, rs = near[vs], rs + self.cuts[k]
            for i in range(0, len(vs), PAIRS):
                v, r = vs[i:i + PAIRS], rs[i:i + PAIRS]
                cosine = (raw[v] * self.raw[r]).sum(1) / np.sqrt(np.square(raw[v]).sum(1) * np.square(self.raw[r]).sum(1))
                ok = (cosine >= self.least) & (first[v] != self.ids[r])
                v, r = v[ok], r[ok]
                apart = np.square(turned[v] - self.turned[r]).reshape(len(v), turned.shape[1] // DIMS, DIMS).sum(2) <= self.budget + SLACK
                own = apart.any(1) & (apart.argmax(1) == self.block)
                yield v[own], r[own]

    def meet(self, ids, times, raw, turned):
        """Compare visitors with all residents; links of theirs to the first resident they meet."""
        if self.ready is None:
            self._open()
        for lo in range(0, len(ids), 2048):
            one = slice(lo, lo + 2048)
            met = np.full(len(ids[one]), -1)
            for v, r in self.links(raw[one], turned[one], ids[one]):
                np.add.at(self.found, r, times[one][v])
                order = np.argsort(v, kind="stable")
                v, r = v[order], r[order]
                starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
                fresh = met[v[starts]] < 0
                met[v[starts[fresh]]] = r[starts[fresh]]
                _merge(self.ready, r, met[v])
            yield ids[one][met >= 0], self.ids[met[met >= 0]]

    def close(self):
        """(id, links) of the residents, and their links to their roots."""
        if self.ready is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero((self.found > 0) | (self.ready != np.arange(len(self.ids))))
        return self.ids[some], self.found[some], self.ids[self.ready[some]]


def _told(a, b, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])


def _joined(dim: int, budget: float, least: float, parts: int):
    """Rows in order of (block, cell, part, visits) -> links (a, b) of a spanning forest, and ``n`` links of ``a``."""

    def close(cell):
        if cell.ready is None and len(cell.ids):
            cell._open()  # the order of residents is settled before they are taken as visitors
        own = np.flatnonzero(cell.ids % parts == cell.part)
        for lo in range(0, len(own), 2048):  # residents also visit each other, each in its part
            part = own[lo:lo + 2048]
            for a, b in cell.meet(cell.ids[part], cell.times[part], cell.raw[part], cell.turned[part]):
                yield _told(a, b, np.zeros(len(a)))
        a, n, b = cell.close()
        yield _told(a, b, n)

    def run(batches):
        name, cell = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "cell", "part", "visits")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
                if hi <= lo:
                    continue
                now, piece = tuple(keys[lo, :3]), batch.slice(lo, hi - lo)
                if now != name:
                    if cell is not None:
                        yield from close(cell)
                    name, cell = now, _Cell(int(now[0]), int(now[2]), budget, least, dim)
                if not keys[lo, 3]:
                    cell.settle(piece)
                    continue
                raw = _matrix(piece.column("embedding"), dim)
                for a, b in cell.meet(piece.column("id").to_numpy(), piece.column("times").to_numpy(), raw, rotated(raw)):
                    yield _told(a, b, np.zeros(len(a)))
        if cell is not None:
            yield from close(cell)

    return run


def _of_length(rows: DataFrame, dim: int, least: float) -> DataFrame:
    """Links (a, b, n) of the different vectors of one length, ``rows(id, times, embedding)``."""
    spark = rows.sparkSession
    n = rows.count()
    wide = max(DIMS, 1 << max(0, dim - 1).bit_length())
    budget = max(0.0, 2 - 2 * least) * DIMS / wide
    cells = 1 << max(0, -(-n // CELL) - 1).bit_length()
    cells = min(cells, CELLS)
    # A vector stays in a sample of bounded size with a probability that its own hash decides.
    keep = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, n)))
    sample = rows.where(keep).select("embedding").limit(2 * SAMPLE).toPandas()["embedding"].tolist()
    turned = rotated(np.array(sample, np.float64).reshape(-1, dim))
    model = spark.sparkContext.broadcast([borders(turned[:, b:b + DIMS], cells) for b in range(0, wide, DIMS)])
    parts = max(1, -(-n // VISITORS))
    kind = rows.schema["embedding"].dataType.simpleString()
    dealt = arrow_map(rows, _dealt(model, dim, budget, parts), f"block int, cell int, part int, visits int, id long, times long, embedding {kind}")
    place = ["block", "cell", "part"]
    ordered = dealt.repartition(*place).sortWithinPartitions(*place, "visits")
    return cut_lineage(arrow_map(ordered, _joined(dim, budget, least, parts), "a long, b long, n long"), "near-vectors")


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors(vec_id, embedding)``.

    Vectors link at a cosine of at least ``least``, in double precision. n_links counts the rows
    that a row is linked with directly, component_id is the smallest vec_id that links reach, and
    kept says whether it is the row's own. Vectors that are null, zero or empty, or hold null or
    non-finite components, link with nothing, nor do vectors of different lengths. A row without
    vec_id links with nothing, has no component and is kept. Equal vectors are compared once and
    count as often as they stand there; rows that share a vec_id have a row each. An empty table
    gives none. Other columns are ignored.

    Only the lengths that occur, row counts and the sample of at most ``2 * SAMPLE`` vectors per
    length reach the driver. Vectors that are all near each other are compared pair by pair where
    they meet, without writing the pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    infinite = F.lit(float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("id", F.when(sound, F.xxhash64("embedding")))
    rows = cut_lineage(rows, "vectors")
    class_ = rows.where("id is not null").groupBy("id", "embedding").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"))
    class_ = cut_lineage(class_, "classes")
    links = None
    for (dim,) in sorted(class_.select(F.size("embedding")).distinct().collect()):
        told = _of_length(class_.where(F.size("embedding") == dim).select("id", "times", "embedding"), dim, least)
        links = told if links is None else links.unionAll(told)
    if links is None:
        links = spark.createDataFrame([], "a long, b long, n long")
    counted = links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(links.select("a", "b"))
    named = class_.select("id", "times", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = cut_lineage(named.join(counted, "id", "left").select(
        "id", "root", "least", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "named")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Components that other classes reach; a class that stands alone keeps its own smallest id.
    known = named.join(lowest, "root").select("id", "n_links", "component_id")
    return rows.join(known, "id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
