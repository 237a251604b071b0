import numpy as np
import pyarrow as pa

from provisor.llm.jaccard import GROUPS, _need, _tree_join, search, similar_sets, tree
from tests.llm.helpers import SCHEMA, corpus, frame, row, shingles


def expected(rows, k, percent, lower):
    fold = (lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if lower else (lambda t: t)
    sets = [shingles(fold(r[1]), k) for r in rows]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[y] = x
    return sorted(((r[0], len(s), None if r[0] is None else find(r[0])) for r, s in zip(rows, sets)), key=str)


def check(spark, rows, k, percent, lower):
    assert sorted(map(tuple, similar_sets(frame(spark, rows), k, percent, lower).collect()), key=str) == expected(rows, k, percent, lower)


def test_components_match_brute_force(spark):
    rows = corpus() + [row(None, corpus()[3][1]), row(9, corpus()[2][1]), row(600, "THE end"), row(601, "the END")]
    check(spark, rows, 4, 85, True)
    check(spark, rows, 5, 80, False)


def test_family_whose_members_link_in_chains(spark):
    """Neighbours are linked, members far apart are not; no star can settle it alone."""
    base = [f"w{i}" for i in range(400)]
    rows = [row(1000 - i, " ".join(base[4 * i:4 * i + 120])) for i in range(60)]
    rows += [row(2000 + i, " ".join(base[:60]) + " " + " ".join(f"u{i}x{j}" for j in range(60))) for i in range(50)]
    check(spark, rows, 4, 85, True)


def test_empty_table(spark):
    assert similar_sets(spark.createDataFrame([], SCHEMA)).collect() == []


def unlinked(n=900, seed=8):
    """Points of sets: overlapping families, none of which is closer than it seems."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 3, (12, GROUPS))
    points = np.array([np.where(rng.random(GROUPS) < 0.15, rng.integers(0, 3, GROUPS), base[i % 12]) for i in range(n)])
    return points, points.sum(1)


def test_tree_finds_all_points_within_the_bound():
    points, size = unlinked()
    order, levels = tree(points, size)
    for q in range(0, 900, 37):
        got = set(search(order, levels, points, size, points[q], int(size[q]), 80).tolist())
        assert got == set(np.flatnonzero(np.minimum(points, points[q]).sum(1) >= _need(int(size[q]), size, 80)).tolist())


def test_queries_of_a_bucket_meet_its_trees():
    points, size = unlinked(300)
    roots = np.arange(300) // 2

    def table(bucket, rows, side):
        same = lambda v, kind=pa.int32(): pa.array([v] * len(rows), kind)
        packed = [bytes([8]) + points[i].astype("u1").tobytes() for i in rows]
        return pa.table({"bucket": same(bucket, pa.int64()), "block": same(0), "part": same(0), "side": same(side), "id": pa.array(rows), "root": pa.array(roots[rows]),
                         "n": pa.array(size[rows]), "inner": pa.array([True] * len(rows)), "point": pa.array(packed, pa.binary())})

    def want(left, right):
        return {(min(i, j), max(i, j)) for i in left for j in right if roots[i] != roots[j]
                and np.minimum(points[i], points[j]).sum() >= _need(int(size[i]), int(size[j]), 80)}

    low, high = list(range(150)), list(range(150, 300))
    found = _tree_join(80)(pa.concat_tables([table(7, high, 1), table(7, low, 0), table(9, low[:40], 1), table(9, low[:60], 0), table(11, high[:5], 1)]))
    assert set(zip(found.column("a").to_pylist(), found.column("b").to_pylist())) == want(low, high) | want(low[:60], low[:40])


def test_a_bucket_that_stars_leave_open_goes_to_the_trees(spark, monkeypatch):
    from provisor.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 16)
    base = [f"w{i}" for i in range(60)]
    rows = [row(i, " ".join(base + [f"u{i // 3}x{j}" for j in range(40)])) for i in range(120)]
    rows += [row(500 + i, " ".join(base[:50] + [f"v{i // 2}x{j}" for j in range(40)] + [f"t{i}"])) for i in range(60)]
    check(spark, rows, 4, 85, True)
