import numpy as np
import pytest

from provisor.llm import subspace
from provisor.llm.subspace import borders, near_vectors, places, rotated


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, x, 1, 2, "x") for i, x in rows], f"vec_id long, embedding array<{kind}>, id int, times int, root string").repartition(3)


def brute(rows, least=0.95):
    good = [(k, i, np.array(x, float)) for k, (i, x) in enumerate(rows) if i is not None and x and None not in x and np.isfinite(np.array(x, float)).all() and any(x)]
    near = {k: set() for k in range(len(rows))}
    for n, (k, _, x) in enumerate(good):
        for m, _, y in good[:n]:
            if len(x) == len(y) and (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()) >= least:
                near[k].add(m)
                near[m].add(k)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        low = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((i, len(near[k]), low, i == low))
    return sorted(out, key=str)


def cloud(dim, n=500, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for k in range(60):  # pairs and chains around the threshold, and a family
        base[n // 2 + k] = base[k] + rng.normal(size=dim) * rng.uniform(0, 0.5)
        base[n // 2 + 60 + k] = base[n // 2 + k] + rng.normal(size=dim) * 0.2
        base[n // 4 + k] = base[n - 1] + rng.normal(size=dim) * 0.12
    return base.astype(np.float32).astype(float)


@pytest.mark.parametrize("dim", [64, 24, 3])
def test_links_match_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(subspace, "CELL", 100)
    monkeypatch.setattr(subspace, "VISITORS", 300)
    rows = [(i * 2, x.tolist()) for i, x in enumerate(cloud(dim))]
    rows += [(1001 + i, rows[4][1]) for i in range(30)] + [rows[9], (rows[9][0], rows[300][1])]
    odd = [(3000, None), (3001, [0.0] * dim), (3002, [None] + [1.0] * (dim - 1)), (3003, [float("nan")] * dim), (3004, [float("inf")] * dim), (3005, []),
           (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (None, rows[4][1]), (None, None)]
    got = near_vectors(table(spark, rows + odd))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows + odd)


def test_doubles_and_few_vectors(spark):
    assert near_vectors(table(spark, [])).collect() == []
    rows = [(5, [1.0, 0.0]), (3, [0.999, 0.04]), (4, [0.0, 1.0])]
    assert {tuple(r) for r in near_vectors(table(spark, rows, "double")).collect()} == {(5, 1, 3, False), (3, 1, 3, True), (4, 0, 4, True)}


def test_rotation_keeps_distances_and_cells_cover_the_radius():
    x = cloud(20)
    turned, unit = rotated(x), x / np.linalg.norm(x, axis=1)[:, None]
    assert np.allclose(turned @ turned.T, unit @ unit.T)
    points, budget = turned[:, :subspace.DIMS], 0.02
    cells = borders(points[:200], 16)
    row, cell, home = places(points, cells, budget)
    assert sorted(row[home]) == list(range(len(points)))
    seen, own = set(zip(row, cell)), dict(zip(row[home], cell[home]))
    far = ((points[:, None] - points[None]) ** 2).sum(2)
    assert all((i, own[j]) in seen for i, j in zip(*np.nonzero(far <= budget)))
