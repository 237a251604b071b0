import numpy as np

from provisor.llm.forest import nearest


def brute(rows, queries, k):
    out = set()
    for q, x in queries:
        found = sorted({(float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y in rows if i != q})[:k]
        out |= {(q, n + 1, i) for n, (_, i) in enumerate(found)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2.0) for i, x in rows], "vec_id long, embedding array<float>, label int, score double").repartition(4)


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 6)]) for i in range(90)]
    rows = [(i, x) for i, x in rows if any(x)] + [(200 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(40)] + [rows[5]]
    bad = [(300, None), (301, [0.0] * 6), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] + [1.0] * 5), (304, [float("inf")] + [1.0] * 5),
           (305, [1.0, 2.0]), (None, [1.0] * 6)]
    queries = [r for r in rows if r[0] % 10 == 0]
    got = nearest(table(spark, rows + bad), table(spark, queries + bad), 10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {(r.query_id, r["rank"], r.vec_id) for r in got.collect()} == brute(rows, queries, 10)


def test_recall_of_a_larger_table(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(vectors)]
    queries = rows[::100]
    found = {(r.query_id, r.vec_id) for r in nearest(table(spark, rows), table(spark, queries), 10).collect()}
    want = {(q, i) for q, _, i in brute(rows, queries, 10)}
    assert len(found & want) >= 0.9 * len(want)


def test_few_or_no_vectors(spark):
    assert nearest(table(spark, []), table(spark, [])).collect() == []
    few = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    assert {(r.query_id, r["rank"], r.vec_id) for r in nearest(table(spark, few), table(spark, few[:1])).collect()} == {(0, 1, 2), (0, 2, 1)}
