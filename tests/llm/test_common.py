import random

from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from provisor.llm.common import components, key_bits, link_groups, marks, maybe_in, semi_join


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 230)] + [(300, i) for i in range(260, 290)]
    noise = [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    edges = chain + star + noise + chain[:5]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_bitmap_never_loses_a_key(spark):
    keys = spark.range(0, 4000, 3).withColumnRenamed("id", "k")
    rows = spark.range(4000).withColumnRenamed("id", "k")
    marked = maybe_in(rows, rows["k"], key_bits(keys, "k"), "hit")
    assert marked.where("k % 3 = 0 and not hit").isEmpty()
    assert marked.where("hit").count() < 1500 and semi_join(rows, keys, "k").count() == keys.count()


def linked(spark, sets, buckets, percent=80):
    """Components by ``link_groups`` with an exact test, and the pairs that were tested in all."""
    rows = spark.createDataFrame([(b, i, len(sets[i]), True, float(i % 7)) for b, ids in buckets.items() for i in ids],
                                 "bucket long, id long, n long, inner boolean, rank double")
    members = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, x long").withColumn("x", F.xxhash64("x"))
    tested = []

    def test(pairs):
        asked = [(r.a, r.b) for r in pairs.collect()]
        tested.extend(asked)
        good = [(a, b) for a, b in asked if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        return spark.createDataFrame(good, "a long, b long")

    roots = link_groups(rows, test, percent, marked=lambda ids: marks(members.join(ids, "id")))
    return {r.id: r.root for r in roots.collect()}, tested


def test_pairs_of_one_bucket_grow_in_proportion(spark):
    """A bucket of ids of which none links, a family in chains, and one of copies: no bucket gives all its pairs."""
    tested = []
    for n in (100, 200, 400):
        alone = {i: set(range(50 * i, 50 * i + 50)) for i in range(n)}
        chain = {n + i: set(range(10**6 + 3 * i, 10**6 + 3 * i + 60)) for i in range(n // 4)}
        copies = {2 * n + i: set(range(2 * 10**6, 2 * 10**6 + 50)) | {3 * 10**6 + i} for i in range(n // 4)}
        sets = {**alone, **chain, **copies}
        roots, pairs = linked(spark, sets, {1: list(sets), 2: list(chain), 3: [n, 0]})
        assert roots == {**{i: n for i in chain}, **{i: 2 * n for i in copies}}
        tested.append(len(pairs))
    assert tested[1] < 3 * tested[0] and tested[2] < 3 * tested[1]


def test_every_pair_of_a_bucket_that_may_link_is_tested(spark):
    rng = random.Random(4)
    sets = {i: set(rng.sample(range(70), rng.randint(35, 60))) for i in range(120)}
    roots, _ = linked(spark, sets, {1: list(sets)}, 65)
    want = brute([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 65 * len(sets[a] | sets[b])])
    assert roots == want
