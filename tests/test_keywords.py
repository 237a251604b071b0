import random

import pytest

from provisor.operators import keywords as module
from provisor.operators.keywords import close_words, first_keywords


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def words(seed, n, longest=9):
    rng = random.Random(seed)
    return ["".join(rng.choice("абв") for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("few", [0, 1000])
def test_pairs_equal_brute_force_with_and_without_index(spark, monkeypatch, few):
    monkeypatch.setattr(module, "FEW", few)
    test_pairs_equal_brute_force(spark)


def test_few_keywords_list_no_remainders_and_move_no_placed_word(spark):
    placed = spark.createDataFrame([(i, 0, f"состав{i % 7}") for i in range(50)], "doc_id int, place int, word string")
    keys = spark.createDataFrame([("состав", 2), ("содержит", 3)], "keyword string, bound int")
    assert "flatten" not in close_words(placed, keys)._jdf.queryExecution().optimizedPlan().toString()
    plan = first_keywords(placed, keys)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_pairs_equal_brute_force(spark):
    some, rng = words(1, 150), random.Random(2)
    keys = [(k, rng.randint(0, 3)) for k in sorted(set(words(3, 25)))]
    table = spark.createDataFrame([(w, 1) for w in some + some[:9] + [None]], "word string, keyword int")
    got = close_words(table, spark.createDataFrame(keys + [(None, 2), ("а", None)], "keyword string, bound int")).collect()
    want = {(w, k, edits(w, k)) for w in some for k, b in keys if edits(w, k) <= b}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_earliest_word_wins_then_the_nearest_keyword(spark):
    placed = spark.createDataFrame(
        [(1, 0, "zzzzzz"), (1, 1, "сaстав"), (1, 2, "состав"), (2, 5, "составы"), (2, 9, "может"), (3, 0, "прочее"), (4, 0, None)], "doc_id int, place int, word string")
    keys = spark.createDataFrame([("состав", 2), ("составы", 2), ("может", 2)], "keyword string, bound int")
    got = {tuple(r) for r in first_keywords(placed, keys).collect()}
    assert got == {(1, 1, "сaстав", "состав", edits("сaстав", "состав")), (2, 5, "составы", "составы", 0)}
    assert first_keywords(placed.limit(0), keys).count() == 0 and first_keywords(placed, keys.limit(0)).count() == 0
