import hashlib

from provisor.llm.substrings import remove_repeats
from tests.llm.helpers import SCHEMA, corpus, frame, row, words


def expected(rows, k):
    first = {}
    for r in rows:
        if r[0] is not None:
            w = words(r[1])
            for i in range(len(w) - k + 1):
                key = tuple(w[i:i + k])
                first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for i in range(len(w) - k + 1):
            if r[0] is not None and first[tuple(w[i:i + k])] < r[0]:
                gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats_match_brute_force(spark):
    rows = corpus() + [row(None, corpus()[1][1]), row(-5, corpus()[13][1])]
    got = remove_repeats(frame(spark, rows), 13, text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, 13)


def test_intervals_are_maximal_and_text_is_kept(spark):
    a = " ".join(f"a{i}" for i in range(10))
    rows = [row(1, a), row(2, "p q " + a + " r " + a)]
    got = {r.doc_id: r for r in remove_repeats(frame(spark, rows), 4).collect()}
    assert [tuple(x) for x in got[2].removed] == [(2, 12), (13, 23)] and got[2].kept == "p q r"
    assert got[1].removed == [] and got[1].kept == a


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA), 13).collect() == []
