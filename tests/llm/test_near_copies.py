import random

from provisor.llm.fingerprints import edited_fingerprints
from tests.llm.helpers import corpus, frame, row, shingles


def expected(rows, percent=80):
    texts = {r[1] or "": shingles(r[1], 5) for r in rows}
    parent, names = {t: t for t in texts}, list(texts)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if texts[a] and texts[b] and 100 * len(texts[a] & texts[b]) >= percent * len(texts[a] | texts[b]):
                parent[find(a)] = find(b)
    least = {}
    for r in rows:
        if r[0] is not None:
            least[find(r[1] or "")] = min(least.get(find(r[1] or ""), r[0]), r[0])
    return sorted(((r[0], len(r[1] or ""), least.get(find(r[1] or ""))) for r in rows), key=str)


def test_components_of_texts_that_are_not_neighbours(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    near = []
    for i in range(12):  # near copies, each far from the next
        words = list(base)
        words[rng.randrange(200)] = f"edit{i}"
        near.append(row(1000 + 40 * i, " ".join(words)))
        near.append(row(1001 + 40 * i, " ".join(f"u{i}x{j}" for j in range(50))))
    rows = corpus() + near + [row(None, " ".join(base)), row(None, "alone, without an id")]
    got = edited_fingerprints(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.component_id) for r in got), key=str) == expected(rows)
    assert {r.component_id for r in got if r.doc_id in range(1000, 1480, 40)} == {1000}


def test_texts_that_link_in_chains(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [row(1000 - i, " ".join(base[4 * i:4 * i + 120])) for i in range(40)]
    got = edited_fingerprints(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.component_id) for r in got), key=str) == expected(rows)
