import math
import random
import re

import numpy as np
import pytest

from provisor.llm import lexical
from provisor.llm.lexical import Best, ItemTree, best_documents, search
from tests.llm.helpers import SCHEMA, corpus, frame, row

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    docs = [(r[0], terms(r[1])) for r in docs]
    docs = [d for d in docs if d[1]]
    n, length = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, own in docs:
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(items):
        scored = []
        for doc_id, own in docs:
            m = 100 - 25 + 25 * len(own) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * own.count(t) // (1000 * own.count(t) + 12 * m))
                        for t in terms(text) if t in own)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def asked(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, rank string, key int").repartition(3)


@pytest.mark.parametrize("items_a_block", [2_048, 3])
def test_ranks_match_brute_force(spark, monkeypatch, items_a_block):
    monkeypatch.setattr(lexical, "ITEMS", items_a_block)
    monkeypatch.setattr(lexical, "DENSE", 20_000)
    rng = random.Random(5)
    docs = corpus(n=240) + [row(900 + i, "Zebra-ÄZebra x1 _X1_ zebra") for i in range(40)] + [row(None, "zebra zebra x1"), row(None, None), row(990, "\x00\x7f,")]
    vocabulary = sorted({t for r in docs for t in terms(r[1])})
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25)))) for i in range(20)]
    items += [(50, "ZEBRA zebra, x1"), (51, ""), (52, None), (53, "nowhere at-all"), (50, "x1"), (0, items[0][1]), (None, "zebra"), (54, "line Line LINE")]
    got = best_documents(frame(spark, docs), asked(spark, items), 7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 7)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert best_documents(none, asked(spark, [(1, "a")])).collect() == []
    assert best_documents(frame(spark, [row(1, "a b")]), asked(spark, [])).collect() == []


@pytest.mark.parametrize("scale", [1, 10**7])
def test_bounds_prune_and_stay_exact(scale):
    rng = np.random.default_rng(6)
    vectors = [(np.sort(rng.choice(300, 12, replace=False)), rng.integers(1, 9000, 12) * scale) for _ in range(40)]
    tree, best = ItemTree(list(range(40)), vectors), Best(40, 5)
    docs = rng.integers(0, 1_000_001, (1600, 300)) * (rng.random((1600, 300)) < 0.01)
    for i, (t, w) in enumerate(vectors):  # some documents hold an item
        for j in range(6):
            docs[40 * j + i, t] = 900_000
    scored = everything = 0
    for lo in range(0, 1600, 160):
        places, at = np.nonzero(docs[lo:lo + 160])
        known = np.isin(at, tree.vocabulary)
        places, at = places[known], at[known]
        part = search(tree, best, np.arange(lo, lo + 160), np.zeros(160, bool), places, np.searchsorted(tree.vocabulary, at), docs[lo + places, at])
        scored, everything = scored + part[0], everything + part[1]
    assert scored < everything / 2
    for place, key in enumerate(tree.keys):
        t, w = vectors[key]
        scores = docs[:, t].astype(object) @ w.astype(object)
        want = sorted((-s, i) for i, s in enumerate(scores) if s > 0)[:5]
        assert [(-int(s), int(d)) for s, d in zip(best.score[place], best.doc[place])] == [(s, i) for s, i in want]
