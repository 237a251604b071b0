import hashlib
import zlib

import pytest

from provisor.llm.merkle import manifest, verified_manifest
from tests.llm.helpers import SCHEMA, corpus, frame, row


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    doc_id, _, lang, source, n_chars = r[:5]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Root and, per leaf, its siblings as (left, right) level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for w, i in zip(ways, at):
            run = i - i % 3
            w.append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + 3])))
        nodes = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], ways


def expected(rows):
    order = lambda s: (s is not None, (s or "").encode())
    sources = sorted({r[3] for r in rows}, key=order)
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((own, *climb([leaf(r, r[1]) for r in own])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (own, subroot, ways), top in zip(trees, tops):
        for r, way in zip(own, ways):
            steps = way + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            h = leaf(r, r[1].replace("\n", "") if bad else r[1])
            for left, right in steps:
                h = sha(left + h + right)
            out.append((r[0], leaf(r, r[1]), subroot, root, sha("".join(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in verified_manifest(frame(spark, rows)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("rows", [
    corpus(n=90) + [row(None, "a\nb"), row(None, None), row(7, "a\n", "ä"), row(8, "a\n", "z"), row(9, "\n" * 300, None)],
    [row(i, f"one\ntwo {i}") for i in range(100)],
    [row(1, "a\nb")], [row(1, "a\nb", "x"), row(1, "a\nb", "y")], [row(i, "a\nb", f"s{i}") for i in range(30)], [row(5, "a\n")] * 5])
def test_every_proof_matches_a_plain_tree(spark, rows):
    assert got(spark, rows) == expected(rows)


def test_no_rows(spark):
    assert verified_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sources_of_a_manifest(spark):
    leaves = spark.createDataFrame([("b", 2, "x", None), ("b", 1, "y", None), (None, 1, "z", None)], "source string, doc_id long, leaf string, other string")
    made = manifest(leaves)
    assert {tuple(r) for r in made.sources.collect()} == {("b", 2, sha("yx")), (None, 1, "z")}
    assert made.root == sha("z" + sha("yx"))
