import random
import re

from pyspark.sql import functions as F

from provisor.llm.lines import grams, remove_repeated_lines
from tests.llm.helpers import corpus, frame, row


def shingles(line):
    return {line[i:i + 5] for i in range(max(1, len(line) - 4))}


def expected(rows, percent=80):
    """Brute force over all overlapping character shingles."""
    sets, parent, first = {}, {}, {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if re.search(r"\S", line):
                sets.setdefault(line, shingles(line))
                parent[line] = line

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lines = list(sets)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    places = [(r[0], no, line) for r in rows for no, line in enumerate((r[1] or "").split("\n")) if line in sets]
    for doc, no, line in places:
        first[find(line)] = min(first.get(find(line), (doc, no)), (doc, no))
    lost = {(doc, no) for doc, no, line in places if first[find(line)] != (doc, no)}
    return sorted((r[0], None if r[1] is None else "\n".join(x for no, x in enumerate(r[1].split("\n")) if (r[0], no) not in lost)) for r in rows)


def edited_lines():
    """Lines of 50 to 149 characters and spaceless ones, each with one character exchanged or inserted."""
    rng = random.Random(3)
    spaced = ["".join(rng.choice("abcdefghijklmno   ") for _ in range(n)).replace("  ", "q ").strip().ljust(n, "z") for n in range(50, 150, 2)]
    solid = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)) for n in (60, 120, 400, 700, 1300)]
    docs = []
    for line in spaced + solid:
        at = rng.randrange(len(line) // 3, 2 * len(line) // 3)
        docs += [line, line[:at] + "#" + line[at + 1:]]
    docs += [x for line in solid for x in (line[:5] + "Y" + line[5:],)]
    return [row(10_000 + i, x) for i, x in enumerate(docs)]


def test_every_place_of_a_line_has_a_shingle(spark):
    lines = [r[1] for r in edited_lines()] + ["a", "abcde", "x" * 300, "é" * 259 + "abcdefgh", "a b" * 1000]
    own = spark.createDataFrame([(x,) for x in lines], "line string").select("line", grams(F.col("line")).alias("g"))
    for r in own.withColumn("n", F.size(F.array_distinct("g"))).collect():
        assert len(r.g) == max(1, len(r.line) - 4) and r.n == len(shingles(r.line))


def test_lines_with_one_edit_match_brute_force(spark):
    rows = edited_lines() + [r for r in corpus(n=36) if r[0] not in (3, 6)]
    got = sorted((r.doc_id, r.text) for r in remove_repeated_lines(frame(spark, rows)).select("doc_id", "text").collect())
    assert got == expected(rows)
    texts = dict(got)
    assert all(texts[r[0]] == "" for r in rows if r[1] and "#" in r[1] and r[0] >= 10_000)
