from collections import defaultdict
import re

from provisor.llm.lines import remove_repeated_lines
from tests.llm.helpers import SCHEMA, corpus, frame, row


def expected(rows, percent=80):
    sets = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if re.search(r"\S", line):
                sets.setdefault(line, {line[i:i + 5] for i in range(max(1, len(line) - 4))})
    lines = list(sets)
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for j in range(i):
            both = len(sets[a] & sets[lines[j]])
            if 100 * both >= percent * (len(sets[a]) + len(sets[lines[j]]) - both):
                parent[find(i)] = find(j)
    first = {}
    for r in rows:
        for no, line in enumerate((r[1] or "").split("\n")):
            if re.search(r"\S", line):
                root, at = find(lines.index(line)), ((r[0] is not None, r[0] or 0), no)
                first[root] = min(first.get(root, at), at)
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, r[2]))
            continue
        kept = [line for no, line in enumerate(r[1].split("\n"))
                if not re.search(r"\S", line) or first[find(lines.index(line))] == ((r[0] is not None, r[0] or 0), no)]
        out.append((r[0], "\n".join(kept), r[2]))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark):
    rows = corpus(n=36) + [row(None, "Line one of all documents here.\nonly here, with no id"), row(700, "a\r\nb\r\n"), row(701, "a\r\nb\r\n")]
    got = remove_repeated_lines(frame(spark, rows))
    assert got.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").replace(" double", "").split(", ")
    assert sorted(((r.doc_id, r.text, r.lang) for r in got.collect()), key=str) == expected(rows)
    assert all(r.text is None or r.n_chars == len(r.text) for r in got.collect())


def test_empty_table(spark):
    assert remove_repeated_lines(spark.createDataFrame([], SCHEMA)).collect() == []
