from provisor.llm.mixing import mix, mixed
from tests.llm.helpers import SCHEMA, corpus, frame, row, words


def goals(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in capped)
        left = total - sum(most * sizes[s] for s in capped)
        more = {s for s in names if s not in capped and rest and left * weight[s] / rest > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in capped else left * weight[s] / rest for s in names}
        capped |= more


def test_targets_and_cuts(spark):
    rows = corpus() + [row(None, "no id here", "s1"), row(900, "tiny", "zz"), row(901, "word " * 3000, "a0")]
    got = mix(frame(spark, rows)).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    want = goals(sizes)
    assert sorted((r.doc_id, r["size"], r.source_size) for r in got if r.doc_id is not None) == sorted(
        (r[0], len(words(r[1])), sizes[r[3]]) for r in rows if r[0] is not None)
    taken = {}
    for r in got:
        assert r.taken <= 3 * r["size"]
        taken.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert sorted((k, sum(v)) for k, v in taken.items()) == sorted(((sizes[s], round(float(want[s]), 6)), int(want[s])) for s in sizes)
    again = mix(frame(spark, rows[::-1])).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_mixed_rows_hold_the_taken_words(spark):
    rows = corpus()
    table = frame(spark, rows)
    plan, out = mix(table).collect(), mixed(table)
    assert out.columns == table.columns
    assert sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in plan)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in plan if r.taken}


def test_empty_tables(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == [] and mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    only = frame(spark, [row(1, ""), row(2, None)])
    assert [(r.target, r.taken) for r in mix(only).collect()] == [(0.0, 0), (0.0, 0)]
