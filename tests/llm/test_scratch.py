import pathlib

import numpy as np

from provisor.llm.jaccard import _point, _unpacked, similar_sets
from provisor.llm.lines import remove_repeated_lines
from provisor.session import cut_lineage, scratch
from tests.llm.helpers import corpus, frame


def tables(spark):
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return {p.name.rsplit("-", 1)[0] + "/" + p.name for p in root.glob("*-*") if p.is_dir()}


def test_tables_of_a_block_go_with_it(spark):
    before = tables(spark)
    with scratch(spark) as outer:
        with scratch(spark) as inner:
            kept = inner.keep(cut_lineage(spark.range(5), "gone").where("id > 2"), "middle")
        assert {x.split("/")[0] for x in tables(spark) - before} == {"middle"}
        kept = outer.keep(kept, "kept")
    assert {x.split("/")[0] for x in tables(spark) - before} == {"kept"}
    assert sorted(r.id for r in kept.collect()) == [3, 4]


def test_operators_leave_their_result_only(spark):
    docs = frame(spark, corpus(n=12))
    similar_sets(docs, 4, 85)  # the package is shipped once
    before = tables(spark)
    sets, lines = similar_sets(docs, 4, 85), remove_repeated_lines(docs)
    assert {x.split("/")[0] for x in tables(spark) - before} == {"similar-sets", "removed-lines"}
    assert sets.count() == lines.count() == docs.count()


def test_points_come_back_and_are_small():
    rng = np.random.default_rng(1)
    for n in (1, 300, 5000, 600_000):
        grams = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        point = _point(grams)
        assert _unpacked(point).sum() == len(grams) and len(_unpacked(point)) == (1024 if len(grams) >= 4000 else 256)
    assert len(_point(np.arange(300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C13))) < 150
