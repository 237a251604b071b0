import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from provisor.llm.packing import pack, pack_documents, plan
from tests.llm.helpers import SCHEMA, corpus, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.integers(1, 64), st.integers(0, 3000), st.sampled_from(["norm", "dot"]))
def test_plan_keeps_every_capacity(counts, docs, extra, rule):
    cost = 64 * 64 + extra
    bins = {}
    for length, number, lo, n, each, offset in plan(counts, 64, docs, cost, rule=rule).tolist():
        for b in range(lo, lo + n):
            used = bins.setdefault(b, [0, 0, 0])
            assert used[0] == offset
            used[:] = used[0] + each * length, used[1] + each, used[2] + each * length * length
    assert all(a <= 64 and b <= docs and c <= cost for a, b, c in bins.values())
    assert sum(b for _, b, _ in bins.values()) == sum(counts.values())
    if docs >= 64:  # any two bins of best fit hold more than one bin's worth
        assert len(bins) <= 2 * sum(k * v for k, v in counts.items()) / 64 + 1


def test_too_long_a_piece_is_refused():
    with pytest.raises(ValueError):
        plan({10: 1}, 64, 8, 50)


def test_documents_are_cut_and_placed(spark):
    rows = corpus()
    got = pack_documents(frame(spark, rows), PATH, 0, 128).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want += [(r[0], k, 128 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(ids[i:i + 128] for i in range(0, len(ids), 128))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 128
    assert len(places) <= 1.05 * sum(r.length for r in got) / 128 + 1


def test_empty_table_and_lengths_without_a_place(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []
    items = spark.createDataFrame([(1, 5), (2, None), (3, 0)], "name long, length long")
    assert [tuple(r) for r in pack(items, 8).collect()] == [(1, 5, 0, 0)]
