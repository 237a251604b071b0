import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from provisor.llm import rans
from provisor.llm.binary import new_folder, read_ids, write_ids
from provisor.llm.tokens import Encoder, encoded
from tests.llm.helpers import SCHEMA, corpus, frame, row

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TOKENIZERS = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
PIECES = ["a", "B", "é", "'s", "'", "  ", " ", "\n", "\t", ",", "!", "1", "23", " ", "　", "ß", "İ", "中", "don't", "≠", "́", "≠", "\x0b", "\x1f", "ﬁ", "Σ", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "<|endof", "text|>"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=6), st.sampled_from([BYTES, WORDS]))
def test_pieces_give_the_ids_of_whole_texts(texts, path):
    got = []
    for i, j, ids, first in encoded(pa.array(texts, pa.string()), path):
        got += [ids[first[k]:first[k + 1]].tolist() for k in range(j - i)]
    assert got == [e.ids for e in TOKENIZERS[path].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=400), st.integers(1, 64), st.integers(1, 300))
def test_blocks_round_trip(ids, lanes, checkpoint):
    ids = np.array(ids, np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=70001))
    block = rans.encode(ids, table, lanes, checkpoint)
    assert rans.decode(block, table).tolist() == ids.tolist()
    parts = [rans.decode_part(block, table, p) for p in reversed(range(rans.parts(block)))]
    assert np.concatenate(parts[::-1] or [ids]).tolist() == ids.tolist()
    if len(set(ids.tolist())) > 1 and len(ids) > 64:
        with pytest.raises(ValueError):
            rans.decode(block[:-1] + bytes([block[-1] ^ 1]), table)
            rans.decode(block, rans.Table.of_counts(np.ones(3, np.int64)))


def test_files_hold_every_document(spark):
    rows = corpus() + [row(None, "no id"), row(None, None), row(91, "one <|endoftext|>two <|endof"), row(92, "text|> three")]
    target = new_folder(spark)
    write_ids(frame(spark, rows), BYTES, 2, target, block_ids=500)
    ids = {i: TOKENIZERS[BYTES].encode(r[1] or "", add_special_tokens=False).ids + [2] for i, r in enumerate(rows)}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    digest = read_ids(spark, target, digest=True).orderBy("start").collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in digest), key=str) == sorted(((rows[i][0], len(x), crc(x)) for i, x in ids.items()), key=str)
    assert [r.start for r in digest] == [sum(x.n_tokens for x in digest[:i]) for i in range(len(digest))]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in digest] == sorted((r.doc_id is not None, r.doc_id or 0) for r in digest)
    whole = read_ids(spark, target).collect()
    assert sorted(((r.doc_id, r.ids) for r in whole), key=str) == sorted(((rows[i][0], x) for i, x in ids.items()), key=str)


def test_empty_table(spark):
    target = new_folder(spark)
    write_ids(spark.createDataFrame([], SCHEMA), BYTES, 2, target)
    assert read_ids(spark, target).collect() == []


def test_hashes_are_found_in_any_order():
    e, rng = Encoder(BYTES), np.random.default_rng(1)
    e.known = np.sort(rng.integers(0, 1 << 63, 1_000, np.uint64))
    seen = np.concatenate([rng.permutation(e.known)[:500], rng.integers(0, 1 << 63, 500, np.uint64)])
    assert (e._find(seen, np.argsort(seen)) == np.searchsorted(e.known, seen)).all()
