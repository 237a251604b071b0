import hashlib

import numpy as np
import pyarrow as pa

from provisor.llm.fingerprints import PERMUTATIONS, edited_fingerprints, of_texts
from tests.llm.helpers import SCHEMA, corpus, frame, row, shingles


def test_edited_texts_and_likeness(spark):
    rows = [r for r in corpus() if r[0] != 3 and r[0] != 6] + [row(None, "first of all é ß")]
    got = {r.doc_id: r for r in edited_fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    seen, miss = {}, []
    for r, following in zip(order, order[1:] + order[:1]):
        text, after = r[1] or "", following[1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own = got[r[0]]
        assert own.n_chars == len(text) and own.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(text, own.fingerprint) == own.fingerprint
        for other, near in ((edited, own.near_edited), (after, own.near_next)):
            a, b = shingles(text, 5), shingles(other, 5)
            miss.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(miss)) < 0.02 and np.abs(miss).max() < 5 * (0.25 / PERMUTATIONS) ** 0.5


def test_one_document_follows_itself_and_rows_with_one_id_stay(spark):
    one = edited_fingerprints(frame(spark, [row(4, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
    assert edited_fingerprints(frame(spark, [row(4, "a"), row(4, "b"), row(4, "b")])).count() == 3
    assert edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []


def test_an_empty_text_is_like_no_other():
    empty, some = of_texts(pa.array(["", "a b c d e f"]))
    assert (empty == 0xFFFF).all() and (empty == some).mean() < 0.05
