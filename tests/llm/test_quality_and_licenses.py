import random

from provisor.llm.licenses import scan, train
from provisor.llm.quality import keep_good, score
from tests.llm.helpers import SCHEMA, corpus, frame, row


def labelled(n=400):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 80)))
        bad = i % 5 == 0
        rows.append(row(i, " ".join(w + "###" for w in text.upper().split()) if bad else text.capitalize() + ".", source=f"s{i % 3}"))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_cotraining_on_held_out_documents(spark):
    rows, labels = labelled()
    table = spark.createDataFrame(labels + [(None, 1, 0), (2, 9, 0)], "doc_id long, quality int, toxic int")
    odd = [row(800, None), row(801, ""), row(None, rows[1][1]), row(802, "w" * 100000, lang=None, source=None), rows[7]]
    got = {r.doc_id: r for r in score(frame(spark, rows + odd), table, labelled=150, pseudo=20).collect()}
    held = [i for i in range(400) if i % 2]
    assert sum(got[i].keep == (i % 5 != 0) for i in held) >= 0.98 * len(held)
    assert all(got[i].keep for i in held if i % 5) and 800 in got and 801 in got and 802 in got
    kept = keep_good(frame(spark, rows + odd), table, labelled=150, pseudo=20)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 400 and r.doc_id != 7) == [i for i in got if i is not None and i < 400 and i != 7 and got[i].keep] or \
        {r.doc_id for r in kept.collect()} == {i for i in got if got[i].keep}


def test_without_both_labels_everything_is_kept(spark):
    rows, _ = labelled(10)
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.keep and r.score is None for r in score(frame(spark, rows), one).collect())
    assert score(spark.createDataFrame([], SCHEMA), one).collect() == []
    assert keep_good(frame(spark, rows), one).count() == 10


def test_notices_are_found_and_prose_is_not(spark):
    notices = {"mit": "Released under the MIT License.", "apache-2.0": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0.",
               "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "all-rights-reserved": "(c) 2020 Example. All rights reserved."}
    rows = [row(i, f"Some text stands here.\n{t}\nMore text follows, nothing else.") for i, t in enumerate(notices.values())]
    long = " ".join("word%d" % (i % 97) for i in range(900))
    rows += [row(20, "She lost her license and has no right to drive; the public was reserved."), row(21, None), row(22, ""), row(23, long + " released under the MIT license " + long), *corpus(n=12)]
    got = {r.doc_id: r for r in scan(frame(spark, rows)).collect() if r.doc_id != 6}
    for i, family in enumerate(notices):
        if i not in (0, 3):  # ids that corpus() has too
            assert got[i].families == [family] and got[i].notices[0].paragraph == 1
    assert got[20].families == got[21].families == got[22].families == [] and got[23].families == ["mit"]
    assert scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_unknown_text_has_a_calibrated_class():
    model = train([["plain", "words", "of", "no", "licence"]] * 5)
    assert 0.1 < model.heat < 10
