"""Small tables with the odd cases that every operator must survive."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, id string, n int, score double, part int"


def row(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "y", 1, 0.5, 7)


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, repeated rows, nulls and a long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, base = text(40), text(120)
    docs = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            body = text(rng.randint(1, 80))
        elif kind == 1:
            body = text(20) + "\n" + passage + "\n" + text(15)
        elif kind == 2:
            w = base.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "Edit%d" % rng.randrange(9)
            body = "\t".join(w[:60]) + "  " + " ".join(w[60:])
        elif kind == 3:
            body = base
        elif kind == 4:
            body = "Line one of all documents here.\n" + text(30) + "\nLine one of all documents herE.\n\n"
        else:
            body = "x " * rng.randint(1, 5)
        docs.append(row(i * 3, body, source=f"s{i % 4}"))
    docs += [row(500, ""), row(501, None, source=None), row(502, " \n\t "), row(503, "one two three", lang=None), row(504, "one two three"),
             row(505, text(4000) + "w" * 5000 + " " + text(10), source="long"), row(3, docs[1][1], source="s1"), docs[2]]
    return docs


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
