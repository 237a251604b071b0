"""Licence notices in documents: a trained paragraph classifier, confirmed by templates.

A paragraph is a line; one of more than ``WINDOW`` words is read in overlapping windows. Lines
without a blank one between them are read in such windows once more, for notices that are wrapped. Words
are lower-cased and stripped of outer punctuation; hashed words and word pairs are the sparse
features of a multinomial logistic regression with a class for text that is no licence. It is
fitted on varied templates and on a bounded sample of paragraphs of the corpus, and its
probabilities are calibrated on held-out examples. A prediction counts only if the paragraph also
has most word pairs of one of the family's templates; a paragraph may have several families.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provisor.llm import words as W
from provisor.llm.common import arrow_map
from provisor.session import cut_lineage

SLOTS, WINDOW = 1 << 14, 24
#: Documents whose paragraphs may serve as examples of no licence, and paragraphs of each.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 1_000, 4

# Wordings by which licence families are announced.
TEMPLATES = {
    "agpl-3.0": ["licensed under the gnu affero general public license version 3", "this program is free software under the terms of the gnu affero general public license"],
    "all-rights-reserved": ["all rights reserved"],
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the apache license"],
    "bsd": ["released under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc0": ["dedicated to the public domain under cc0 1.0", "to the extent possible under law the author has waived all copyright and related rights"],
    "gpl-2.0": ["licensed under the gnu general public license version 2", "under the terms of the gnu general public license version 2 as published by the free software foundation"],
    "gpl-3.0": ["licensed under the gnu general public license version 3", "under the terms of the gnu general public license version 3 as published by the free software foundation"],
    "lgpl": ["licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "mpl-2.0": ["subject to the terms of the mozilla public license version 2.0", "licensed under the mozilla public license version 2.0"],
}
# The name of a family, without which a template that holds it is not confirmed.
NAMES = {"agpl-3.0": "affero", "apache-2.0": "apache", "bsd": "bsd", "gpl-2.0": "gnu", "gpl-3.0": "gnu", "lgpl": "lesser", "mit": "mit", "mpl-2.0": "mozilla"}
# Ordinary sentences that use the same words.
ORDINARY = [
    "the driver lost his license after the accident", "you need a license to fish in this lake", "she has the right to remain silent",
    "permission to enter was denied by the guard", "free admission for all visitors on sunday", "the public library is open to all",
    "his rights were read to him at the station", "the general public was not informed", "version 2.0 of the report was published",
    "a table was reserved for all of us", "the terms of the treaty were harsh", "free copies of the software magazine",
]
_EDGE = (W._BYTES == 0)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Words of a run of documents: their starts and stops, document and line number."""
    starts, stops, first = W.word_bounds(data, offsets)
    for _ in range(3):
        stops = np.where((stops - starts > 1) & _EDGE[data[np.maximum(stops - 1, 0)]], stops - 1, stops)
        starts = np.where((stops - starts > 1) & _EDGE[data[np.minimum(starts, max(len(data) - 1, 0))]], starts + 1, starts)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return starts, stops, none, none
    breaks = np.cumsum(data == 10)
    doc = W.segment_of(first)
    return starts, stops, doc, breaks[starts] - np.r_[0, breaks][offsets[:-1]][doc]


def units(doc: np.ndarray, line: np.ndarray, gap: int = 1):
    """First and last word of each unit; a step of ``gap`` lines or more begins a new paragraph."""
    if not len(doc):
        none = np.zeros(0, np.int64)
        return none, none
    edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] - line[:-1] >= gap)])
    n = np.diff(np.append(edge, len(doc)))
    parts = np.maximum(1, -(-(n - WINDOW) // (WINDOW // 2)) + 1)
    of = np.repeat(np.arange(len(edge)), parts)
    lo = edge[of] + (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * (WINDOW // 2)
    return lo, np.minimum(lo + WINDOW, edge[of] + n[of])


def wrapped_units(doc: np.ndarray, line: np.ndarray):
    """As ``units``, over paragraphs that blank lines part; only what has words of several lines."""
    lo, hi = units(doc, line, 2)
    several = line[lo] != line[hi - 1] if len(lo) else np.zeros(0, bool)
    return lo[several], hi[several]


def slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of the words, and of each word with the one before."""
    pairs = hashes.copy()
    pairs[1:] = W.mixed(hashes[1:] * W._Q + hashes[:-1])
    return (hashes % np.uint64(SLOTS)).astype(np.int64), (pairs % np.uint64(SLOTS)).astype(np.int64)


def _hashed(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    size = np.array([len(w) for w in raw], np.int64)
    start = np.cumsum(size + 1) - size - 1
    return W.span_hashes(data, start, start + size, lower=True)


def pair_share(words: list[str], family: str) -> float:
    """Largest share of a template's word pairs that the words have."""
    own = set(zip(words, words[1:]))
    best = 0.0
    for template in TEMPLATES[family]:
        t = template.split()
        pairs = set(zip(t, t[1:]))
        best = max(best, len(pairs & own) / len(pairs))
    return best


#: Word pairs of every template, by family in order.
_PAIRS = [[set(zip(t.split(), t.split()[1:])) for t in TEMPLATES[f]] for f in TEMPLATES]


def families(own: set, p: np.ndarray, confirm: float) -> list[int]:
    """Numbers of the families whose template share reaches ``confirm``, the largest share first, then the largest p.

    A template that holds its family's name needs that name: the wording of licences of other names is no notice.

    A further family must be told from those before it: the window has all pairs of its template
    that theirs lack, or ``confirm`` of these and two fifths of the template besides what theirs
    have there. So the wording that GNU or Creative Commons licences share is no second notice.
    """
    said = {w for pair in own for w in pair}

    def shared(family: str, template: set) -> float:
        name = NAMES.get(family)
        if name and name not in said and any(name in pair for pair in template):
            return 0.0
        return len(template & own) / len(template)

    best = [max(ts, key=lambda t: shared(f, t)) for f, ts in zip(TEMPLATES, _PAIRS)]
    share = [shared(f, t) for f, t in zip(TEMPLATES, best)]
    found: list[int] = []
    for f in sorted((f for f in range(len(best)) if share[f] >= confirm), key=lambda f: (-share[f], -p[f])):
        t = best[f]

        def apart(a: int) -> bool:
            lacks, other = t - set().union(*_PAIRS[a]), (t & own) - best[a]
            has = len(lacks & own) / len(lacks) if lacks else 0.0
            return has == 1 or has >= confirm and len(other) >= 0.4 * len(t)

        if all(apart(a) for a in found):
            found.append(f)
    return found


class Classifier:
    """Softmax regression over mean slot weights; class 0 is no licence."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, heat: float):
        self.weights, self.bias, self.heat = weights, bias, heat

    def probabilities(self, hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """One row per unit [lo, hi) of words."""
        one, two = slots(hashes)
        sums = np.zeros((len(hashes) + 1, len(self.bias)))
        np.cumsum(self.weights[one], axis=0, out=sums[1:])
        total = sums[hi] - sums[lo]
        np.cumsum(self.weights[two], axis=0, out=sums[1:])
        total += sums[hi] - sums[np.minimum(lo + 1, hi)]
        z = (8 * total / (hi - lo)[:, None] + self.bias) / self.heat
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(ordinary: list[list[str]], seed: int = 11) -> Classifier:
    """Fit on varied templates and on paragraphs of no licence (lists of at most ``WINDOW`` words)."""
    rng = np.random.default_rng(seed)
    plain = [w for w in ordinary if w and all(pair_share(w, f) < 0.5 for f in TEMPLATES)]
    other = [s.split() for s in ORDINARY]
    filler = [w for words in plain[:500] for w in words][:5000] or [w for words in other for w in words]
    examples = [(0, w) for w in plain] + [(0, w) for w in other for _ in range(20)]
    for c, family in enumerate(TEMPLATES, 1):
        elsewhere = {w for f in TEMPLATES if f != family for t in TEMPLATES[f] for w in t.split()}
        for template in TEMPLATES[family]:
            words = template.split()
            for turn in range(60):
                kept = [w for w in words if turn < 10 or w not in elsewhere or rng.random() > 0.12]
                before, after = (list(rng.choice(filler, rng.integers(0, 11))) if turn % 2 else [] for _ in range(2))
                examples.append((c, before + kept + after))
    at, feature, value = [], [], []
    for i, (_, words) in enumerate(examples):
        one, two = slots(_hashed(words))
        s, n = np.unique(np.concatenate([one, two[1:]]), return_counts=True)
        at.append(np.full(len(s), i))
        feature.append(s)
        value.append(8 * n / len(words))
    at, feature, value = map(np.concatenate, (at, feature, value))
    y = np.array([c for c, _ in examples])
    held = np.arange(len(y)) % 4 == 3
    classes = len(TEMPLATES) + 1
    share = np.where(held, 0, 1 / np.bincount(y[~held], minlength=classes)[y] / classes)
    goal = np.eye(classes)[y]
    used, slot = np.unique(feature, return_inverse=True)
    w, b = np.zeros((len(used), classes)), np.zeros(classes)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]

    def margin():
        z = np.zeros((len(y), classes))
        for k in range(classes):
            z[:, k] = np.bincount(at, value * w[slot, k], len(y)) + b[k]
        return z

    def soft(z):
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    for t in range(1, 81):
        err = (soft(margin()) - goal) * share[:, None]
        grads = [np.stack([np.bincount(slot, value * err[at, k], len(used)) for k in range(classes)], 1) + 1e-5 * w, err.sum(0)]
        for i, p in enumerate((w, b)):
            m[i] = 0.9 * m[i] + 0.1 * grads[i]
            v[i] = 0.99 * v[i] + 0.01 * grads[i] ** 2
            p -= 0.2 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    z = margin()[held]
    heats = np.geomspace(0.25, 8, 41)
    loss = [-np.log(soft(z / h)[np.arange(len(z)), y[held]] + 1e-12).mean() for h in heats]
    weights = np.zeros((SLOTS, classes))
    weights[used] = w
    return Classifier(weights, b, float(heats[int(np.argmin(loss))]))


def _runs(batch: pa.RecordBatch):
    data, offsets = W.buffers(batch.column(1))
    for i, j in W.pieces(offsets, W.PIECE):
        part = data[offsets[i]:offsets[j]]
        yield i, part, *words_of(part, offsets[i:j + 1] - offsets[i])


def _words(part, starts, stops, lo, hi) -> list[str]:
    return [part[a:b].tobytes().decode(errors="replace").lower() for a, b in zip(starts[lo:hi], stops[lo:hi])]


def _examples(batches):
    for batch in batches:
        found = []
        for _, part, starts, stops, of, line in _runs(batch):
            lo, hi = units(of, line)
            doc = of[lo]
            for d in np.unique(doc):
                for u in np.flatnonzero(doc == d)[:: max(1, int((doc == d).sum()) // SAMPLE_PARAGRAPHS)][:SAMPLE_PARAGRAPHS]:
                    found.append(_words(part, starts, stops, lo[u], hi[u]))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["words"])


def _scan(model, least: float, confirm: float):
    names = list(TEMPLATES)
    mark = pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("p", pa.float64())])

    def run(batches):
        for batch in batches:
            found = [{} for _ in range(len(batch))]
            for i, part, starts, stops, doc, line in _runs(batch):
                if not len(doc):
                    continue
                hashes = W.span_hashes(part, starts, stops, lower=True)
                for lo, hi in (units(doc, line), wrapped_units(doc, line)):
                    p = model.value.probabilities(hashes, lo, hi)
                    for u in np.flatnonzero(1 - p[:, 0] >= least):
                        words, at = _words(part, starts, stops, lo[u], hi[u]), line[lo[u]:hi[u]]
                        own, pairs = found[i + doc[lo[u]]], list(zip(words, words[1:]))
                        for f in families(set(pairs), p[u, 1:], confirm):
                            where = at[:-1]
                            if at[0] != at[-1]:  # lines that have this notice by themselves don't count again
                                new = ~np.isin(at, [a for a, b in own if b == names[f]])
                                pairs_left = [x for x, ok in zip(pairs, new[:-1] & new[1:]) if ok]
                                if f not in families(set(pairs_left), p[u, 1:], confirm):
                                    continue
                                template = max(_PAIRS[f], key=lambda t: len(t & set(pairs_left)) / len(t))
                                where = at[:-1][[bool(ok) and x in template for x, ok in zip(pairs, new[:-1] & new[1:])]]
                                lines, n = np.unique(where, return_counts=True)
                                where = lines[[int(n.argmax())]]
                            key = (int(where[0]), names[f])
                            own[key] = max(own.get(key, 0.0), float(p[u, 1 + f]))
            rows = [[{"paragraph": a, "family": f, "p": x} for (a, f), x in sorted(own.items())] for own in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([sorted({f for _, f in own}) for own in found], pa.list_(pa.string())), pa.array(rows, pa.list_(mark))],
                ["doc_id", "families", "notices"])

    return run


def scan(docs: DataFrame, least: float = 0.5, confirm: float = 0.6) -> DataFrame:
    """doc_id, families (sorted) and notices (paragraph, family, p) for every row of ``docs(doc_id, text)``.

    ``paragraph`` is the line number from 0, for a wrapped notice that of the line with most of it.
    A paragraph is a notice if the classes other than no licence have probability ``least``
    together; of each family that has a share of ``confirm`` of a template's word pairs (see
    ``families``), p is the family's own probability. Null and empty texts have no notices. Other columns are ignored.
    The examples of no licence come from the documents with the smallest id hashes, found by a
    broadcast of at most ``SAMPLE_DOCS`` ids.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    few = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(SAMPLE_DOCS)
    chosen = docs.join(F.broadcast(cut_lineage(few, "sample")), "doc_id").select("doc_id", "text")
    ordinary = arrow_map(chosen, _examples, "words array<string>").toPandas()["words"]
    model = docs.sparkSession.sparkContext.broadcast(train(sorted(list(w) for w in ordinary)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs, _scan(model, least, confirm), f"doc_id {kind}, families array<string>, "
                     "notices array<struct<paragraph:long,family:string,p:double>>")
