"""Quality classifier by co-training of two views.

The text view reads the whole text: hashed words, hashed endings of punctuation, the case pattern
of words and repeats of the word before, as a mean over all words, with lengths and shares of kinds
of characters. The page view never reads it: language, source and the recorded number of characters.
Both are logistic regressions fitted on a bounded sample of labelled rows and calibrated on held-out
ones. In every round both views score all unlabelled documents; each hands the other pseudo-labels
for a random choice of those beyond its quantiles of all margins, as far as its calibrated
probability is high enough. In the end the sum of both log-odds scores every document of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from provisor.llm import words as W
from provisor.llm.common import arrow_map
from provisor.session import cut_lineage

#: Most labelled rows of the fit, pseudo-labels that a view hands over per round, and rounds.
LABELLED, PSEUDO, ROUNDS = 5_000, 300, 3
#: Share of all unlabelled documents beyond a view's two quantiles, and the calibrated probability of a pseudo-label.
ZONE, SURE = 0.1, 0.9
WORD_SLOTS, SHAPE_SLOTS, PAGE_SLOTS = 1 << 12, 1 << 8, 64
TEXT_SLOTS = WORD_SLOTS + SHAPE_SLOTS
_NUMBERS, _PAGE_NUMBERS = 12, 2
#: Neutral words added to every text's mean, so that a few words prove little.
NEUTRAL = 8

_b = np.arange(256)
_UPPER, _LOWER = (_b >= 65) & (_b <= 90), (_b >= 97) & (_b <= 122)
_DIGIT, _WIDE = (_b >= 48) & (_b <= 57), _b >= 128
_MARK = (_b > 32) & (_b < 127) & ~_UPPER & ~_LOWER & ~_DIGIT


def text_slots(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two slots per word: the word itself, and its shape."""
    hashes = W.span_hashes(data, starts, stops, lower=True)
    words = (hashes % np.uint64(WORD_SLOTS)).astype(np.int32)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < len(hashes)]] = False
    last, before = data[stops - 1], data[np.maximum(stops - 2, starts)]
    doubled = _MARK[last] & (last == before) & (stops - starts > 1)
    shape = np.where(_MARK[last], last.astype(np.int32) & 63, 64) + 128 * doubled
    shape = np.where(again, 200, np.where(_UPPER[data[starts]] & _UPPER[data[np.minimum(starts + 1, stops - 1)]] & (stops - starts > 1), 201 + doubled, shape))
    return words, WORD_SLOTS + shape.astype(np.int32)


def text_numbers(data: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: lengths and shares of kinds of characters; zeros for an empty text."""
    size = np.diff(offsets).astype(float)
    safe = np.maximum(size, 1)

    def share(kind):
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=sums[1:])
        return np.diff(sums[offsets]) / safe

    line = np.zeros(256, bool)
    line[10] = True
    bar = np.zeros(256, bool)
    bar[[124, 9]] = True
    n = np.diff(first)
    lines = share(line) * safe
    return np.stack([
        np.log1p(size) / 10, np.log1p(n) / 10, np.log1p(lines) / 5, np.minimum(size / np.maximum(n, 1), 30) / 10, np.log1p(size / (lines + 1)) / 10,
        share(_UPPER) * 4, share(_LOWER), share(_DIGIT) * 4, share(_MARK) * 4, share(_WIDE) * 2, share(bar) * 20, (size == 0).astype(float)], 1)


def _names(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Slots of a text column's values; null has its own."""
    values = batch.column(name).cast(pa.string())
    data, offsets = W.buffers(values)
    slots = np.full(len(values), 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    slots[full] = (W.span_hashes(data, offsets[full], offsets[full + 1]) % np.uint64(PAGE_SLOTS - 2)).astype(np.int64) + 2
    slots[~np.asarray(values.is_valid())] = 0
    return slots


def _recorded(batch: pa.RecordBatch) -> np.ndarray:
    """Per document: logarithm of the recorded number of characters, and whether there is none."""
    n = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(float)
    known = np.isfinite(n) & (n >= 0)
    return np.stack([np.log1p(np.where(known, n, 0)) / 10, (~known).astype(float)], 1)


def features(batch: pa.RecordBatch):
    """Per run of documents: (i, j, word slots, shape slots, first word, text numbers, page numbers, page slots)."""
    data, offsets = W.buffers(batch.column("text").cast(pa.string()) if not pa.types.is_string(batch.column("text").type) else batch.column("text"))
    named, recorded = np.stack([_names(batch, c) for c in ("lang", "source")], 1), _recorded(batch)
    for i, j in W.pieces(offsets, W.PIECE // 2):
        part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        starts, stops, first = W.word_bounds(part, own)
        yield i, j, *text_slots(part, starts, stops, first), first, text_numbers(part, own, first), recorded[i:j], named[i:j]


def _means(slots: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(slots) + 1)
    np.cumsum(weights[slots], out=sums[1:])
    return np.diff(sums[first]) / (np.diff(first) + NEUTRAL)


@dataclass
class View:
    """Logistic regression and the line that turns its margin into calibrated log-odds."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def log_odds(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * margin + self.offset, -12, 12)


@dataclass
class Model:
    text: View
    page: View
    prior: float

    def margins(self, words, shapes, first, numbers, recorded, named) -> tuple[np.ndarray, np.ndarray]:
        t, p = self.text.weights, self.page.weights
        text = 8 * (_means(words, t, first) + _means(shapes, t, first)) + numbers @ t[TEXT_SLOTS:] + self.text.bias
        page = recorded @ p[:_PAGE_NUMBERS] + p[_PAGE_NUMBERS + named[:, 0]] + p[_PAGE_NUMBERS + PAGE_SLOTS + named[:, 1]] + self.page.bias
        return text, page

    def combined(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Log-odds of both views; the prior would otherwise count twice."""
        return self.text.log_odds(text) + self.page.log_odds(page) - self.prior


def _fit(x, y: np.ndarray, weight: np.ndarray, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Adam over the whole sample; ``x`` has ``dot`` and ``back``."""
    w, b = np.zeros(x.width), 0.0
    m, v = np.zeros(x.width + 1), np.zeros(x.width + 1)
    for t in range(1, steps + 1):
        err = (1 / (1 + np.exp(-(x.dot(w) + b))) - y) * weight
        g = np.append(x.back(err) + 1e-4 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class _Sparse:
    def __init__(self, rows, slots, values, n, width):
        self.rows, self.slots, self.values, self.n, self.width = rows, slots, values, n, width

    def dot(self, w):
        return np.bincount(self.rows, self.values * w[self.slots], self.n)

    def back(self, e):
        return np.bincount(self.slots, self.values * e[self.rows], self.width)

    def take(self, index):
        where = np.full(self.n, -1)
        where[index] = np.arange(len(index))
        keep = where[self.rows] >= 0
        return _Sparse(where[self.rows[keep]], self.slots[keep], self.values[keep], len(index), self.width)


def _line(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's line on held-out margins, with softened targets."""
    good, bad = y.sum(), len(y) - y.sum()
    soft = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(1e-6, float(np.abs(margin).mean()))
    a, b = 1.0, 0.0
    for _ in range(50):
        z = np.clip(a * margin / scale + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        g = np.array([((p - soft) * margin / scale).sum(), (p - soft).sum()])
        r = p * (1 - p)
        h = np.array([[(r * (margin / scale) ** 2).sum(), (r * margin / scale).sum()], [(r * margin / scale).sum(), r.sum()]]) + 1e-3 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return max(a, 0.0) / scale, b


def _dense(at: np.ndarray, values: np.ndarray, offset: int):
    """Rows, slots and values of a dense block whose columns begin at ``offset``."""
    i, j = np.nonzero(values)
    return at[i], j + offset, values[i, j]


def matrices(rows) -> tuple[_Sparse, _Sparse]:
    """Both views of packed rows: label, slots, values, text numbers, page numbers, page slots."""
    slots, values, numbers, recorded, named = (
        np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in ((1, np.int32), (2, np.float32), (3, np.float64), (4, np.float64), (5, np.int64)))
    each = np.arange(len(rows))
    own = np.repeat(each, [len(r[1]) // 4 for r in rows]), slots, values
    text = map(np.concatenate, zip(own, _dense(each, numbers.reshape(-1, _NUMBERS), TEXT_SLOTS)))
    named = named.reshape(-1, 2)
    ones = np.ones(len(rows))
    page = map(np.concatenate, zip(
        _dense(each, recorded.reshape(-1, _PAGE_NUMBERS), 0), (each, _PAGE_NUMBERS + named[:, 0], ones), (each, _PAGE_NUMBERS + PAGE_SLOTS + named[:, 1], ones)))
    return _Sparse(*text, len(rows), TEXT_SLOTS + _NUMBERS), _Sparse(*page, len(rows), _PAGE_NUMBERS + 2 * PAGE_SLOTS)


def train(rows, given=((), ())) -> Model | None:
    """Model from packed labelled rows; ``given`` holds the pseudo-labelled rows of the text and of the page view.

    A quarter of the labelled rows is held out for calibration. None if one of the labels is missing.
    """
    label = np.array([r[0] for r in rows], np.int64)
    if not (label == 1).any() or not (label == 0).any():
        return None
    known = np.arange(len(rows))
    held = known[::4] if all(len(set(label[k::4])) == 2 for k in range(4)) else known
    learn = np.setdiff1d(known, held) if len(held) < len(known) else known
    share, views = label[learn].mean(), []
    for view in (0, 1):
        more = list(given[view])
        x = matrices([*rows, *more])[view]
        index = np.concatenate([learn, len(rows) + np.arange(len(more))])
        y = np.concatenate([label[learn], np.array([r[0] for r in more], np.int64)]).astype(float)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        w, b = _fit(x.take(index), y, weight)
        views.append(View(w, b, *_line(x.take(held).dot(w) + b, label[held])))
    return Model(*views, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))


def _packed(batches):
    for batch in batches:
        for i, j, words, shapes, first, numbers, recorded, named in features(batch):
            slots, values = [], []
            for a, b in zip(first[:-1], first[1:]):
                own, n = np.unique(np.concatenate([words[a:b], shapes[a:b]]), return_counts=True)
                slots.append(own.astype(np.int32).tobytes())
                values.append((8 * n / (b - a + NEUTRAL)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("_label").slice(i, j - i), pa.array(slots, pa.binary()), pa.array(values, pa.binary()),
                *[pa.array([x.tobytes() for x in part], pa.binary()) for part in (numbers, recorded, named)]],
                ["label", "slots", "values", "numbers", "recorded", "named"])


def _needed(docs: DataFrame) -> DataFrame:
    counted = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.NumericType)
    return docs.select("doc_id", *[
        (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("text", "lang", "source")],
        (F.col("n_chars").cast("double") if counted else F.lit(None).cast("double")).alias("n_chars"))


def _rows_of(docs: DataFrame, chosen: DataFrame) -> list:
    """Packed rows of ``chosen(doc_id, _label)``, whose ids are unique and few; of a repeated id the row with the smallest hash."""
    found = _needed(docs).join(F.broadcast(chosen), "doc_id")
    columns = ["text", "lang", "source", "n_chars", "_label"]
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(*columns).alias("_hash"), *columns)).alias("_row"))
    rows = arrow_map(one.select("doc_id", "_row.*"), _packed, "label int, slots binary, values binary, numbers binary, recorded binary, named binary").collect()
    return sorted((r[0], *map(bytes, r[1:])) for r in rows)


def _surest(docs: DataFrame, labels: DataFrame, model: Model, pseudo: int, turn: int) -> DataFrame | None:
    """doc_id, view (that gets the pseudo-label: 0 text, 1 page) and _label, at most ``pseudo`` for each view.

    Labelled documents are scored as well and left out after it: only ids and margins are joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            text, page = np.zeros(len(batch)), np.zeros(len(batch))
            for i, j, *seen in features(batch):
                text[i:j], page[i:j] = shared.value.margins(*seen)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.text.log_odds(text)), pa.array(shared.value.page.log_odds(page))],
                                             ["doc_id", "text", "page"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    odds = arrow_map(_needed(docs).where("doc_id is not null"), run, f"doc_id {kind}, text double, page double")
    odds = cut_lineage(odds.join(labels.select("doc_id"), "doc_id", "left_anti"), "margins")
    good = 1 / (1 + np.exp(-model.prior))
    ends = [ZONE * (1 - good), 1 - ZONE * good]
    told = odds.agg(*[F.percentile_approx(c, [float(e) for e in ends], 10_000).alias(c) for c in ("text", "page")]).first()
    few, parts = {0: int(round(pseudo * (1 - good))), 1: pseudo - int(round(pseudo * (1 - good)))}, []
    least = float(np.log(SURE / (1 - SURE)))
    by = [F.xxhash64("doc_id", F.lit(turn)), F.col("doc_id")]
    for view, own in ((1, "text"), (0, "page")):
        low, high = told[own] or (0.0, 0.0)
        if low < high:
            for label, beyond in ((0, F.col(own) <= min(low, -least)), (1, F.col(own) >= max(high, least))):
                ids = odds.where(beyond).select("doc_id").distinct().orderBy(*by).limit(few[label])
                parts.append(ids.select("doc_id", F.lit(view).alias("view"), F.lit(label).alias("_label")))
    return reduce(DataFrame.unionAll, parts) if parts else None


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pseudo: int = PSEUDO) -> Model | None:
    """Co-train on at most ``labelled`` rows of ``labels(doc_id, quality)`` and all other documents.

    The labelled rows are those with the smallest hashes of doc_id. Labels other than 0 and 1, and
    ids with both, are ignored. None if one of the labels is missing. Each round scores every
    document without a label; ``pseudo`` bounds only the pseudo-labels a view gets in a round. The
    texts of chosen ids are found by broadcasts of those ids, which the two limits bound; rows
    with a null doc_id are not chosen, and an id that stands in several rows gives one of them.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("_label"), F.max("quality").alias("_most")).where("_label = _most").select("doc_id", F.col("_label").cast("int").alias("_label"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")).limit(labelled)
    rows = _rows_of(docs, cut_lineage(chosen, "sample"))
    model = train(rows)
    if model is None:
        return None
    given: tuple[dict, dict] = ({}, {})
    for turn in range(ROUNDS):
        found = _surest(docs, labels, model, pseudo, turn)
        if found is None:
            break
        found = cut_lineage(found, "pseudo")
        for view in (0, 1):
            for row in _rows_of(docs, found.where(F.col("view") == view).groupBy("doc_id").agg(F.max("_label").alias("_label"))):
                given[view].setdefault(row[1:], row)
        model = train(rows, [list(g.values()) for g in given])
    return model


def _scores(model: Model, batch: pa.RecordBatch):
    text, page = np.zeros(len(batch)), np.zeros(len(batch))
    for i, j, *seen in features(batch):
        text[i:j], page[i:j] = model.margins(*seen)
    odds = lambda z: 1 / (1 + np.exp(-z))
    return odds(model.text.log_odds(text)), odds(model.page.log_odds(page)), odds(model.combined(text, page))


def score(docs: DataFrame, labels: DataFrame, least: float = 0.5, **limits) -> DataFrame:
    """doc_id, p_text, p_page, score and keep for every row of ``docs(doc_id, text, lang, source, n_chars)``.

    ``keep`` is score >= ``least``. Null text is empty; a null language, source or number is a value
    of its own, and so is a missing column. Rows that stand twice are scored twice, alike. Without a model (see ``fit``) everything is kept and the
    numbers are null. Other columns are ignored.
    """
    model = fit(docs, labels, **limits)
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select("doc_id", nothing.alias("p_text"), nothing.alias("p_page"), nothing.alias("score"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            text, page, both = _scores(shared.value, batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text), pa.array(page), pa.array(both), pa.array(both >= least)],
                                             ["doc_id", "p_text", "p_page", "score", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(_needed(docs), run, f"doc_id {kind}, p_text double, p_page double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **limits) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with their columns, whatever those are called.

    Repeated rows stay or go together; an empty table stays empty.
    """
    model = fit(docs, labels, **limits)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.columns
    counted = "n_chars" in own and isinstance(docs.schema["n_chars"].dataType, T.NumericType)

    def run(batches):
        for batch in batches:
            seen = {c: batch.column(own.index(c)).cast(pa.string()) if c in own else pa.nulls(len(batch), pa.string()) for c in ("text", "lang", "source")}
            seen["n_chars"] = batch.column(own.index("n_chars")).cast(pa.float64()) if counted else pa.nulls(len(batch), pa.float64())
            _, _, both = _scores(shared.value, pa.RecordBatch.from_pydict(seen))
            yield batch.filter(pa.array(both >= least))

    return arrow_map(docs, run, docs.schema)
