"""Token ids of whole texts through the ``tokenizers`` library.

A text is cut where the tokenizer's own word pattern always cuts, and every distinct piece is
encoded once per worker: before a single space between two visible characters, and between an
ASCII letter and an ASCII punctuation mark other than the apostrophe. The ids of a text are the
ids of its pieces in a row. A special token that a text spells out is a piece of its own and gets
the token's id, as the library does with ``add_special_tokens=False``.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa

from provisor.llm import words as W

#: Pieces that a worker keeps at most.
KEPT_PIECES = 600_000

_ascii = np.arange(256)
_LETTER = ((_ascii | 32) >= 97) & ((_ascii | 32) <= 122) & (_ascii < 128)
_PUNCT = (_ascii > 32) & (_ascii < 127) & ~_LETTER & ~((_ascii >= 48) & (_ascii <= 57)) & (_ascii != 39)
_VISIBLE = (_ascii > 32) & (_ascii < 127)
_LEAD2 = (_ascii >= 0xC3) & (_ascii <= 0xDF)


def _cuts(data: np.ndarray) -> np.ndarray:
    """Bytes before which letters and punctuation part."""
    letter, punct = _LETTER[data], _PUNCT[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = (letter[:-1] & punct[1:]) | (punct[:-1] & letter[1:])
    return cut


def _spaces(data: np.ndarray) -> np.ndarray:
    """Single spaces between visible characters; characters of two bytes are letters or marks."""
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        before = _VISIBLE[data]
        before[1:] |= _LEAD2[data[:-1]] & (data[1:] >= 0x80)
        after = _VISIBLE[data] | _LEAD2[data]
        cut[1:-1] = (data[1:-1] == 0x20) & before[:-2] & after[2:]
    return cut


def _spelled(data: np.ndarray, offsets: np.ndarray, special: re.Pattern | None) -> list[tuple[int, int]]:
    """Where documents spell a special token, left to right, the longest first; none spans two documents."""
    raw = data.tobytes() if special is not None else b""
    if special is None or not special.search(raw):
        return []
    return [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in special.finditer(raw, a, b)]


def _part(cut: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """``cut`` with a piece for each of ``spans``."""
    for a, b in spans:
        cut[a], cut[a + 1:b] = True, False
        cut[b:b + 1] = True
    return cut


def split(data: np.ndarray, offsets: np.ndarray, keep_space: bool, special: re.Pattern | None = None):
    """Piece starts and ends, and the first piece of each document."""
    spans = _spelled(data, offsets, special)
    if keep_space:
        cut = _part(_cuts(data) | _spaces(data), spans)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)
    starts, stops, _ = W.word_bounds(data, offsets)
    inner = np.flatnonzero(_part(_cuts(data), spans))
    inside = np.searchsorted(starts, inner, "right") - 1
    ok = inside >= 0
    inner, inside = inner[ok], inside[ok]
    inner = inner[(inner > starts[inside]) & (inner < stops[inside])] if len(starts) else inner[:0]
    starts, stops = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([stops, inner]))
    return starts, stops, np.searchsorted(starts, offsets)


class Encoder:
    """Encodes the pieces of many texts and keeps what it has seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(n.encode()) for n in names)) if names else None
        self.keep_space = self.tokenizer.encode_batch_fast(["a b"], add_special_tokens=False)[0].ids != \
            self.tokenizer.encode_batch_fast(["a  b"], add_special_tokens=False)[0].ids
        self._clear()

    def _clear(self):
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, texts: list[str]):
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum()))
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, ids])
        order = np.argsort(hashes)
        place = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, place, hashes[order])
        self.at, self.size = np.insert(self.at, place, at[order]), np.insert(self.size, place, size[order])

    def _find(self, seen: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Places of hashes among the known ones; sought in ``order``, neighbours lie in the same cache lines."""
        at = np.empty(len(seen), np.int64)
        at[order] = np.searchsorted(self.known, seen[order])
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, and where each document's begin."""
        starts, stops, first = split(data, offsets, self.keep_space, self.special)
        codes, seen = pd.factorize(W.span_hashes(data, starts, stops))
        if not len(seen):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.known) > KEPT_PIECES:
            self._clear()
        order = np.argsort(seen)
        at = self._find(seen, order)
        new = at == len(self.known)
        new[~new] = self.known[at[~new]] != seen[~new]
        if new.any():
            top = np.maximum.accumulate(codes)
            example = np.flatnonzero(np.r_[True, top[1:] > top[:-1]])[new]
            raw = data.tobytes()
            self._learn(seen[new], [raw[a:b].decode(errors="replace") for a, b in zip(starts[example].tolist(), stops[example].tolist())])
            at = self._find(seen, order)
        size = self.size[at][codes].astype(np.int64)
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        ids = self.pool[np.repeat(self.at[at][codes] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[first]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str):
    """Per run of documents: (i, j, ids, first id of each document)."""
    data, offsets = W.buffers(column)
    for i, j in W.pieces(offsets, 2 * W.PIECE):
        ids, first = encoder(path).encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        yield i, j, ids, first
