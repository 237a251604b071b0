"""Hashes of words and of word windows, computed over whole Arrow buffers with numpy.

A word is a run of bytes other than the ASCII white space 0x20 and 0x09-0x0D. UTF-8 never uses
those bytes inside a longer character, so words are found on bytes. A word's hash is a polynomial
over its bytes modulo 2**64, taken as a difference of prefix sums; a window's hash is the
Rabin-Karp polynomial over its word hashes, again as a difference of prefix sums. Both are mixed
at the end. Work goes on in pieces of about ``PIECE`` bytes, so temporaries stay small however
long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_P, _Q = np.uint64(0x9E3779B97F4A7C13), np.uint64(0xD1B54A32D192ED03)
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * PIECE:
            _powers[int(base)] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _K1
    h = (h ^ (h >> np.uint64(27))) * _K2
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _P)
_LOWER = _BYTES.copy()
_LOWER[0x41:0x5B] = _BYTES[0x61:0x7B]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(where, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents with at most ``limit`` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each document the index of its first word.

    ``between`` flags the bytes that part words.
    """
    space = between[data]
    before = np.empty(len(data), bool)
    before[1:] = space[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = True
    starts = np.flatnonzero(before & ~space)
    after = np.empty(len(data), bool)
    after[:-1] = space[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = True
    stops = np.flatnonzero(after & ~space) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are ascending and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    table, i = _LOWER if lower else _BYTES, 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(stops, base + PIECE, "right")))
        part = data[base:stops[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * powers(_P, len(part)), out=sums[1:])
        s, e = starts[i:j] - base, stops[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * powers(_inverse(_P), len(part))[s] + (e - s).astype(np.uint64)
        i = j
    return mixed(out)


def window_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every run of ``k`` words inside a document, and each document's first.

    Documents with fewer words have none.
    """
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    where = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=where[1:])
    starts = np.arange(where[-1]) + np.repeat(first[:-1] - where[:-1], counts)
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), PIECE):
        s = starts[i:i + PIECE]
        base = s[0]
        part = hashes[base:s[-1] + k]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(_Q, len(part)), out=sums[1:])
        out[i:i + PIECE] = (sums[s - base + k] - sums[s - base]) * powers(_inverse(_Q), len(part))[s - base]
    return mixed(out), where


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``window_hashes``, but a document of 1 to k-1 words has one shingle, its whole sequence."""
    out, where = window_hashes(hashes, first, k)
    words = np.diff(first)
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = words[short] > j
            whole[has] = whole[has] * _Q + hashes[first[short[has]] + j]
        out = np.insert(out, where[short], mixed(whole + words[short].astype(np.uint64)))
        where = where + np.concatenate([[0], np.cumsum((words > 0) & (words < k))])
    return out, where


def doc_words(column: pa.Array, lower: bool = False, limit: int = PIECE, between: np.ndarray = _SPACE):
    """Per run of documents: (i, j, word hashes, first word of each document)."""
    data, offsets = buffers(column)
    for i, j in pieces(offsets, limit):
        part = data[offsets[i]:offsets[j]]
        starts, stops, first = word_bounds(part, offsets[i:j + 1] - offsets[i], between)
        yield i, j, span_hashes(part, starts, stops, lower), first


def segment_of(first: np.ndarray) -> np.ndarray:
    """Document index of every element, from each document's first element."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
