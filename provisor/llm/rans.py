"""Range coding of token ids with asymmetric numeral systems and one static table.

A block is coded on its own: id number ``i`` belongs to lane ``i % lanes``, all lanes share one
stream of 32-bit words, and each numpy step codes one id of every lane. Checkpoints hold the
lanes' states and the place in the stream, so several readers can decode parts of one block.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

SCALE = 20
LANES, CHECKPOINT = 1024, 1 << 18
_LOW = np.uint64(1 << 31)
_K, _32 = np.uint64(SCALE), np.uint64(32)
_MAGIC, _HEAD = b"RAN1", "<4sIIQQII"


@dataclass
class Table:
    """Frequencies that sum to 2**SCALE; an id that occurs has one at least."""

    freq: np.ndarray

    def __post_init__(self):
        self.freq = self.freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Scale counts to the table's sum; at most 2**SCALE ids can occur."""
        counts = counts.astype(np.float64)
        if not counts.sum():
            return cls(np.zeros(len(counts), np.uint64))
        if np.count_nonzero(counts) > 1 << SCALE:
            raise ValueError("more distinct ids than the table can hold")
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts * ((1 << SCALE) / counts.sum()))), 0).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        over = int(freq.sum()) - (1 << SCALE)
        if over <= 0:
            freq[order[0]] -= over
        while over > 0:
            for i in order:
                take = min(over, int(freq[i]) // 2)
                freq[i] -= take
                over -= take
                if not over:
                    break
        return cls(freq)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> bytes:
    """One block: header, lane states and stream places at each checkpoint, stream, checksum."""
    n = len(ids)
    lanes = max(1, min(lanes, n >> 6))
    freq, start = table.freq[ids], table.start[ids]
    state = np.full(lanes, _LOW, np.uint64)
    steps, every = -(-n // lanes), max(1, checkpoint // lanes)
    words, marks = [], []
    for t in range(steps - 1, -1, -1):
        lo = t * lanes
        f, c = freq[lo:lo + lanes], start[lo:lo + lanes]
        x = state[:len(f)]
        full = x >= (f << np.uint64(63 - SCALE))
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> _32, x)
        q = x // f
        state[:len(f)] = (q << _K) + (x - q * f) + c
        if t % every == 0:
            marks.append((t, state.copy()))
    words.reverse()
    sizes = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    stream = np.concatenate(words) if words else np.zeros(0, "<u4")
    marks.reverse()
    body = b"".join(struct.pack("<Q", int(sizes[t])) + x.astype("<u8").tobytes() for t, x in marks) + stream.tobytes()
    return struct.pack(_HEAD, _MAGIC, lanes, every, n, len(stream), table.crc, zlib.crc32(ids.astype("<u4").tobytes())) + body


def parts(payload: bytes) -> int:
    """Number of checkpoints of a block."""
    _, lanes, every, n, _, _, _ = struct.unpack_from(_HEAD, payload)
    return -(-(-(-n // lanes)) // every)


def decode_part(payload: bytes, table: Table, part: int) -> np.ndarray:
    """The ids from one checkpoint to the next."""
    magic, lanes, every, n, size, crc, _ = struct.unpack_from(_HEAD, payload)
    if magic != _MAGIC or crc != table.crc:
        raise ValueError("not a block of this table")
    at = struct.calcsize(_HEAD) + part * (8 + 8 * lanes)
    place = struct.unpack_from("<Q", payload, at)[0]
    x = np.frombuffer(payload, "<u8", lanes, at + 8).astype(np.uint64)
    stream = np.frombuffer(payload, "<u4", size, len(payload) - 4 * size)
    first, last = part * every, min((part + 1) * every, -(-n // lanes))
    out = np.empty(min(n, last * lanes) - first * lanes, np.uint32)
    mask, slots, freq, start = np.uint64((1 << SCALE) - 1), table.slots, table.freq, table.start
    for lo in range(0, len(out), lanes):
        y = x[:len(out) - lo]
        slot = y & mask
        ids = slots[slot]
        out[lo:lo + lanes] = ids
        y = freq[ids] * (y >> _K) + slot - start[ids]
        low = np.flatnonzero(y < _LOW)
        y[low] = (y[low] << _32) | stream[place:place + len(low)]
        place += len(low)
        x[:len(y)] = y
    return out


def decode(payload: bytes, table: Table) -> np.ndarray:
    """All ids of a block; raises if the checksum is wrong."""
    ids = np.concatenate([decode_part(payload, table, p) for p in range(parts(payload))] or [np.zeros(0, np.uint32)])
    if zlib.crc32(ids.astype("<u4").tobytes()) != struct.unpack_from(_HEAD, payload)[6]:
        raise ValueError("wrong checksum")
    return ids
