"""Vectorised word splitting and hashing over Arrow text buffers, shared by the operators.

A block is a run of whole documents held as one ``uint8`` buffer with row offsets.  Words are
maximal runs of bytes other than 0x20 and 0x09-0x0D; these bytes never occur inside a UTF-8
sequence, so splitting bytes equals splitting text.  A word's hash takes in eight bytes at a
time; beyond 64 bytes it goes on with a polynomial over tabulated random values of the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_INV = pow(_BASE, -1, 1 << 64)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SEGMENT = 1 << 20
_ROUND, _LENGTH = (np.uint64(int(_RNG.integers(1, 1 << 62)) * 2 + 1) for _ in range(2))
#: Which bits of eight bytes count, by the bytes that a word still has.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word hashed eight at a time.
_SHORT = 64
_AT_ONCE = 1 << 14


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_POW[0]) < n:
        for k, b in enumerate((_BASE, _INV)):
            out = np.full(n, np.uint64(b), np.uint64)
            out[0] = 1
            _POW[k] = np.cumprod(out, dtype=np.uint64)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finishing step on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """Whole documents: their other columns, text bytes and row offsets into them."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: arrays of 4 MB go back to the system as soon as they are freed
except (OSError, AttributeError):  # another C library
    _LIBC = None


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and else keep the most that any task needed."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[Block]:
    """Cut batches into blocks of about ``limit`` bytes of text; null texts count as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        if col.null_count:
            col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
        wide = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
        col = col.cast(wide)
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), len(col))
            yield Block(batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at])
            at = to
        del batch, col, raw, data, off
        give_back()


def split_words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each row the number of words before it (rows + 1)."""
    n = len(block.data)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = (block.data == 0x20) | (block.data - np.uint8(9) < 5)
    # a row boundary ends a word: starts are found in a copy of the flags where it counts as a gap
    edge = gap[1:] != gap[:-1]
    change = np.flatnonzero(edge)
    starts, ends = change[0::2], change[1::2]
    inner = block.offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    if len(inner) and len(starts):
        at = np.searchsorted(starts, inner, "left") - 1
        cut = inner[(at >= 0) & (starts[np.maximum(at, 0)] < inner) & (inner < ends[np.maximum(at, 0)])]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, block.offsets, "left")


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy of the bytes with A-Z lowered."""
    return data | (data - np.uint8(0x41) < 26).view(np.uint8) << np.uint8(5)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    raw = np.zeros(len(data) // 8 * 8 + 16, np.uint8)
    raw[: len(data)] = lowered(data) if lower else data
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(out), _AT_ONCE):  # arrays that stay in the processor's cache
        out[k : k + _AT_ONCE] = _hash(raw, starts[k : k + _AT_ONCE], ends[k : k + _AT_ONCE] - starts[k : k + _AT_ONCE])
    return out


def _hash(raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    out, eight = size.astype(np.uint64) * _LENGTH, raw.view("<u8")
    live, at, rest = slice(None), starts, size
    for _ in range(_SHORT // 8):
        place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        value = (eight[place] >> shift | eight[place + 1] << np.uint64(64) - shift) & _MASK[np.minimum(rest, 8)]
        h = (out[live] ^ value) * _ROUND
        out[live] = h ^ h >> np.uint64(32)
        more = np.flatnonzero(rest > 8)
        if not len(more):
            return mix(out)
        live, at, rest = (more if isinstance(live, slice) else live[more]), at[more] + 8, rest[more] - 8
    # what is left of long words, side by side
    ends_ = np.cumsum(rest)
    out[live] ^= _polynomial(raw[np.repeat(at - ends_ + rest, rest) + np.arange(ends_[-1])], ends_ - rest, ends_)
    return mix(out)


def _polynomial(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(ends, starts[at] + _SEGMENT, "right"))
        to = max(to, at + 1)
        lo, hi = int(starts[at]), int(ends[to - 1])
        pw, inv = powers(max(hi - lo, _SEGMENT))
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_TABLE[data[lo:hi]] * pw[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive word hashes (``len - k + 1`` of them), by doubling."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n, have, out = len(hashes) - k + 1, 0, np.zeros(len(hashes) - k + 1, np.uint64)
    run, width = hashes, 1
    rest = k
    while rest:
        if rest & 1:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + run[have : have + n])
            have += width
        rest >>= 1
        if rest:
            m = len(run) - width
            run = mix(run[:m] * np.uint64(0xD6E8FEB86659FD93) + run[width : width + m])
            width *= 2
    return out


def take(block: Block, columns: list[str]) -> list[pa.Array]:
    return [block.rows.column(block.rows.schema.get_field_index(c)) for c in columns]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Places:
    """Where hashes stand among sorted distinct ones, by a table over their leading bits."""

    def __init__(self, words: np.ndarray):
        self.words, bits = words, max(1, len(words).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.append(np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(words)).astype(np.int32)

    def __getstate__(self) -> np.ndarray:
        return self.words

    def __setstate__(self, words: np.ndarray) -> None:
        self.__init__(words)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or their number."""
        out = np.full(len(hashes), len(self.words), np.int32)
        if not len(self.words):
            return out
        slot = (hashes >> self.shift).astype(np.int64)
        at, end, live = self.first[slot], self.first[slot + 1], None
        while True:
            keep = np.flatnonzero(at < end)
            if not len(keep):
                return out
            hashes, at, end, live = hashes[keep], at[keep], end[keep], keep if live is None else live[keep]
            hit = self.words[at] == hashes
            out[live[hit]] = at[hit]
            at = at + 1
            at[hit] = end[hit]
