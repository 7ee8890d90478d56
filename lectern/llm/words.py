"""Vectorised hashing of the words of a whole Arrow string column.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are polynomial in the
word's bytes modulo 2**64, then mixed, so they depend on the bytes alone and agree in every task.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_libc = ctypes.CDLL(None)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE, np.uint64)]))
    return _powers[:n]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(wide), b"" if wide == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def _cut(data: np.ndarray, off: np.ndarray, at: int) -> int:
    """End of the piece that begins at `at`: about PIECE bytes, never inside a word."""
    n = len(data)
    if at + PIECE >= n:
        return n
    doc = int(off[np.searchsorted(off, at + PIECE, side="right") - 1])
    if doc > at:
        return doc
    spaces = np.flatnonzero(SPACE[data[at : at + PIECE]])
    if len(spaces) and spaces[-1] > 0:
        return at + int(spaces[-1])
    stop = int(off[np.searchsorted(off, at, side="right")])
    for lo in range(at + PIECE, stop, PIECE):
        spaces = np.flatnonzero(SPACE[data[lo : min(lo + PIECE, stop)]])
        if len(spaces):
            return lo + int(spaces[0])
    return stop


def hash_words(column: pa.Array, fold: bool = True, tail_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): document i has the words hashes[offsets[i]:offsets[i + 1]], in order.

    fold lower-cases A-Z. The low tail_bits bits of a hash are those of the word's last byte.
    """
    data, off = string_bytes(column)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = _cut(data, off, at)
        seg = data[at:end]
        solid = ~SPACE[seg]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        inside = off[np.searchsorted(off, at, side="left") : np.searchsorted(off, end, side="left")] - at
        begin[inside] = solid[inside]
        first = np.flatnonzero(begin)
        if len(first):
            index = np.flatnonzero(solid)
            lead = (np.cumsum(solid) - 1)[first]
            size = np.diff(np.append(lead, len(index)))
            place = np.arange(len(index)) - np.repeat(lead, size)
            byte = (FOLD[seg[index]] if fold else seg[index]).astype(np.uint64) + np.uint64(1)
            value = mix(np.add.reduceat(byte * powers(int(size.max()))[place], lead))
            if tail_bits:
                low = np.uint64((1 << tail_bits) - 1)
                value = (value & ~low) | ((byte[lead + size - 1] - np.uint64(1)) & low)
            hashes.append(value)
            starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off, side="left")


def hash_shingles(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each document; one of fewer words has one run of them all, one of no words none."""
    counts = np.diff(offsets)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_off = np.concatenate([np.zeros(1, np.int64), np.cumsum(runs)])
    if not len(words):
        return np.zeros(0, np.uint64), out_off
    at = np.arange(int(out_off[-1])) - np.repeat(out_off[:-1] - offsets[:-1], runs)
    end = np.repeat(offsets[1:], runs)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        here = at + k
        total = total * np.uint64(BASE) + np.where(here < end, words[np.minimum(here, len(words) - 1)], np.uint64(0))
    return mix(total), out_off


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Slices of a batch whose texts have about `limit` bytes each, at least one row each."""
    _, off = string_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    release()


def release() -> None:
    """Give freed memory back: workers stay alive between tasks, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
