"""Words of a column of texts as NumPy arrays, and 64-bit hashes of them.

A word's hash (or a line's) is a sum over its blocks of eight bytes, each mixed
with its place before it is added. The hash of a window of words is a sum of
their hashes times powers of an odd number, taken from prefix sums, so that all
windows cost one pass. Sums modulo 2^64 of powers alone are unsafe for long runs
(two words of a thousand letters in the Thue-Morse order would agree), which is
why bytes are not summed that way and windows are short. Two given different
runs share a hash about once in 2^64 times.
"""

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_SPAN = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; n is a power of two."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        out.append(p)
    return out[0], out[1]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every pair of a short run; starts do not
    decrease."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + _SPAN)))
        high = int(ends[i:j].max())
        size = 1 << max(8, int(high - low).bit_length())
        power, inverse = _powers(size)
        part = values[low:high]
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((_VALUE[part] if values.dtype == np.uint8 else part) * power[:high - low], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(_BASE))
        i = j
    return out


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for every pair, by its blocks of eight bytes."""
    size = (ends - starts).astype(np.int64)
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words_at = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    value = words_at[np.repeat(starts, blocks) + 8 * place]
    left = np.repeat(size, blocks) - 8 * place
    short = left < 8
    value[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
    mixed = np.append(mix(value + (place + 1).astype(np.uint64) * np.uint64(_BASE)), np.uint64(0))
    total = np.where(blocks > 0, np.add.reduceat(mixed, first), np.uint64(0)) if len(size) else np.zeros(0, np.uint64)
    return mix(total + size.astype(np.uint64) * np.uint64(_BASE))


class Words(NamedTuple):
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first[d]:first[d + 1] are the words of text d
    hashes: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    buffers, k = texts.buffers(), texts.offset
    offsets = np.frombuffer(buffers[1], np.int64, len(texts) + 1, k * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Runs of anything but ASCII white space, with their hashes."""
    data, offsets = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | begins[1:-1]
    closes = inside
    closes[:-1] &= ~inside[1:] | begins[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), byte_hashes(data, starts, ends))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of all runs of `size` words inside one text."""
    last = np.repeat(w.first[1:], np.diff(w.first))
    starts = np.flatnonzero(np.arange(len(last)) + size <= last)
    return starts, run_hashes(w.hashes, starts, starts + size)


def chunks(offsets: np.ndarray, limit: int = 4 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of at most `limit` bytes together, or of one text."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        out.append((i, j))
        i = j
    return out
