"""Words of Arrow text columns as numpy arrays.

A word is a maximal run of characters other than space and U+0009 to U+000D.
Everything works on the UTF-8 bytes of many texts at once: positions of words,
64-bit hashes of words and of runs of words. Texts are never cut.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LONG = 2048
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U64)
ROLL = 0x9FB21C651E98DF25  # odd multiplier of the rolling hash over words


def trim() -> None:
    """Gives freed memory back to the system: workers are kept for later tasks, beside others of their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span: eight bytes a step for all spans that are still going, whole ones from `LONG` bytes on."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = (ends - starts).astype(np.int64)
    out = mix(left.astype(U64) + U64(0x632BE59BD9B4E019))
    live, at = np.flatnonzero(left < LONG), starts.astype(np.int64)
    for i in np.flatnonzero(left >= LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    while len(live):
        part = eight[at[live]] & _LOW[np.minimum(left[live], 8)]
        out[live] = mix(out[live] * U64(0x9E3779B97F4A7C15) ^ part)
        at[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    return out


class Words:
    """Words of some texts: `starts`, `ends` (in `data`) and `first` (word number where each text begins; one more at the end)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        inside = ~SPACE[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        edge = bounds[bounds < len(data)]
        before[edge] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        last = bounds[bounds > 0] - 1
        after[last] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self._hash: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.data, self.starts, self.ends)
        return self._hash

    @property
    def text_of(self) -> np.ndarray:
        """Number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each text begins (one more at the end); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts in runs of about `size` bytes: (first row, row after the last, bytes, bounds). A longer text is a run of its own."""
    data, at = buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def runs_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each run of n neighbours (one for each start; none if there are fewer than n)."""
    if len(words) < n:
        return np.zeros(0, U64)
    out, done, level, width = None, 0, words, 1
    while True:
        if n & width:
            if out is None:
                out, done = level, width
            else:
                m = len(words) - done - width + 1
                out = out[:m] * U64(pow(ROLL, width, 1 << 64)) + level[done : done + m]
                done += width
        width *= 2
        if width > n:
            break
        half = width // 2
        level = level[: len(level) - half] * U64(pow(ROLL, half, 1 << 64)) + level[half:]
    return mix(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers starts[i] .. starts[i] + lengths[i] - 1, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return base + np.arange(total)


def count_in(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of `mask` are set between each two neighbours of `bounds`."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), bounds))


def per_text(texts: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(texts, minlength=n).astype(np.int64)
