"""Text columns as NumPy arrays inside Spark tasks.

Spark hands a task Arrow batches; these helpers look at a string column as one
byte buffer with document offsets, so words, hashes and windows of thousands of
documents are found with a few array operations and no per-word Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The word separators of the contracts, space and 0x09-0x0D.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown in doublings."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < n:
            step = np.uint64(pow(base, len(out), 1 << 64))
            out = np.concatenate([out, out * step])
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit integers (xor-shift and multiply rounds)."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def release_memory() -> None:
    """Give freed memory back: Python workers live on after a task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offs = column_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < n:
            end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
            end = min(n, max(at + 1, end))
            yield batch.slice(at, end - at)
            at = end
        del batch
        release_memory()


class Words:
    """The words of a piece: runs of bytes other than the separators, never across rows."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.buf, self.offsets = column_bytes(column)
        if lower:
            self.buf = _LOWER[self.buf]
        n = len(self.buf)
        solid = ~_IS_SPACE[self.buf]
        first = np.empty(n, dtype=bool)
        last = np.empty(n, dtype=bool)
        if n:
            first[0], last[-1] = True, True
            first[1:] = ~solid[:-1]
            last[:-1] = ~solid[1:]
            edges = self.offsets[1:-1]
            first[edges[edges < n]] = True
            last[edges[edges > 0] - 1] = True
        self.solid = solid
        self.starts = np.flatnonzero(first & solid)
        self.ends = np.flatnonzero(last & solid) + 1
        #: number of words before each row, n + 1 values
        self.row_words = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row_words)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal wherever the word is equal."""
        return span_hashes(self.buf, self.starts, self.ends)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words, each followed by one space, and where each starts and ends there."""
        lengths = self.ends - self.starts
        ends = np.cumsum(lengths + 1) - 1
        out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, dtype=np.uint8)
        keep = np.ones(len(out), dtype=bool)
        keep[ends] = False
        out[keep] = self.buf[self.solid]
        return out, ends - lengths, ends


#: hashes are computed over so many values at a time, which keeps the arrays in cache and memory small
BLOCK = 1 << 19
#: keeps the first 0 .. 8 bytes of eight
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; behind the end are zeros."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def span_chunks(view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, number in its span, first chunk of each span): spans of eights() cut into chunks of eight bytes."""
    n = np.maximum((ends - starts + 7) >> 3, 1)
    first = np.cumsum(n) - n
    number = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(starts, n) + 8 * number
    return view[at] & _HEAD[np.minimum(np.repeat(ends, n) - at, 8)], number, first


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each buf[start:end].

    Chunks of eight bytes are scrambled together with their number in the span and summed up. No
    polynomial is formed over the bytes: modulo 2**64 those are equal for different self-similar texts.
    """
    view, out = eights(buf), np.empty(len(starts), dtype=np.uint64)
    longest = int((ends - starts).max(initial=0))
    salt = mix(np.arange(longest // 8 + 2, dtype=np.uint64), 5)
    for lo in range(0, len(starts), BLOCK // 4):
        a, b = starts[lo : lo + BLOCK // 4], ends[lo : lo + BLOCK // 4]
        value, number, first = span_chunks(view, a, b)
        sums = np.add.reduceat(mix(value ^ salt[number], 6), first)
        out[lo : lo + BLOCK // 4] = mix(sums + (b - a).astype(np.uint64), 1)
    return out


def equal_spans(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether each span of eights() ``a`` holds the same bytes as that of ``b``."""
    out = a_ends - a_starts == b_ends - b_starts
    own = np.flatnonzero(out)
    if len(own):
        x, _, first = span_chunks(a, a_starts[own], a_ends[own])
        y, _, _ = span_chunks(b, b_starts[own], b_ends[own])
        out[own] = np.logical_and.reduceat(x == y, first)
    return out


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; out[i] covers values[i : i + k].

    A polynomial modulo 2**64: fit for k of a few hundred at most. Callers that take equal
    hashes for equal values must scramble the values first; over raw ones, compare what is equal.
    """
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for low in range(0, n, BLOCK):
        m = min(BLOCK, n - low)
        sums = np.zeros(m + k, dtype=np.uint64)
        sums[1:] = values[low : low + m + k - 1]
        sums[1:] += np.uint64(1)
        sums[1:] *= _power_table(_BASE, m + k - 1)
        np.cumsum(sums, out=sums)
        out[low : low + m] = mix((sums[k:] - sums[:m]) * _power_table(_BASE_INVERSE, m), 2)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(values[i : i + width]), by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def shingles(words: Words, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k-word shingle, repeats included, ordered by row.

    With ``short``, a row of 1 to k - 1 words has its whole sequence as one shingle.
    """
    h = words.hashes()
    counts = words.counts
    per_row = np.maximum(counts - k + 1, 0)
    windows = window_hashes(h, k)
    first = words.row_words[:-1]
    if len(windows):
        inside = np.ones(len(windows), dtype=bool)
        # a window crosses into the next row if it starts in a row's last k - 1 words
        for back in range(1, k):
            at = words.row_words[1:] - back
            at = at[(at >= first) & (at < len(windows))]
            inside[at] = False
        hashed = windows[inside]
    else:
        hashed = windows
    rows = np.repeat(np.arange(len(counts)), per_row)
    if short:
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            extra = np.empty(len(few), dtype=np.uint64)
            for i, r in enumerate(few):
                part = h[first[r] : first[r] + counts[r]]
                extra[i] = mix(window_hashes(part, len(part)), 3 + len(part))[0]
            hashed = np.concatenate([hashed, extra])
            rows = np.concatenate([rows, few])
            order = np.argsort(rows, kind="stable")
            hashed, rows = hashed[order], rows[order]
    return rows, hashed


def distinct_by_row(rows: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without repeats, sorted by row, then hash."""
    if not len(rows):
        return rows, hashed
    order = np.lexsort((hashed, rows))
    rows, hashed = rows[order], hashed[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashed[1:] != hashed[:-1])
    return rows[new], hashed[new]
