"""Byte-level numpy kernels over batches of texts.

A batch of texts is one contiguous UTF-8 buffer with offsets, exactly as Arrow
holds it.  Words are runs of bytes outside ``\\x20 \\x09-\\x0D``; none of these
separators occurs inside a multi-byte UTF-8 sequence, so byte-level splitting
equals code-point-level splitting.  A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift-multiply); bijective."""
    x = x + _C1
    x = (x ^ (x >> U64(30))) * _C2
    x = (x ^ (x >> U64(27))) * _C3
    return x ^ (x >> U64(31))


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, buffer, offsets) of runs of whole texts of about ``limit`` bytes.

    A single longer text makes a slice of its own; texts are never cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


@dataclass
class Words:
    """Words of a slice: byte spans, and the first word of each text (with an end)."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(buf: np.ndarray, off: np.ndarray) -> Words:
    n = len(buf)
    gap = SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[:1] = True
    before[1:] = gap[:-1]
    start = np.flatnonzero(~gap & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = True
    after[:-1] = gap[1:]
    end = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return Words(buf, start, end, np.searchsorted(start, off))


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(buf) + 1,), (1,))
    size = end - start
    h = mix(size.astype(np.uint64) ^ U64(seed))
    live = np.arange(len(start))
    at, left = start, size
    while True:
        if (keep := left > 0).sum() < len(left):
            live, at, left = live[keep], at[keep], left[keep]
        if not len(live):
            return h
        v = eight[at]
        short = left < 8
        v = np.where(short, v & ((U64(1) << (np.minimum(left, 7).astype(np.uint64) * U64(8))) - U64(1)), v)
        h[live] = mix(h[live] ^ (v * _C2))
        at, left = at + 8, left - 8


def fold(h: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Ordered combination of two hash columns."""
    return mix((h << U64(7) | h >> U64(57)) * _C3 + nxt)


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of every window of ``width`` words in one text."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc_end = np.repeat(first[1:], np.diff(first))  # end of each word's text
    at = np.flatnonzero(np.arange(n) + width <= doc_end[:n])
    g = h[at]
    for j in range(1, width):
        g = fold(g, h[at + j])
    return g, at


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all sets end to end, sorted and distinct; bounds; word counts) of lower-cased texts.

    With fewer words than ``width`` the whole sequence is the only shingle; a text
    without words has an empty set.
    """
    w = words(LOWER[buf], off)
    h = span_hash(w.buf, w.start, w.end)
    g, at = windows(h, w.first, width)
    counts = w.counts
    per = np.maximum(counts - width + 1, 0)
    bound = np.concatenate([[0], np.cumsum(per)])
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for d in range(len(counts)):
        if per[d]:
            s = np.sort(g[bound[d] : bound[d + 1]])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif counts[d]:
            a, b = w.first[d], w.first[d + 1]
            s = mix(h[a : a + 1] ^ U64(b - a))
            for j in range(a + 1, b):
                s = fold(s, h[j : j + 1])
        else:
            continue
        sets.append(s)
        sizes[d] = len(s)
    return (
        np.concatenate(sets) if sets else np.zeros(0, np.uint64),
        np.concatenate([[0], np.cumsum(sizes)]),
        counts,
    )


def binary_column(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of slices of ``data``; bounds are in items."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(
        pa.binary(),
        len(bounds) - 1,
        [None, pa.py_buffer((np.asarray(bounds) * data.itemsize).astype(np.int32)), pa.py_buffer(data)],
    )
