"""Packing documents into sequences by sum of squares.

A document's ids (with an end id) are cut into whole windows of ``capacity`` ids, which
are sequences of their own, and a remainder.  Remainders are placed online: with N(h)
partially filled windows at fill level h, a remainder of s ids goes to the level whose
choice gives the smallest sum of N(h)^2 over all partially filled levels; a new window
counts as level 0.  Levels are tracked in one array, and ties go to the fullest level.

Packing is independent in every input split, so nothing is shuffled and a lost task is
repeated alone; sequence ids are ``split << 33 | number``.  When a split ends, its open
windows (few, by the rule above) are closed: fuller windows are filled up with pieces cut
from emptier ones, and the last one is cut into powers of two, the lengths that take no
padding.  A split therefore ends with no padding at all.

Edge cases: a null or empty text is one end id; very long texts are cut, never shortened;
repeated rows are packed one by one; an empty table gives an empty result; columns other
than id and text are ignored.  The result depends on how the input is split, as packing
must; ids, cuts and coverage do not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalake.llm import textkernel as tk
from chromalake.llm.tokens import encoder
from chromalake.runtime import lean, ship_package, small_batches

CAPACITY, END_ID = 2048, 1


class SumOfSquares:
    """Open windows by fill level; a window is a list of (item, size) pieces."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def level(self, size: int) -> int:
        """The fill level to put ``size`` at; 0 opens a window."""
        c, n = self.capacity, self.count
        # change of the sum of squares: leaving h takes 2N(h)-1 away, arriving at h+s adds 2N(h+s)+1
        arrive = 2 * n[size:] + 1
        arrive[c - size] = 0  # a full window is not partially filled
        change = arrive
        change[1:] -= 2 * n[1 : c - size + 1] - 1
        usable = n[: c - size + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        best = change.min()
        return int(np.flatnonzero(change == best)[-1])

    def put(self, item, size: int) -> list | None:
        """Places an item; returns the window if that filled it."""
        h = self.level(size)
        window = self.open[h].pop() if h else []
        if h:
            self.count[h] -= 1
        window.append((item, size))
        if h + size == self.capacity:
            return window
        self.open[h + size].append(window)
        self.count[h + size] += 1
        return None

    def rest(self) -> list[tuple[int, list]]:
        """The open windows, fullest first, which are closed thereby."""
        out = [(h, w) for h in range(self.capacity, 0, -1) for w in self.open[h]]
        self.__init__(self.capacity)
        return out


def close(windows: list[tuple[int, list]], capacity: int) -> list[list[tuple]]:
    """Sequences of (item, from, size) without padding, from windows of (item, size)."""
    full, left = [], [[(item, 0, size) for item, size in w] for _, w in windows]
    fill = [h for h, _ in windows]
    a, b = 0, len(left) - 1
    while a < b:
        room = capacity - fill[a]
        while room and a < b:  # pieces come from the end of the emptiest window
            item, at, size = left[b].pop()
            cut = min(room, size)
            left[a].append((item, at + size - cut, cut))
            if cut < size:
                left[b].append((item, at, size - cut))
            room -= cut
            fill[a] += cut
            fill[b] -= cut
            if not left[b]:
                b -= 1
        if fill[a] == capacity:
            full.append(left[a])
            a += 1
    if a == b and fill[a]:
        power, now, have = capacity, [], 0
        pieces = left[a][::-1]
        total = fill[a]
        while total:
            while power > total:
                power //= 2
            while have < power:
                item, at, size = pieces.pop()
                cut = min(power - have, size)
                now.append((item, at, cut))
                if cut < size:
                    pieces.append((item, at + cut, size - cut))
                have += cut
            full.append(now)
            total -= power
            now, have = [], 0
    return full


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs one split; ``rows`` are finished pieces. Open windows keep their ids."""

    def __init__(self, split: int, capacity: int, with_ids: bool):
        self.capacity, self.with_ids = capacity, with_ids
        self.bins = SumOfSquares(capacity)
        self.next = split << 33
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        """Pieces ((doc_id, start, doc_tokens, ids), from, size) of one sequence."""
        at = 0
        for (doc, start, total, ids), a, size in pieces:
            part = ids[a : a + size]
            self.rows.append((doc, start + a, size, _crc(part), total, self.next, at, *([part] if self.with_ids else [])))
            at += size
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        n, c = len(ids), self.capacity
        whole = n - n % c
        for a in range(0, whole, c):
            self.emit([((doc, a, n, ids[a : a + c]), 0, c)])
        if n > whole and (done := self.bins.put((doc, whole, n, ids[whole:].astype(np.uint32)), n - whole)):
            self.emit([(item, 0, size) for item, size in done])

    def finish(self) -> None:
        for pieces in close(self.bins.rest(), self.capacity):
            self.emit(pieces)

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * (7 + self.with_ids)
        self.rows = []
        schema = _SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if self.with_ids else _SCHEMA
        arrays = [pa.array(c, f.type) for c, f in zip(cols[:7], _SCHEMA, strict=True)]
        if self.with_ids:
            arrays.append(pa.array([np.asarray(x).astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: its place in its document and in its sequence; ``with_ids`` adds the ids."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, enc = Packer(TaskContext.get().partitionId(), capacity, with_ids), encoder(tokenizer)
        for batch in batches:
            for i, j, buf, off in tk.slices(batch.column(1), 2 << 20):
                ids, bounds = enc.encode(buf, off)
                for d, doc in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    packer.add(doc, np.append(ids[bounds[d] : bounds[d + 1]], np.uint32(end_id)))
                yield packer.batch()
        enc.forget()
        packer.finish()
        yield packer.batch()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _DDL + (", ids array<int>" if with_ids else ""))


def op7_sum_of_squares(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
