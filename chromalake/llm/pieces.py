"""SentencePiece encoding and decoding with batched numpy Viterbi.

A text is normalised (a dummy prefix, white space as U+2581) and falls into chunks at
word starts, which no piece crosses.  Each distinct chunk is encoded once per worker:
chunks of equal length advance together, character by character.  The hashes of all
substrings up to the longest piece probe the sorted keys of the pieces, and for each end
position a vectorised maximum over the candidate pieces stores a backpointer.

* unigram models: the candidate's value is the best value at its start plus its score;
* BPE models: a maximal score sum is not what merging yields, so a candidate is allowed
  only if merging keeps it apart from the piece that ends where it starts (the two pieces,
  merged alone, must come out as these two).  For merging by priority exactly one candidate
  is then left at each position, and the path is the library's result.

Characters without a piece become byte pieces (or the unknown piece).  Decoding joins the
pieces, bytes included, and takes the dummy prefix off.

Edge cases: a null or empty text has no ids and decodes to an empty text; very long texts
and words are encoded whole; repeated rows are encoded row by row; an empty table gives an
empty result; columns other than id and text are ignored.  Normalisers with a character
map, and models with user-defined pieces, are refused when the model is loaded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalake.llm import textkernel as tk
from chromalake.runtime import ship_package

SPACE = 0x2581
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Cached ids of chunks, and the slots (a power of two) of cached verdicts on pairs, per worker.
CACHE_IDS, PAIR_BITS = 6_000_000, 21
_NONE, _ODD = -1, -2  # no piece; a character without a piece


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            n = number()
            yield tag >> 3, data[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", data[i : i + n])[0]
            i += n


def _hash_step(h: np.ndarray, cp: np.ndarray) -> np.ndarray:
    return tk.fold(h, cp.astype(np.uint64))


class PairTable:
    """Verdicts by a non-negative key: open addressing, probed for whole arrays."""

    def __init__(self, bits: int):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.key, self.ok, self.held = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool), 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(verdict, whether it is unknown)."""
        at = self._slot(key)
        got = self.key[at]
        ok = self.ok[at]
        left = np.flatnonzero((got != key) & (got != -1))
        new = got == -1
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            got = self.key[at[left]]
            ok[left] = self.ok[at[left]]
            new[left] = got == -1
            left = left[(got != key[left]) & (got != -1)]
        return ok, new

    def put(self, key: np.ndarray, ok: np.ndarray) -> None:
        if self.held + len(key) > self.mask // 2:
            self.key[:], self.held = -1, 0
        self.held += len(key)
        for k, v, at in zip(key.tolist(), ok.tolist(), self._slot(key).tolist(), strict=True):
            while self.key[at] != -1:
                at = (at + 1) & self.mask
            self.key[at], self.ok[at] = k, v


class Pieces:
    """A model's pieces, and encoding by them."""

    def __init__(self, model: bytes):
        self.text: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        self.type, self.prefix, self.extra, charsmap = UNIGRAM, True, True, b""
        for k, v in _fields(model):
            if k == 1:
                p = dict(_fields(v))
                self.text.append(p.get(1, b"").decode())
                self.score.append(float(p.get(2, 0.0)))
                self.kind.append(int(p.get(3, NORMAL)))
            elif k == 2:
                self.type = int(dict(_fields(v)).get(3, UNIGRAM))
            elif k == 3:
                n = dict(_fields(v))
                self.prefix, self.extra, charsmap = bool(n.get(3, 1)), bool(n.get(4, 1)), n.get(2, b"")
        if self.type not in (UNIGRAM, BPE) or charsmap or USER in self.kind:
            raise ValueError("only unigram and BPE models with the identity normaliser and no user-defined pieces are known")
        self.unk = self.kind.index(UNKNOWN)
        self.bytes = np.full(256, self.unk, np.int32)
        for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)):
            if k == BYTE:
                self.bytes[int(t[3:5], 16)] = i
        self.fallback = BYTE in self.kind
        normal = [i for i, k in enumerate(self.kind) if k in (NORMAL, UNUSED)]
        self.id = {self.text[i]: i for i in normal}
        self.longest = max(len(t) for t in self.id)
        # a chunk starts at each word unless some piece reaches into the next word
        self.split = not any(c != "▁" and d == "▁" for t in self.id for c, d in zip(t, t[1:]))
        self.held = np.zeros(0x110000, bool)
        self.held[[ord(c) for t in self.id for c in t]] = True
        self.value = np.array([*self.score, min(self.score) - 10.0])
        keys = np.array([self._key(self.text[i]) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_id = keys[order], np.array(normal, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("piece keys collide")
        self.raw = [self._raw(i) for i in range(len(self.text))]
        self.pairs = PairTable(PAIR_BITS)
        self.alone = np.full(len(self.text), -1, np.int8)
        self._clear()

    def _clear(self) -> None:
        self.chunk, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _key(t: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in t:
            h = _hash_step(h, np.array([ord(c)]))
        return int(h[0])

    def _raw(self, i: int) -> bytes:
        if self.kind[i] == BYTE:
            return bytes([int(self.text[i][3:5], 16)])
        if self.kind[i] == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if self.kind[i] == CONTROL else self.text[i].replace("▁", " ").encode()

    def merge(self, text: str) -> list[str]:
        """Merging by priority: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                k = self.id.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, where = self.score[k], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _stands(self, ids: np.ndarray) -> np.ndarray:
        """Whether merging a piece's own text gives that piece."""
        for i in np.unique(ids[self.alone[ids] < 0]):
            self.alone[i] = len(self.merge(self.text[i])) == 1
        return self.alone[ids] > 0

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging keeps two pieces apart; odd characters never merge."""
        n = len(self.text)
        free = (left < 0) | (right < 0)
        key = np.where(free, -1, left * n + right)
        ok, new = self.pairs.get(key)
        new &= ~free
        if new.any():
            fresh = np.unique(key[new])
            verdict = [self.merge(self.text[k // n] + self.text[k % n]) == [self.text[k // n], self.text[k % n]] for k in fresh.tolist()]
            self.pairs.put(fresh, np.array(verdict, bool))
            ok[new] = np.array(verdict, bool)[np.searchsorted(fresh, key[new])]
        return ok | free

    def viterbi(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids word after word, their number in each word) of many words of one length."""
        w, n = cp.shape
        found: list[np.ndarray] = []  # found[k][:, s]: the piece at s of k + 1 characters
        h = np.zeros((w, n), np.uint64)
        for k in range(min(self.longest, n)):
            h = _hash_step(h[:, : n - k], cp[:, k:])
            at = np.minimum(np.searchsorted(self.keys, h.ravel()), len(self.keys) - 1)
            found.append(np.where(self.keys[at] == h.ravel(), self.key_id[at], _NONE).reshape(h.shape))
        last = np.full((w, n + 1), _NONE, np.int64)
        back = np.zeros((w, n + 1), np.int64)
        value = np.full((w, n + 1), -np.inf)
        value[:, 0] = 0
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                piece = found[e - s - 1][:, s]
                if s == e - 1:  # a character without a piece stands alone
                    piece = np.where(piece == _NONE, _ODD, piece)
                rows = np.flatnonzero(piece != _NONE)
                if not len(rows):
                    continue
                p = piece[rows]
                if self.type == BPE:
                    ok = np.isfinite(value[rows, s]) & ~np.isfinite(value[rows, e])
                    if s:
                        ok[ok] = self._apart(last[rows[ok], s], p[ok])
                    real = ok & (p >= 0)
                    ok[real] = self._stands(p[real])
                    r, got, p = rows[ok], float(e - s), p[ok]
                else:
                    got = value[rows, s] + self.value[np.where(p < 0, len(self.text), p)]
                    better = got > value[rows, e]
                    r, got, p = rows[better], got[better], p[better]
                value[r, e], last[r, e], back[r, e] = got, p, s
        # all paths are walked back at once
        live, at = np.arange(w), np.full(w, n)
        rows_, from_, got_ = [], [], []
        while len(live):
            got_.append(last[live, at])
            at = back[live, at]
            rows_.append(live)
            from_.append(at)
            live, at = live[at > 0], at[at > 0]
        row, start, piece = np.concatenate(rows_), np.concatenate(from_), np.concatenate(got_)
        order = np.lexsort((start, row))
        row, start, piece = row[order], start[order], piece[order]
        if (piece < 0).any():
            parts: list[list[int]] = []
            for r, k, p in zip(row.tolist(), start.tolist(), piece.tolist(), strict=True):
                odd = self.bytes[list(chr(cp[r, k]).encode())].tolist() if self.fallback else [self.unk]
                again = p < 0 and not self.fallback and parts and parts[-1] == [self.unk]  # unknowns in a row are one
                parts.append([p] if p >= 0 else [] if again else odd)
            count = np.array([len(x) for x in parts])
            return np.array([x for part in parts for x in part], np.int32), np.bincount(row, weights=count, minlength=w).astype(np.int64)
        return piece.astype(np.int32), np.bincount(row, minlength=w)

    def _learn(self, cp: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> None:
        done, flat, counts = [], [self.ids], []
        for n in np.unique(size):
            same = np.flatnonzero(size == n)
            step = max(1, (1 << 22) // (int(n) * min(int(n), self.longest)))  # the tables of a step stay small
            for a in range(0, len(same), step):
                part = same[a : a + step]
                ids, count = self.viterbi(cp[start[part][:, None] + np.arange(n)])
                done.append(keys[part])
                flat.append(ids)
                counts.append(count)
        count = np.concatenate(counts)
        at = len(self.ids) + np.concatenate([[0], np.cumsum(count)[:-1]])
        self.ids = np.concatenate(flat)
        every = np.concatenate([self.chunk, *done])
        order = np.argsort(every, kind="stable")
        self.chunk, self.at, self.size = every[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, count])[order]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, bounds) of a slice of texts."""
        n = len(off) - 1
        if self.extra:  # runs of spaces become one, and none stays at an end
            texts = [b" ".join(x for x in buf[a:b].tobytes().split(b" ") if x) for a, b in zip(off[:-1], off[1:], strict=True)]
            buf, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        cp = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
        cp = np.where(cp == 32, SPACE, cp).astype(np.uint32)
        full = np.diff(chars) > 0
        if self.prefix:
            cp = np.insert(cp, chars[:-1][full], np.uint32(SPACE))
            chars = chars + np.concatenate([[0], np.cumsum(full)])
        begin = np.zeros(len(cp), bool)
        begin[chars[:-1][full]] = True
        if self.split:
            begin[1:] |= (cp[1:] == SPACE) & (cp[:-1] != SPACE)
        if self.fallback:  # a character that no piece holds meets its neighbours in no piece
            begin[1:] |= self.held[cp[1:]] != self.held[cp[:-1]]
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(cp))
        first = np.searchsorted(start, chars)
        keys = tk.span_hash(cp.view(np.uint8), start * 4, end * 4, 31)
        if len(self.ids) > CACHE_IDS:
            self._clear()
        uniq, where = np.unique(keys, return_index=True)
        at = np.searchsorted(self.chunk, uniq)
        fresh = at == len(self.chunk)
        fresh[~fresh] = self.chunk[at[~fresh]] != uniq[~fresh]
        if fresh.any():
            self._learn(cp, start[where[fresh]], (end - start)[where[fresh]], uniq[fresh])
        slot = np.searchsorted(self.chunk, keys)
        size = self.size[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(self.at[slot] - total[:-1], size) + np.arange(total[-1])
        return self.ids[take], total[first]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One model per worker process and file."""
    with open(path, "rb") as f:
        return Pieces(f.read())


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): ``round_trip`` tells whether decoding gives the text back."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for batch in batches:
            for i, j, buf, off in tk.slices(batch.column(1), 4 << 20):
                ids, bounds = m.encode(buf, off)
                same = [m.decode(ids[bounds[d] : bounds[d + 1]]).encode() == buf[off[d] : off[d + 1]].tobytes() for d in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(np.diff(bounds)), pa.array(same)],
                    ["doc_id", "ids", "n_ids", "round_trip"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode(rows: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give an empty text."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for batch in batches:
            texts = [m.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op9_piece_viterbi(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents by the public piece model, decoded again."""
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
