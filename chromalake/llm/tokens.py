"""Token ids of whole texts with a cache of chunks.

Ids are those of the ``tokenizers`` library for a byte-level BPE file whose pre-tokenizer
splits ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
No token crosses a pre-token border, and a single space or line break between two
characters that are no white space always starts a pre-token there.  So a text falls into
chunks at these places, each distinct chunk is encoded by the library once per task, and
a text's ids are its chunks' ids in order.  Texts with white space beyond ASCII are encoded
whole.  The cache is bounded by CACHE_IDS ids and is dropped when full and at the end of a task.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np

from chromalake.llm import textkernel as tk

CACHE_IDS = 6_000_000
_ODD_BYTES = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf")


#: The pre-tokenizer of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_ranks(path: str):
    """(encoder by merge ranks or None, special strings) of a tokenizers file.

    A byte-level BPE whose ids count the merges in order is fully told by its ranks, and
    then a leaner library gives the same ids; any other file is left to ``tokenizers``.
    """
    import tiktoken

    spec = json.loads(open(path, encoding="utf-8").read())
    special = [t["content"] for t in spec.get("added_tokens", [])]
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    if not plain or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None, special
    # printable bytes stand for themselves, the others for code points from 256 on
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    sign = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    ranks = {bytes(sign[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special


class ChunkEncoder:
    def __init__(self, path: str):
        self.path = path
        self.ranks, self.special = merge_ranks(path)
        self.forget()

    @cached_property
    def lib(self):
        """The library's tokenizer, loaded when a text needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        """Drops the cache."""
        self.keys = np.zeros(0, np.uint64)  # sorted chunk hashes
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def _chunks(self, texts: list[str]) -> list:
        """Ids of chunks; by the plain ranks where these are known to give the same ids."""
        if self.ranks is None:
            return self._library(texts)
        one, special = self.ranks.encode_ordinary, self.special
        return [self._library([t])[0] if special and any(s in t for s in special) else one(t) for t in texts]

    def _learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        """Encodes new chunks; ``keys`` are sorted and distinct."""
        new = self._chunks([buf[a:b].tobytes().decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        size = np.array([len(x) for x in new], np.int64)
        at = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(new), np.uint32, int(size.sum()))])
        into = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, into, keys)  # one column at a time, as the cache is large
        self.at = np.insert(self.at, into, at)
        self.size = np.insert(self.size, into, size)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, bounds)."""
        n = len(off) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        odd = np.zeros(n, bool)
        for m in _ODD_BYTES.finditer(buf.tobytes()):
            odd[np.searchsorted(off, m.start(), side="right") - 1] = True
        gap = tk.SPACE[buf]
        begin = np.zeros(len(buf), bool)
        begin[off[:-1][off[:-1] < len(buf)]] = True
        edge = begin.copy()
        single = ((buf[1:-1] == 32) | (buf[1:-1] == 10)) & ~gap[:-2] & ~gap[2:] & ~edge[1:-1] & ~edge[2:]
        begin[1:-1] |= single
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(buf))
        first = np.searchsorted(start, off)
        keys = tk.span_hash(buf, start, end, 23)
        if len(self.ids) > CACHE_IDS:
            self.forget()
        plain = ~np.repeat(odd, np.diff(first))
        uniq, where = np.unique(keys[plain], return_index=True)
        known = np.searchsorted(self.keys, uniq)
        fresh = known == len(self.keys)
        fresh[~fresh] = self.keys[known[~fresh]] != uniq[~fresh]
        if fresh.any():
            src = np.flatnonzero(plain)[where[fresh]]
            self._learn(buf, start[src], end[src], uniq[fresh])
        slot = np.searchsorted(self.keys, keys[plain])
        size = np.zeros(len(keys), np.int64)
        size[plain] = self.size[slot]
        take = np.repeat(self.at[slot] - np.concatenate([[0], np.cumsum(self.size[slot])[:-1]]), self.size[slot])
        flat = self.ids[take + np.arange(len(take))]
        total = np.concatenate([[0], np.cumsum(size)])
        bounds = total[first]
        if not odd.any():
            return flat, bounds
        whole = dict(zip(np.flatnonzero(odd).tolist(), self._library([buf[off[d] : off[d + 1]].tobytes().decode() for d in np.flatnonzero(odd)]), strict=True))
        parts = [whole[d] if d in whole else flat[bounds[d] : bounds[d + 1]] for d in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and file."""
    return ChunkEncoder(path)
