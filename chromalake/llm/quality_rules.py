"""Quality rules, line first.

Every ``\\n``-separated line with a word is judged on its own by punctuation, navigation
and boilerplate rules; lines that fail are removed, and a document that loses more than
MAX_LOST percent of its word characters is rejected.  Words are runs of characters
outside ``\\x20 \\x09-\\x0D``.  A line fails if

* punctuation: its last byte is no end mark and it has fewer than SHORT words, or at
  least DOUBLED percent of its words end in ``!!`` or ``??``;
* navigation: at least SEPARATORS percent of its words are only separators
  (``| / - ~ >`` or a bullet, guillemet or middle dot);
* symbols: more than SYMBOLS percent of its words hold one of ``#*$%&|<>``;
* boilerplate: it has at most LONG words and holds one of PHRASES (English, German, French,
  Spanish; A-Z lower-cased), or at most BRIEF words and one of MARKS, in any language.

Base rules come first: fewer than MIN_WORDS words, or more than MAX_REPEAT percent of the
words in five-word windows that occur twice or more, reject a document outright.

Edge cases: a null or empty text has no words, fails the base rules and is rejected; very
long lines and words are judged like any other; repeated rows are judged row by row; an
empty table gives an empty result; other columns pass through ``clean`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalake.llm import textkernel as tk
from chromalake.runtime import lean, ship_package, small_batches

MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
MAX_LOST, SHORT, DOUBLED, SEPARATORS, SYMBOLS, LONG = 50, 4, 30, 25, 30, 20
END_MARKS = ".!?:;,\"')]}"  # and any byte of a multi-byte character
PHRASES = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript",
    "sign in", "log in", "subscribe to our", "click here", "skip to content", "back to top", "lorem ipsum", "powered by",
    "alle rechte vorbehalten", "datenschutzerkl", "hier klicken", "nach oben", "jetzt anmelden", "newsletter abonnieren",
    "tous droits r", "politique de confidentialit", "mentions l\u00e9gales", "cliquez ici", "retour en haut", "se connecter", "abonnez-vous",
    "todos los derechos reservados", "pol\u00edtica de privacidad", "aviso legal", "haga clic", "volver arriba", "iniciar sesi\u00f3n", "suscr\u00edbete",
)
#: Marks of addresses and notices in any language; a short line that holds one is boilerplate.
MARKS = ("http://", "https://", "www.", "\u00a9")
BRIEF = 6

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b"|/-~>")] = True
_SEPARATOR_WORDS = [w.encode() for w in ("•", "·", "»", "›", "«", "‹")]
_END = np.zeros(256, bool)
_END[list(END_MARKS.encode())] = True
_END[128:] = True


@dataclass
class Facts:
    """Per text of a slice; ``lines``: (start, end, failed) of each line, ``line_first`` per text."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    base_failed: np.ndarray
    lost_chars: np.ndarray
    kept: np.ndarray
    line_start: np.ndarray
    line_end: np.ndarray
    line_failed: np.ndarray
    line_first: np.ndarray


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])


def _repeats(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more in its group, is not the first there); groups ascend."""
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
        order = np.argsort(keys[a:b], kind="stable")
        k = keys[a:b][order]
        same = k[1:] == k[:-1]
        if same.any():
            later[a:b][order[1:][same]] = True
            twice[a:b][order[1:][same]] = True
            twice[a:b][order[:-1][same]] = True
    return twice, later


def facts(buf: np.ndarray, off: np.ndarray) -> Facts:
    n = len(off) - 1
    w = tk.words(buf, off)
    h = tk.span_hash(w.buf, w.start, w.end)
    counts = w.counts
    points = _sums((buf & 0xC0) != 0x80)
    chars = points[w.end] - points[w.start]
    per_doc = lambda x: _sums(x)[w.first[1:]] - _sums(x)[w.first[:-1]]
    symbols = _sums(_SYMBOL[buf])
    # repeated five-word windows
    g, at = tk.windows(h, w.first, WINDOW)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(g):
        twice, _ = _repeats(g, np.searchsorted(w.first, at, side="right"))
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    repeat = np.cumsum(covered)[:-1] > 0
    # lines, numbered over the slice; a text without a line break is one line
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([off[1:], breaks]), kind="stable")
    line_doc = _line_docs(off, breaks)
    word_line = np.searchsorted(starts, w.start, side="right") - 1
    first = np.searchsorted(word_line, np.arange(len(starts) + 1))
    per_line = lambda x: _sums(x)[first[1:]] - _sums(x)[first[:-1]]
    nw = np.diff(first)
    has = nw > 0
    last = np.maximum(first[1:] - 1, 0)
    last_byte = buf[np.maximum(w.end[np.minimum(last, max(len(h) - 1, 0))] - 1, 0)] if len(h) else np.zeros(len(starts), np.uint8)
    size = w.end - w.start
    tail = buf[w.end - 1]
    before = buf[np.maximum(w.end - 2, 0)]
    doubled = (size > 1) & (tail == before) & ((tail == 33) | (tail == 63))
    only = _sums(_SEPARATOR[buf])
    separator = only[w.end] - only[w.start] == size
    for s in _SEPARATOR_WORDS:
        fit = np.flatnonzero(size == len(s))
        if len(fit):
            eq = np.ones(len(fit), bool)
            for k, byte in enumerate(s):
                eq &= buf[w.start[fit] + k] == byte
            separator[fit[eq]] = True
    symbolic = symbols[w.end] > symbols[w.start]
    failed = (~_END[last_byte] & (nw < SHORT)) | (100 * per_line(doubled) >= DOUBLED * nw)
    failed |= (100 * per_line(separator) >= SEPARATORS * nw) | (100 * per_line(symbolic) > SYMBOLS * nw)
    low = tk.LOWER[buf].tobytes()
    for phrases, most in ((PHRASES, LONG), (MARKS, BRIEF)):
        hit = np.zeros(len(starts), bool)
        for phrase in phrases:
            p, k = phrase.encode(), -1
            while (k := low.find(p, k + 1)) >= 0:
                line = int(np.searchsorted(starts, k, side="right")) - 1
                if k + len(p) <= ends[line]:
                    hit[line] = True
        failed |= hit & (nw <= most)
    failed &= has
    line_chars = per_line(chars)
    lost = np.bincount(line_doc, weights=np.where(failed, line_chars, 0), minlength=n).astype(np.int64)
    # equal earlier lines, on whole lines
    live = np.flatnonzero(has)
    _, later = _repeats(tk.span_hash(buf, starts[live], ends[live], 1), line_doc[live])
    dup = np.bincount(line_doc[live], weights=later, minlength=n).astype(np.int64)
    total, rep = per_doc(chars), per_doc(repeat)
    base = (counts < MIN_WORDS) | (100 * rep > MAX_REPEAT * counts)
    return Facts(
        counts, total, symbols[off[1:]] - symbols[off[:-1]], dup, rep, base, lost, ~base & (100 * lost <= MAX_LOST * total),
        starts, ends, failed, np.searchsorted(line_doc, np.arange(n + 1)),
    )


def _line_docs(off: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """The text of each line: a text has as many lines as breaks and one more."""
    inside = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1])
    return np.repeat(np.arange(len(off) - 1), inside + 1)


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_chars long, kept boolean"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    for batch in batches:
        for i, j, buf, off in tk.slices(batch.column(1)):
            f = facts(buf, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(getattr(f, c)) for c in names]], ["doc_id", *names])


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base counts, base_failed, lost_chars, kept) of every row."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_judge, f"doc_id long, {_COLUMNS}")


def clean(docs: DataFrame, text: str = "text", strip: bool = True) -> DataFrame:
    """The documents that are kept, all columns; with ``strip`` without their failed lines."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tk.slices(batch.column(at)):
                f = facts(buf, off)
                keep = np.flatnonzero(f.kept)
                part = batch.slice(i, j - i).take(pa.array(keep))
                if strip and f.line_failed.any():
                    new = []
                    for d in keep.tolist():
                        a, b = f.line_first[d], f.line_first[d + 1]
                        if f.line_failed[a:b].any():
                            new.append(b"\n".join(buf[s:e].tobytes() for s, e, x in zip(f.line_start[a:b], f.line_end[a:b], f.line_failed[a:b], strict=True) if not x).decode())
                        else:
                            new.append(buf[off[d] : off[d + 1]].tobytes().decode())
                    part = part.set_column(at, part.schema.field(at), pa.array(new, pa.string()))
                yield part

    return docs.mapInArrow(run, docs.schema)


def op4_line_first_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
