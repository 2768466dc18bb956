"""Strand-aware scalar functions on 1-based closed intervals, and cell keys.

Intervals are columns ``start``, ``end`` and a strand of ``+``, ``-`` or ``*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def cell_id(sample: Column, barcode: Column) -> Column:
    return F.concat_ws("#", sample, barcode)


def cell_barcode(cell: Column) -> Column:
    """What follows the last ``#``."""
    return F.regexp_replace(cell, "^.*#", "")


def cell_sample(cell: Column) -> Column:
    """What precedes the first ``#``."""
    return F.regexp_replace(cell, "#.*$", "")


def parse_interval(text: Column) -> tuple[Column, Column, Column]:
    """(seqname, start, end) of ``chr:start-end``; nulls for ``NA`` or anything else."""
    shape = r"^(.*):(\d+)-(\d+)$"
    fits = text.rlike(shape)
    part = lambda k: F.when(fits, F.regexp_extract(text, shape, k))
    return part(1), part(2).cast("long"), part(3).cast("long")


def tss(start: Column, end: Column, strand: Column) -> Column:
    """First transcribed base: the end on the minus strand, else the start."""
    return F.when(strand == "-", end).otherwise(start)


def centered(start: Column, end: Column, width: int, strand: Column | None = None) -> Pair:
    """Resized about the centre; with an odd difference the minus strand rounds up."""
    slack = (end - start + 1) - F.lit(width)
    left = F.floor(slack / 2)
    if strand is not None:
        left = F.when(strand == "-", F.ceil(slack / 2)).otherwise(left)
    s = (start + left).cast("long")
    return s, s + width - 1


def trimmed(start: Column, end: Column, length: Column) -> Pair:
    """Cut to [1, length]; an unknown (null) length only cuts at 1."""
    return F.greatest(F.lit(1).cast("long"), start), F.when(length.isNull(), end).otherwise(F.least(end, length))


def flanks(start: Column, end: Column, flank: int, norm: int) -> tuple[Pair, Pair]:
    """(right, left) windows of ``norm`` bases, ``flank`` bases out; not strand-aware."""
    return (end + (flank - norm + 1), end + flank), (start - flank, start - flank + (norm - 1))


def extended(start: Column, end: Column, strand: Column, upstream: int, downstream: int) -> Pair:
    """Grown by ``upstream`` before the first base and ``downstream`` after the last."""
    minus = strand == "-"
    return (
        start - F.when(minus, F.lit(downstream)).otherwise(F.lit(upstream)),
        end + F.when(minus, F.lit(upstream)).otherwise(F.lit(downstream)),
    )


def widened(start: Column, end: Column, by: int, strand: Column | None = None, anchor_end_on_minus: bool = False) -> Pair:
    """Grown by ``by`` on both sides.

    With ``anchor_end_on_minus`` a minus-strand interval is shifted and then resized from its
    end, which gives [start - 3 by, end - by] there.
    """
    if not anchor_end_on_minus or strand is None:
        return start - by, end + by
    minus = strand == "-"
    return F.when(minus, start - 3 * by).otherwise(start - by), F.when(minus, end - by).otherwise(end + by)


def promoter(start: Column, end: Column, strand: Column, upstream: int = 2000, downstream: int = 100) -> Pair:
    """Around the first base: ``upstream`` before it to ``downstream - 1`` after it."""
    at, minus = tss(start, end, strand), strand == "-"
    return (
        F.when(minus, at - downstream + 1).otherwise(at - upstream),
        F.when(minus, at + upstream).otherwise(at + downstream - 1),
    )


def distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Bases between two intervals; 0 if they overlap or touch."""
    return F.greatest(F.lit(0).cast("long"), F.greatest(a_start, b_start) - F.least(a_end, b_end) - 1)


def peak_class(promoter_hit: Column, gene_hit: Column, exon_hit: Column) -> Column:
    """Promoter before Exonic (in a gene and an exon) before Intronic (in a gene) before Distal."""
    return (
        F.when(promoter_hit, "Promoter").when(gene_hit & exon_hit, "Exonic").when(gene_hit, "Intronic").otherwise("Distal")
    )


def with_pair(df: DataFrame, pair: Pair, start: str = "start", end: str = "end") -> DataFrame:
    """Both ends replaced at once."""
    return df.withColumns({"_s": pair[0], "_e": pair[1]}).drop(start, end).withColumnsRenamed({"_s": start, "_e": end})


def natural_order(seqname: Column) -> tuple[Column, Column]:
    """Sort keys that put chr2 before chr10: (number or null last, name)."""
    number = F.expr("int(null)") if seqname is None else F.regexp_extract(seqname, r"(\d+)$", 1)
    return F.when(number != "", number.cast("long")).otherwise(F.lit(1 << 40)), seqname
