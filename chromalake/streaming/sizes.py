"""A stream of fragment rows into size and tile tables (not part of the batch surface)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalake.functions.genomic import cell_id


def stream_sizes(fragments: DataFrame, max_size: int = 5500) -> DataFrame:
    """(size, n) in complete mode; the state has max_size rows at most."""
    size = (F.col("end") - F.col("start")).cast("long")
    return fragments.where((size >= 1) & (size <= max_size)).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"))


def stream_tiles(fragments: DataFrame, width: int = 500) -> DataFrame:
    """(seqname, tile, cell_id, value) in update mode."""
    tiles = F.array_distinct(F.array(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    hits = fragments.select(F.col("chrom").alias("seqname"), cell_id(F.col("sample"), F.col("barcode")).alias("cell_id"), F.explode(tiles).alias("tile"))
    return hits.groupBy("seqname", "tile", "cell_id").agg(F.count(F.lit(1)).alias("value"))
