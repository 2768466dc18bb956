"""Running values along sequences, without a window over a whole sequence.

Positions fall into bins of ``BIN`` bases.  Each bin is first reduced to one row of partial
values; a window over these rows (a sequence's length / BIN of them) carries the values from bin
to bin, and the caller's windows need only start afresh in each bin.  So tasks are as many as
bins, however few sequences there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec
from pyspark.sql import functions as F

BIN = 1 << 14


def in_bins(df: DataFrame, keys: list[str], pos: Column, before: dict[str, tuple] | None = None, after: dict[str, tuple] | None = None, bin_size: int = BIN) -> DataFrame:
    """``df`` with ``_bin`` and, per column of ``before`` and ``after``, the value carried into it.

    The columns are aggregates of a bin: ``F.sum`` is summed, ``F.max`` and ``F.min`` are taken on,
    over all bins before, or after, the row's own (null where there is none).  Each is given as
    (aggregate function, argument).
    """
    named = {**(before or {}), **(after or {})}
    binned = df.withColumn("_bin", F.floor(pos / bin_size))
    per = binned.groupBy(*keys, "_bin").agg(*[fn(arg).alias(name) for name, (fn, arg) in named.items()])
    order = W.partitionBy(*keys).orderBy("_bin")
    back, ahead = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys).orderBy(F.col("_bin").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = [named[n][0](F.col(n)).over(back).alias(n) for n in before or {}] + [named[n][0](F.col(n)).over(ahead).alias(n) for n in after or {}]
    per = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_kb"), *carried)
    same = F.col("_bin") == F.col("_kb")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return binned.join(per, same, "left").drop("_kb", *[f"_k{i}" for i in range(len(keys))])


def bin_window(keys: list[str], *order) -> WindowSpec:
    return W.partitionBy(*keys, "_bin").orderBy(*order)


def numbered(df: DataFrame, key: str, out: str, seed: int = 1, buckets: int = 1024) -> DataFrame:
    """``df`` with numbers 0, 1, … in hashed order of ``key``, without a gap.

    Rows are ranked within hash buckets and offset by the sizes of the buckets before, a table of
    ``buckets`` rows, so no task meets more than a bucket.  Rows of one key follow each other.
    """
    h = F.xxhash64(key, F.lit(seed))
    at = df.withColumns({"_h": h, "_b": F.pmod(h, F.lit(buckets))})
    size = at.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = size.select("_b", before.alias("_before"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_h", key)) - 1
    return at.withColumn(out, rank).join(F.broadcast(offset), "_b").withColumn(out, F.col(out) + F.col("_before")).drop("_h", "_b", "_before")
