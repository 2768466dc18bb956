"""The tables behind quality-control plots; nothing is drawn here."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalake.operators.counting import fragment_sizes
from chromalake.operators.matrix import confusion
from chromalake.runtime import materialize, small_batches


def enrichment_vs_depth(cells: DataFrame, sample: str, tss_threshold: float = 12, fragment_threshold: float = 6000, max_log: float | None = None) -> DataFrame:
    """(cell_id, log10_fragments, tss_enrichment, passes): depths are capped after the logarithm."""
    depth = F.log10("fragments")
    if max_log is not None:
        depth = F.least(depth, F.lit(max_log))
    ok = (F.col("fragments") >= fragment_threshold) & (F.col("tss_enrichment") >= tss_threshold)
    return cells.where(F.col("sample") == sample).select("cell_id", depth.alias("log10_fragments"), "tss_enrichment", F.coalesce(ok, F.lit(False)).alias("passes"))


def quality_cells(cells: DataFrame, tss_threshold: float = 12, fragment_threshold: float = 6000) -> DataFrame:
    return cells.where((F.col("fragments") >= fragment_threshold) & (F.col("tss_enrichment") >= tss_threshold))


def density(cells: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """(bx, by, n): cells per square of a grid over the range of both columns."""
    r = cells.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).alias("r")).scalar()
    at = lambda c, lo, hi: F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / F.greatest(hi - lo, F.lit(1e-300)) * bins)).cast("int")
    return cells.groupBy(at(x, r["x0"], r["x1"]).alias("bx"), at(y, r["y0"], r["y1"]).alias("by")).agg(F.count(F.lit(1)).alias("n"))


#: Squares of the grid along a radius.  A square is wholly within reach of another, or out of it, or its points are compared.
FINE = 16


def neighbour_density(cells: DataFrame, x: str, y: str, radius: float) -> DataFrame:
    """(cell_id, neighbours): other cells within a radius of each cell that has both coordinates.

    Equal points are counted once.  Squares of a fine grid that lie wholly within the radius of
    each other add their numbers of cells; only points of squares on the rim are compared.
    Both go by pairs of squares, dealt evenly, so that a crowded place is not one task.
    """
    at = cells.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("cell_id", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    side = radius / FINE
    square = lambda c: F.floor(F.col(c) / side)
    points = at.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_bx": square("_x"), "_by": square("_y")})
    points = materialize(cells.sparkSession, points, "density")
    squares = points.groupBy("_bx", "_by").agg(F.sum("_n").alias("_sn"))
    # steps from square to square: the farthest corners are |i| + 1 squares apart, the nearest |i| - 1; a
    # margin keeps rounding out of the sum
    steps = [(i, j) for i in range(-FINE - 1, FINE + 2) for j in range(-FINE - 1, FINE + 2)]
    far = {s: math.hypot(abs(s[0]) + 1, abs(s[1]) + 1) for s in steps}
    near = {s: math.hypot(max(abs(s[0]) - 1, 0), max(abs(s[1]) - 1, 0)) for s in steps}
    inside = [s for s in steps if far[s] <= FINE * (1 - 1e-9)]
    rim = [s for s in steps if s not in set(inside) and near[s] <= FINE * (1 + 1e-9)]
    to = lambda few: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in few]))
    moved = lambda df, few: df.withColumn("_o", to(few)).withColumns({"_tx": F.col("_bx") + F.col("_o.i"), "_ty": F.col("_by") + F.col("_o.j")})
    whole = moved(squares.select("_bx", "_by"), inside).join(squares.select(F.col("_bx").alias("_tx"), F.col("_by").alias("_ty"), "_sn"), ["_tx", "_ty"])
    whole = whole.groupBy("_bx", "_by").agg(F.sum("_sn").alias("_whole"))
    # a square's points as arrays: a pair of squares is one row
    packed = points.groupBy("_bx", "_by").agg(F.collect_list(F.struct("_x", "_y", "_n")).alias("_p"))
    tasks = 4 * cells.sparkSession.sparkContext.defaultParallelism
    pairs = moved(squares.select("_bx", "_by"), rim).join(squares.select(F.col("_bx").alias("_tx"), F.col("_by").alias("_ty")), ["_tx", "_ty"]).select("_bx", "_by", "_tx", "_ty")
    pairs = pairs.repartition(tasks).join(packed.withColumnRenamed("_p", "_a"), ["_bx", "_by"]).join(packed.toDF("_tx", "_ty", "_b"), ["_tx", "_ty"]).select("_a", "_b")
    radius2 = float(radius * radius)
    small_batches(cells.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(column: pa.Array) -> tuple:
            flat = column.flatten()
            return np.asarray(column.offsets) - column.offsets[0].as_py(), *[flat.field(i).to_numpy() for i in range(3)]

        for b in batches:
            (ao, ax, ay, _), (bo, bx, by, bn) = (parts(b.column(c)) for c in ("_a", "_b"))
            hits = np.zeros(len(ax), np.int64)
            for r in range(b.num_rows):
                k = slice(bo[r], bo[r + 1])
                step = max(1, (1 << 20) // max(1, bo[r + 1] - bo[r]))
                for i in range(ao[r], ao[r + 1], step):
                    s = slice(i, min(i + step, ao[r + 1]))
                    dx, dy = ax[s][:, None] - bx[k][None, :], ay[s][:, None] - by[k][None, :]
                    hits[s] = (dx * dx + dy * dy <= radius2) @ bn[k]
            yield pa.RecordBatch.from_arrays([pa.array(ax), pa.array(ay), pa.array(hits)], ["_x", "_y", "_h"])

    met = pairs.mapInArrow(compare, "_x double, _y double, _h long").groupBy("_x", "_y").agg(F.sum("_h").alias("_h"))
    n = F.coalesce("_whole", F.lit(0)) + F.coalesce("_h", F.lit(0)) - 1
    found = points.join(whole, ["_bx", "_by"], "left").join(met, ["_x", "_y"], "left").select("_x", "_y", n.alias("neighbours"))
    return at.join(found, ["_x", "_y"]).select("cell_id", "neighbours")


def size_distribution(fragments: DataFrame, sample: str | None = None, upto: int = 700) -> DataFrame:
    return fragment_sizes(fragments if sample is None else fragments.where(F.col("sample") == sample), upto=upto)


def cluster_confusion(cells: DataFrame, cluster: str = "cluster", sample: str = "sample") -> DataFrame:
    return confusion(cells, cluster, sample)
