"""Sparse feature-by-cell matrices as long tables (feature_id, cell_id, value).

An absent row is a zero, so statistics over all cells take the number of cells as an argument
or from the ``cells`` table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def subset(counts: DataFrame, ids: DataFrame, key: str = "feature_id") -> DataFrame:
    """Only the rows whose key is listed."""
    return counts.join(ids.select(key).distinct(), key, "left_semi")


def binarize(counts: DataFrame, positive_only: bool = False) -> DataFrame:
    """Every stored non-zero (or positive) value becomes 1."""
    keep = F.col("value") > 0 if positive_only else F.col("value") != 0
    return counts.where(keep).withColumn("value", F.lit(1.0))


def at_least(counts: DataFrame, least: float) -> DataFrame:
    return counts.where(F.col("value") >= least)


def row_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature_id").agg(F.sum("value").alias("row_sum"))


def col_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell_id").agg(F.sum("value").alias("col_sum"))


def drop_zero(counts: DataFrame, key: str = "cell_id") -> DataFrame:
    """Keys whose values sum to more than zero."""
    alive = counts.groupBy(key).agg(F.sum("value").alias("_t")).where("_t > 0").select(key)
    return counts.join(alive, key, "left_semi")


def row_variance(counts: DataFrame, n_cells: int, key: str = "feature_id") -> DataFrame:
    """Sample variance over ``n_cells`` columns, implicit zeros included."""
    s, q = F.sum("value"), F.sum(F.col("value") * F.col("value"))
    return counts.groupBy(key).agg(F.try_divide(q - s * s / n_cells, F.lit(n_cells - 1)).alias("variance"))


def broadcast_arithmetic(counts: DataFrame, stats: DataFrame, by: str, stat: str, op: str) -> DataFrame:
    """``value op stat`` on stored values, the statistic joined by feature or cell."""
    ops: dict[str, Callable[[Column, Column], Column]] = {
        "-": lambda a, b: a - b, "+": lambda a, b: a + b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "^": lambda a, b: F.pow(a, b)}
    return counts.join(stats.select(by, stat), by).withColumn("value", ops[op](F.col("value"), F.col(stat))).drop(stat)


def group_sums(counts: DataFrame, groups: DataFrame, group: str = "cluster") -> DataFrame:
    """(feature_id, group, value): counts summed over the cells of each group."""
    return counts.join(groups.select("cell_id", group), "cell_id").groupBy("feature_id", group).agg(F.sum("value").alias("value"))


def log_normalize(sums: DataFrame, group: str = "cluster", scale: float = 1e4) -> DataFrame:
    """``log2(value / group total * scale + 1)``."""
    total = sums.groupBy(group).agg(F.sum("value").alias("_t"))
    return sums.join(total, group).withColumn("value", F.log2(F.col("value") / F.col("_t") * scale + 1)).drop("_t")


def top_features(stats: DataFrame, stat: str, n: int, skip: int = 0, id_col: str = "feature_id") -> DataFrame:
    """Rows ranked ``skip + 1`` to ``skip + n`` by a statistic, largest first, smaller id first."""
    rank = F.row_number().over(W.orderBy(F.col(stat).desc(), F.col(id_col).asc()))
    top = stats.orderBy(F.col(stat).desc(), F.col(id_col).asc()).limit(n + skip)  # at most n + skip rows reach the window
    return top.withColumn("rank", rank).where(F.col("rank") > skip)


def skipped(total: int, quantile: float, nonzero: int) -> int:
    """How many of the largest features to pass over; none if too few are left."""
    skip = int((1 - quantile) * total + 1e-9)
    return 0 if nonzero <= skip else skip


def tf_idf(counts: DataFrame, method: int = 2, scale: float = 1e4, n_cells: int | None = None, row_sum: DataFrame | None = None) -> DataFrame:
    """Term frequency by column sums, inverse frequency by row sums.

    1: ``tf * ln(1 + N / rs)``; 2: ``ln(tf * N / rs * scale + 1)``; 3: ``ln(tf + 1) * ln(1 + N / rs)``.
    N is the number of cells with counts unless given; row sums of a trained model may be given.
    """
    if method not in (1, 2, 3):
        raise ValueError("method is 1, 2 or 3")
    rs = row_sum if row_sum is not None else row_sums(counts)
    cs = col_sums(counts).where("col_sum <> 0")
    n = F.lit(float(n_cells)) if n_cells is not None else None
    if n is None:
        total = counts.select("cell_id").distinct().agg(F.count(F.lit(1)).cast("double").alias("n"))
        n = total.scalar()
    joined = counts.join(cs, "cell_id").join(rs.where("row_sum <> 0"), "feature_id")
    tf, idf = F.col("value") / F.col("col_sum"), n / F.col("row_sum")
    value = {1: tf * F.log(1 + idf), 2: F.log(tf * idf * scale + 1), 3: F.log(tf + 1) * F.log(1 + idf)}[method]
    return joined.select("feature_id", "cell_id", value.alias("value"))


def threshold_profile(counts: DataFrame, top: int | None = None) -> DataFrame:
    """(cell_id, threshold, n): features with at least that value, for thresholds from 1 up.

    A histogram per cell is summed from its top, so no value is unrolled into its thresholds.
    """
    v = F.floor("value").cast("long")
    hist = counts.where("value >= 1").groupBy("cell_id", (F.least(v, F.lit(top)) if top else v).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    down = W.partitionBy("cell_id").orderBy(F.col("_v").desc())
    stepped = hist.withColumns({"n": F.sum("_c").over(down), "_below": F.coalesce(F.lead("_v").over(down), F.lit(0))})
    return stepped.select("cell_id", F.explode(F.sequence(F.col("_below") + 1, F.col("_v"))).alias("threshold"), "n")


def dedupe_features(counts: DataFrame, features: DataFrame, name: str = "name", stat=F.sum, best="max") -> DataFrame:
    """Features with one row per name: the one whose statistic is best, the first of equals.

    Rows without a name all stay.  ``features``: (feature_id, name, …); ``stat`` is an
    aggregate of ``value`` (a Column function or a grouped-aggregate pandas UDF).  ``best`` is
    max, min or an aggregate of the statistics of a name: the first row that equals it stays.  A
    repeated name none of whose rows equals it (a mean, say) is left out.
    """
    scores = counts.groupBy("feature_id").agg(stat("value").alias("_stat"))
    ranked = features.join(scores, "feature_id", "left").na.fill(0, ["_stat"])
    named = ranked.where(F.col(name).isNotNull())
    order = [F.col("_stat").desc() if best == "max" else F.col("_stat").asc()]
    if callable(best):
        order = []
        picked = named.groupBy(name).agg(best("_stat").alias("_best"), F.count(F.lit(1)).alias("_rows"))
        named = named.join(picked, name).where("_stat = _best or _rows = 1").drop("_best", "_rows")
    named = named.withColumn("_rn", F.row_number().over(W.partitionBy(name).orderBy(*order, "feature_id"))).where("_rn = 1").drop("_rn")
    return named.unionByName(ranked.where(F.col(name).isNull())).drop("_stat")


def zscore(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Each row's dimensions centred and divided by their sample deviation (0 without any).

    Sums come first in a step of their own: inside the lambda they would be taken anew for
    every element.
    """
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    sums = F.aggregate(F.col(column), zero, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    n = F.size(column)
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("_t.q") - F.col("_t.s") * F.col("_t.s") / n) / F.greatest(n - 1, F.lit(1))))
    stat = df.withColumn("_t", sums).withColumn("_z", F.struct((F.col("_t.s") / n).alias("m"), sd.alias("d")))
    z = F.transform(F.col(column), lambda x: F.when(F.col("_z.d") > 0, (x - F.col("_z.m")) / F.col("_z.d")).otherwise(F.lit(0.0)))
    return stat.withColumn(column, z).drop("_t", "_z")


def quantiles(df: DataFrame, column: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, as columns q0, q1, …"""
    return df.groupBy(*(by or [])).agg(*[F.percentile(F.col(column).cast("double"), F.lit(q)).alias(f"q{i}") for i, q in enumerate(qs)])


def confusion(cells: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, fraction of the row)."""
    n = cells.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy(row)))


def centroids(embedding: DataFrame, groups: DataFrame, group: str = "cluster") -> DataFrame:
    """(group, dim, value): mean of each dimension over the cells of a group."""
    long = embedding.join(groups.select("cell_id", group), "cell_id").select(group, F.posexplode("embedding").alias("dim", "v"))
    return long.groupBy(group, "dim").agg(F.avg("v").alias("value"))


def concat_embeddings(embeddings: dict[str, DataFrame], dims: dict[str, list[int]] | None = None) -> DataFrame:
    """One embedding from several, side by side; all must cover the same cells."""
    out, sizes = None, []
    for name, df in embeddings.items():
        use = (dims or {}).get(name)
        col = F.col("embedding") if use is None else F.array(*[F.element_at("embedding", d) for d in use])
        part = df.select("cell_id", col.alias(f"_{name}"))
        sizes.append(part.count())
        out = part if out is None else out.join(part, "cell_id")
    if len(set(sizes)) > 1:
        raise ValueError(f"embeddings differ in their number of cells: {sizes}")
    return out.select("cell_id", F.concat(*[F.col(f"_{n}") for n in embeddings]).alias("embedding"))
