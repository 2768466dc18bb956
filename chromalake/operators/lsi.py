"""Iterative latent semantic indexing.

The truncated decomposition is a block power iteration that keeps one side x (rank + extra)
numbers on the driver while the other side stays distributed.  That is the feature side, bounded by
the number of selected features, unless these are very many and the cells are fewer; then it
is the cell side and the left factors are a table.  Embeddings are products of a cell's weights
with the left factors, for training and projected cells alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from chromalake.functions.stats import correlation
from chromalake.operators import matrix as mx
from chromalake.operators.sweep import numbered
from chromalake.runtime import materialize, ship_package


def sample_cells(cells: DataFrame, n: int, quantiles: tuple[float, float] = (0.01, 0.99), seed: int = 1, depth: str = "fragments", sample: str = "sample") -> DataFrame:
    """At most about ``n`` cells, each sample by its share (rounded up).

    A sample's draw is from cells whose log10(depth + 1) lies within its quantiles if these
    are enough, else from all its cells.
    """
    d = F.log10(F.col(depth) + 1)
    q = cells.groupBy(sample).agg(F.percentile(d, F.lit(quantiles[0])).alias("_lo"), F.percentile(d, F.lit(quantiles[1])).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    share = cells.agg(F.count(F.lit(1)).alias("t")).scalar()
    at = cells.join(q, sample).withColumn("_want", F.ceil(F.lit(n) * F.col("_n") / share)).withColumn("_in", (d >= F.col("_lo")) & (d <= F.col("_hi")))
    inside = F.sum(F.col("_in").cast("int")).over(W.partitionBy(sample))
    pool = at.withColumn("_enough", inside >= F.col("_want")).where(F.col("_in") | ~F.col("_enough"))
    order = F.row_number().over(W.partitionBy(sample).orderBy(F.md5(F.concat_ws("/", "cell_id", F.lit(seed))), "cell_id"))
    return pool.withColumn("_o", order).where("_o <= _want").select(cells.columns)


def depth_outliers(counts: DataFrame, quantiles: tuple[float, float] = (0.02, 0.98)) -> DataFrame:
    """(cell_id, col_sum, outlier): outside the open interval of two quantiles of column sums."""
    sums = mx.col_sums(counts)
    q = sums.agg(F.array(F.percentile("col_sum", F.lit(quantiles[0])), F.percentile("col_sum", F.lit(quantiles[1]))).alias("q"))
    lim = q.scalar()
    return sums.withColumn("outlier", (F.col("col_sum") <= lim[0]) | (F.col("col_sum") >= lim[1]))


#: Left factors of at most this many numbers (8 MB) are always held by the driver.
SMALL = 1 << 20


@dataclass
class LsiModel:
    """Left factors by feature, singular values and what a projection needs."""

    features: DataFrame  # feature_id, fidx, row_sum
    u: np.ndarray | DataFrame  # by fidx, or a table (feature_id, u array<double>)
    d: np.ndarray
    n_cells: int
    method: int
    scale: float
    params: dict = field(default_factory=dict)


def _vectors(values: DataFrame, numbers: DataFrame, row: str = "cell_id", column: str = "feature_id") -> DataFrame:
    """(row, at array<int>, w array<double>): one sparse row per cell, or per ``row``.

    ``numbers``: (column, fidx).
    """
    pairs = F.sort_array(F.collect_list(F.struct("fidx", "value")))
    return values.join(numbers.select(column, "fidx"), column).groupBy(row).agg(pairs.alias("_p")).select(
        row, F.col("_p.fidx").alias("at"), F.col("_p.value").alias("w"))


def _local(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell row, feature, weight) of a batch of sparse rows."""
    at, w = batch.column("at"), batch.column("w")
    size = np.diff(np.asarray(at.offsets))
    return np.repeat(np.arange(len(at)), size), np.asarray(at.flatten()), np.asarray(w.flatten(), float)


def _times(batch: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
    """Rows of the batch times q (features x l)."""
    r, f, w = _local(batch, len(q))
    out = np.zeros((batch.num_rows, q.shape[1]))
    step = max(1, (1 << 22) // q.shape[1])
    for a in range(0, len(r), step):
        s = slice(a, a + step)
        cut = np.flatnonzero(np.concatenate([[True], r[s][1:] != r[s][:-1]]))
        out[r[s][cut]] += np.add.reduceat(w[s][:, None] * q[f[s]], cut)
    return out


def svd(vectors: DataFrame, n_features: int, rank: int, seed: int = 1, extra: int = 10, rounds: int = 8, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(u, d) of the features x cells matrix whose columns are the sparse rows.

    Signs: the entry of each factor that is largest in size is positive.
    """
    width = min(rank + extra, n_features)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_features, width)))[0]

    def step(q: np.ndarray) -> np.ndarray:
        sent = vectors.sparkSession.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = sent.value
            total = np.zeros_like(q)
            for b in batches:
                if b.num_rows:
                    y = _times(b, q)
                    r, f, w = _local(b, len(q))
                    order = np.argsort(f, kind="stable")
                    r, f, w = r[order], f[order], w[order]
                    size = max(1, (1 << 22) // q.shape[1])
                    for a in range(0, len(r), size):
                        s = slice(a, a + size)
                        cut = np.flatnonzero(np.concatenate([[True], f[s][1:] != f[s][:-1]]))
                        total[f[s][cut]] += np.add.reduceat(w[s][:, None] * y[r[s]], cut)
            live = np.flatnonzero(np.abs(total).sum(1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(total[live].ravel()), q.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), flat], ["fidx", "z"])

        parts = vectors.select("at", "w").mapInArrow(run, "fidx int, z array<double>")
        summed = parts.groupBy("fidx").agg(*[F.sum(F.element_at("z", i + 1)).alias(f"z{i}") for i in range(q.shape[1])])
        got = summed.toArrow()  # n_features rows at most
        sent.destroy()
        out = np.zeros_like(q)
        out[got["fidx"].to_numpy()] = np.stack([got[f"z{i}"].to_numpy() for i in range(q.shape[1])], 1)
        return out

    seen = None
    for _ in range(rounds):
        z = step(q)
        ritz, vec = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        top = ritz[::-1][:rank]
        u = q @ vec[:, ::-1][:, :rank]
        if seen is not None and np.abs(top - seen).max() <= tol * max(top[0], 1e-300):
            break
        seen, q = top, np.linalg.qr(z)[0]
    d = np.sqrt(np.maximum(top, 0))
    keep = d > max(d[0], 1e-300) * 1e-10 if len(d) else np.zeros(0, bool)
    u, d = u[:, keep], d[keep]
    return u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])]), d


def project(vectors: DataFrame, u: np.ndarray, row: str = "cell_id") -> DataFrame:
    """(row, embedding): each cell's (or ``row``'s) weights times the factors; NaN becomes 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                e = np.nan_to_num(_times(b, u))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(e.ravel()), u.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(row), flat], [row, "embedding"])

    return vectors.mapInArrow(run, f"{row} {vectors.schema[row].dataType.simpleString()}, embedding array<double>")


def _svd_by_cells(spark, weights: DataFrame, n_cells: int, rank: int, seed: int, extra: int) -> tuple[DataFrame, np.ndarray]:
    """(u, d) as by ``svd``, iterated on the cells: u is a table (feature_id, u), made by the right factors."""
    cells = numbered(weights.select("cell_id").distinct(), "cell_id", "fidx").withColumn("fidx", F.col("fidx").cast("int"))
    cells = materialize(spark, cells, "lsi-cells")
    vectors = materialize(spark, _vectors(weights, cells, "feature_id", "cell_id"), "lsi-vectors")
    v, d = svd(vectors, n_cells, rank, seed, extra)
    table = materialize(spark, project(vectors, v / d, "feature_id"), "lsi-factors")
    entry = [F.element_at("embedding", i + 1) for i in range(len(d))]
    top = table.agg(*[F.max(F.struct(F.abs(e).alias("a"), e.alias("x"))).alias(f"t{i}") for i, e in enumerate(entry)]).first()
    sign = [-1.0 if top[f"t{i}"]["x"] < 0 else 1.0 for i in range(len(d))]
    return table.select("feature_id", F.array(*[e * s for e, s in zip(entry, sign, strict=True)]).alias("u")), d


def fit_lsi(spark, counts: DataFrame, rank: int, method: int = 2, scale: float = 1e4, seed: int = 1, outlier_quantiles: tuple[float, float] | None = (0.02, 0.98), sampled: DataFrame | None = None, small: int = SMALL, extra: int = 10) -> tuple[DataFrame, LsiModel]:
    """Trains on sampled cells inside the depth quantiles and embeds every cell of ``counts``."""
    ship_package(spark)
    use = mx.subset(counts, sampled, "cell_id") if sampled is not None else counts
    use = mx.drop_zero(use, "cell_id")
    if outlier_quantiles:
        inside = depth_outliers(use, outlier_quantiles).where("not outlier")
        inner = mx.subset(use, inside, "cell_id")
        use = inner if not inner.isEmpty() else use
    use = materialize(spark, use, "lsi-train")
    features = materialize(spark, numbered(mx.row_sums(use).where("row_sum > 0"), "feature_id", "fidx").withColumn("fidx", F.col("fidx").cast("int")), "lsi-features")
    n_features, n_cells = features.count(), use.select("cell_id").distinct().count()
    weights = mx.tf_idf(use, method, scale, n_cells, features.select("feature_id", "row_sum"))
    used = min(rank, n_features, n_cells)
    if n_features * (used + extra) > small and n_cells < n_features:
        u, d = _svd_by_cells(spark, weights, n_cells, used, seed, extra)
    else:
        train = materialize(spark, _vectors(weights, features), "lsi-vectors")
        u, d = svd(train, n_features, used, seed, extra)
    model = LsiModel(features, u, d, n_cells, method, scale, {"seed": seed, "rank": rank, "outliers": outlier_quantiles})
    return project_cells(counts, model), model


def project_cells(counts: DataFrame, model: LsiModel) -> DataFrame:
    """Embeds any cells with the training row sums and number of cells."""
    ship_package(counts.sparkSession)
    known = mx.subset(counts, model.features)
    weights = mx.tf_idf(known, model.method, model.scale, model.n_cells, model.features.select("feature_id", "row_sum"))
    if isinstance(model.u, np.ndarray):
        return project(_vectors(weights, model.features), model.u)
    part = weights.join(model.u, "feature_id").groupBy("cell_id").agg(*[F.sum(F.col("value") * F.element_at("u", i + 1)).alias(f"_{i}") for i in range(len(model.d))])
    return part.select("cell_id", F.array(*[F.nanvl(f"_{i}", F.lit(0.0)) for i in range(len(model.d))]).alias("embedding"))


def projection_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """(dim, correlation) of two embeddings of the same cells."""
    x = a.select("cell_id", F.posexplode("embedding").alias("dim", "x"))
    y = b.select("cell_id", F.posexplode("embedding").alias("dim", "y"))
    return x.join(y, ["cell_id", "dim"]).groupBy("dim").agg(correlation(F.col("x"), F.col("y")).alias("correlation"))


def depth_correlation(embedding: DataFrame, cells: DataFrame, depth: str = "fragments") -> DataFrame:
    """(dim from 1, correlation with log10 depth)."""
    long = embedding.select("cell_id", F.posexplode("embedding").alias("dim", "v")).join(cells.select("cell_id", F.log10(F.col(depth) + 1).alias("_d")), "cell_id")
    return long.groupBy((F.col("dim") + 1).alias("dim")).agg(correlation(F.col("v"), F.col("_d")).alias("correlation"))


def drop_depth_dims(embedding: DataFrame, cells: DataFrame, cutoff: float = 0.75, depth: str = "fragments") -> DataFrame:
    """The embedding without dimensions that follow depth; all stay if all would go."""
    gone = {r["dim"] for r in depth_correlation(embedding, cells, depth).collect() if r["correlation"] is not None and abs(r["correlation"]) > cutoff}  # rank rows
    n = embedding.select(F.size("embedding").alias("n")).first()
    keep = [d for d in range(1, (n["n"] if n else 0) + 1) if d not in gone]
    return embedding if not keep or not gone else embedding.select("cell_id", F.array(*[F.element_at("embedding", d) for d in keep]).alias("embedding"))


def first_features(counts: DataFrame, n: int, total: int, quantile: float, how: str = "Top", n_cells: int | None = None) -> DataFrame:
    """The features of the first pass: the most frequent (after the very top) or most variable."""
    if how == "Var":
        return mx.top_features(mx.row_variance(counts, n_cells), "variance", n).select("feature_id")
    stats = mx.row_sums(mx.binarize(counts))
    nonzero = stats.where("row_sum > 0").count()
    return mx.top_features(stats, "row_sum", n, mx.skipped(total, quantile, nonzero)).select("feature_id")


def iterative_lsi(
    spark, counts: DataFrame, cells: DataFrame, rank: int = 30, iterations: int = 2, first_selection: str = "Top", num_features: int = 25000,
    method: int = 2, resolution: float = 2.0, correlation_cutoff: float = 0.75, scale: float = 1e4, seed: int = 1, total_features: int = 500_000,
    filter_quantile: float = 0.995, outlier_quantiles: tuple[float, float] = (0.02, 0.98), binary: bool = True, cells_to_sample: int | None = 10_000, final_scale: bool = False,
) -> tuple[DataFrame, LsiModel] | None:
    """(embedding, model), or None if clustering finds one cluster only.

    ``counts``: (feature_id, cell_id, value); ``cells``: (cell_id, sample, fragments).
    """
    from chromalake.operators.cluster import cluster_embedding

    if num_features < 2:
        raise ValueError("num_features is too small")
    n_cells = cells.count()
    picked = first_features(counts, num_features, total_features, filter_quantile, first_selection, n_cells)
    result = None
    for i in range(1, iterations + 1):
        part = mx.subset(counts, picked)
        part = mx.binarize(part) if binary else part
        drawn = sample_cells(cells, cells_to_sample, (outlier_quantiles[0] / 2, 1 - (1 - outlier_quantiles[1]) / 2), seed) if cells_to_sample and i < iterations else None
        if i < iterations and drawn is not None:  # only the sample is embedded on the way
            part = mx.subset(part, drawn, "cell_id")
        embedding, model = fit_lsi(spark, part, rank, method, scale, seed, outlier_quantiles if i < iterations or cells_to_sample else None)
        embedding = materialize(spark, embedding, f"lsi-{i}")
        result = embedding, model
        if i == iterations:
            break
        clusters = cluster_embedding(spark, embedding, cells, resolution=resolution, correlation_cutoff=correlation_cutoff, seed=seed)
        clusters = materialize(spark, clusters, "lsi-clusters")
        if clusters.select("cluster").distinct().count() < 2:
            return None
        sums = mx.log_normalize(mx.group_sums(counts, clusters), scale=scale)
        n_clusters = clusters.select("cluster").distinct().count()
        within = mx.top_features(mx.row_sums(counts), "row_sum", total_features).select("feature_id")
        picked = mx.top_features(mx.row_variance(mx.subset(sums, within), n_clusters), "variance", num_features).select("feature_id")
    embedding, model = result
    if final_scale:
        embedding = mx.zscore(embedding)
    return embedding, model
