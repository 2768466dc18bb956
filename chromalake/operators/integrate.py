"""Label and expression transfer from a reference of expression profiles.

A documented simplification of anchor-based transfer: cells are dealt into blocks; in each
block both sides are scaled over shared variable genes and embedded by the decomposition of
their cross-product (canonical correlation); mutual nearest neighbours are anchors; labels
and expression are averages over each cell's nearest anchors weighted by distance.  A block
holds at most ``block_cells`` cells of either side, in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalake.operators import matrix as mx
from chromalake.operators.sweep import numbered


def blocks(cells: DataFrame, size: int, seed: int = 1, key: str = "cell_id") -> DataFrame:
    """Adds ``block``: cells in hashed order take blocks 0, 1, … in turn."""
    n = cells.count()
    count = max(1, -(-n // size))
    return numbered(cells, key, "block", seed).withColumn("block", (F.col("block") % count).cast("int"))


def variable_genes(counts: DataFrame, n: int, n_cells: int) -> DataFrame:
    return mx.top_features(mx.row_variance(counts, n_cells), "variance", n).select("feature_id")


def _scaled(counts: pd.DataFrame, cells: list, genes: list) -> np.ndarray:
    x = np.zeros((len(cells), len(genes)))
    ci, gi = {c: i for i, c in enumerate(cells)}, {g: i for i, g in enumerate(genes)}
    x[counts["cell_id"].map(ci), counts["feature_id"].map(gi)] = counts["value"]
    total = np.maximum(x.sum(1, keepdims=True), 1e-12)
    x = np.log1p(x / total * 1e4)
    sd = x.std(0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
    return (x - x.mean(0)) / np.where(sd > 0, sd, 1)


def canonical(x: np.ndarray, y: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length canonical coordinates of the rows of both sides."""
    u, s, vt = np.linalg.svd(x @ y.T, full_matrices=False)
    k = min(rank, int((s > s[0] * 1e-10).sum()) if len(s) and s[0] > 0 else 1)
    norm = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    return norm(u[:, :k] * s[:k]), norm(vt[:k].T * s[:k])


def transfer(x: np.ndarray, y: np.ndarray, labels: np.ndarray, k_anchor: int = 5, k_weight: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(label, score, best reference row, weights cells x reference) from canonical coordinates."""
    d = ((x[:, None, :] - y[None, :, :]) ** 2).sum(2) if x.size * len(y) < 5e7 else np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)
    ka, kb = min(k_anchor, d.shape[1]), min(k_anchor, d.shape[0])
    a = np.zeros(d.shape, bool)
    np.put_along_axis(a, np.argsort(d, 1, kind="stable")[:, :ka], True, 1)
    b = np.zeros(d.shape, bool)
    np.put_along_axis(b, np.argsort(d, 0, kind="stable")[:kb], True, 0)
    qi, ri = np.nonzero(a & b)
    w = np.zeros(d.shape)
    to = np.maximum((x**2).sum(1)[:, None] + (x[qi] ** 2).sum(1)[None] - 2 * x @ x[qi].T, 0)
    k = min(k_weight, len(qi))
    near = np.argsort(to, 1, kind="stable")[:, :k]
    dist = np.take_along_axis(to, near, 1)
    weight = 1 - dist / np.maximum(dist[:, -1:], 1e-12)
    weight = np.where(weight.sum(1, keepdims=True) > 0, weight, 1.0)
    weight /= weight.sum(1, keepdims=True)
    for j in range(k):
        np.add.at(w, (np.arange(len(x)), ri[near[:, j]]), weight[:, j])
    names = np.unique(labels)
    votes = np.stack([w[:, labels == n].sum(1) for n in names], 1)
    best = votes.argmax(1)
    return names[best], votes.max(1), w.argmax(1), w


def gene_integration(spark, activity: DataFrame, cells: DataFrame, rna: DataFrame, rna_cells: DataFrame, block_cells: int = 10_000, n_genes: int = 2000, rank: int = 30, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(labels, imputed): (cell_id, predicted_group, prediction_score, rna_predicted_cell) and
    (feature_id, cell_id, value).

    ``activity`` and ``rna``: (feature_id gene, cell_id, value); ``rna_cells``: (cell_id, group).
    The reference is drawn down to ``block_cells`` cells, every query cell is in one block.
    """
    shared = activity.select("feature_id").intersect(rna.select("feature_id"))
    genes = variable_genes(mx.subset(rna, shared), n_genes, rna_cells.count())
    ref = rna_cells.orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(block_cells).select("cell_id", "group")
    cut = blocks(cells.select("cell_id"), block_cells, seed)
    n_blocks = max(1, -(-cells.count() // block_cells))
    q = mx.subset(activity, genes).join(cut, "cell_id").select("block", F.lit(None).cast("string").alias("group"), "feature_id", "cell_id", F.col("value").cast("double").alias("value"))
    r = mx.subset(rna, genes).join(F.broadcast(ref), "cell_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select("block", "group", "feature_id", "cell_id", F.col("value").cast("double").alias("value"))
    r = r.toDF("r_block", "r_group", "r_feature", "r_cell", "r_value")  # fresh names, should both sides share a source
    kind = cells.schema["cell_id"].dataType.simpleString()
    rkind = rna_cells.schema["cell_id"].dataType.simpleString()
    gkind = rna.schema["feature_id"].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = ["cell_id", "predicted_group", "prediction_score", "rna_predicted_cell", "genes", "values"]
        b.columns = ["block", "group", "feature_id", "cell_id", "value"]
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in cols})
        ca, cb = sorted(a["cell_id"].unique()), sorted(b["cell_id"].unique())
        gs = sorted(set(a["feature_id"]) | set(b["feature_id"]))
        group = b.drop_duplicates("cell_id").set_index("cell_id")["group"]
        x, y = canonical(_scaled(a, ca, gs), _scaled(b, cb, gs), rank)
        label, score, best, w = transfer(x, y, group.loc[cb].to_numpy().astype(str))
        raw = np.zeros((len(cb), len(gs)))
        raw[b["cell_id"].map({c: i for i, c in enumerate(cb)}), b["feature_id"].map({g: i for i, g in enumerate(gs)})] = b["value"]
        imputed = w @ raw
        return pd.DataFrame({"cell_id": ca, "predicted_group": label, "prediction_score": score, "rna_predicted_cell": [cb[i] for i in best],
                             "genes": [[gs[j] for j in np.flatnonzero(v)] for v in imputed], "values": [v[v != 0].tolist() for v in imputed]})

    both = q.groupBy("block").cogroup(r.groupBy("r_block")).applyInPandas(
        run, f"cell_id {kind}, predicted_group string, prediction_score double, rna_predicted_cell {rkind}, genes array<{gkind}>, values array<double>")
    from chromalake.runtime import materialize

    both = materialize(spark, both, "integration")
    imputed = both.select("cell_id", F.explode(F.arrays_zip("genes", "values")).alias("z")).select(F.col("z.genes").alias("feature_id"), "cell_id", F.col("z.values").alias("value"))
    return both.select("cell_id", "predicted_group", "prediction_score", "rna_predicted_cell"), imputed
