"""Clustering of cells on an embedding.

At most ``cells_to_sample`` cells form the graph, in one process; all other cells take the
majority of their nearest sampled neighbours by a distributed join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalake.functions import graph
from chromalake.operators import matrix as mx
from chromalake.operators.knn import exact_knn, vote
from chromalake.operators.lsi import drop_depth_dims
from chromalake.operators.sweep import bin_window, in_bins
from chromalake.runtime import materialize, ship_package


def graph_clusters(spark, embedding: DataFrame, k: int = 20, method: str = "louvain", resolution: float = 0.8, seed: int = 17) -> DataFrame:
    """(cell_id, cluster int from 1) of a bounded set of cells, by shared neighbours."""
    if method not in ("louvain", "walktrap"):
        raise ValueError("method is louvain or walktrap")
    ids = [r["cell_id"] for r in embedding.select("cell_id").orderBy("cell_id").collect()]  # the sample only
    at = {c: i for i, c in enumerate(ids)}
    n, k = len(ids), min(k, len(ids))
    near = exact_knn(embedding, embedding, k).select("query_id", "ref_id", "rank").toArrow().to_pandas()
    table = np.tile(np.arange(n)[:, None], (1, k))
    table[near["query_id"].map(at).to_numpy(), near["rank"].to_numpy() - 1] = near["ref_id"].map(at).to_numpy()
    edges = graph.shared_neighbour_graph(table)
    label = graph.louvain(n, edges, resolution, seed) if method == "louvain" else graph.walktrap(n, edges)
    return spark.createDataFrame([(c, int(x) + 1) for c, x in zip(ids, label, strict=True)], f"cell_id {embedding.schema['cell_id'].dataType.simpleString()}, cluster int")


def reassign(embedding: DataFrame, labels: DataFrame, cells: DataFrame, k: int = 10, ties: str = "first") -> DataFrame:
    """Labels with the listed cells voted anew by their nearest neighbours outside the list."""
    part = embedding.join(cells.select("cell_id").distinct(), "cell_id", "left_semi")
    rest = embedding.join(cells.select("cell_id").distinct(), "cell_id", "left_anti")
    voted = vote(exact_knn(part, rest, k), labels, ties=ties).select(F.col("query_id").alias("cell_id"), F.col("cluster").alias("_new"))
    return labels.join(voted, "cell_id", "left").select("cell_id", F.coalesce("_new", "cluster").alias("cluster"))


def biased_clusters(labels: DataFrame, depth: DataFrame, max_share: float = 0.01, permutations: int = 500, seed: int = 1) -> list:
    """Small clusters whose depth ranks lie at an end more than chance allows.

    A cluster below ``max_share`` of the cells is biased if the share of its cells in the outer
    5 % of depth ranks exceeds one half and ten times what is expected, and no more than 5 % of
    random draws of its size reach its median distance from the centre.
    """
    n = labels.count()
    small = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < max_share * n)
    rows = small.collect()  # one row per small cluster
    if not rows:
        return []
    at = labels.join(depth, "cell_id").na.fill(0, ["depth"])
    # ranks of the distinct depths, carried from bin to bin
    sizes = in_bins(at.groupBy("depth").agg(F.count(F.lit(1)).alias("_n")), [], F.col("depth"), {"_below": (F.sum, F.col("_n"))})
    less = F.coalesce("_below", F.lit(0)) + F.sum("_n").over(bin_window([], "depth")) - F.col("_n")
    rank = F.floor(less / max(n - 1, 1) * n) / n
    ranked = at.join(sizes.select("depth", F.abs(rank - 0.5).alias("q")), "depth")
    cut = ranked.where(F.col("q") >= 0.475).groupBy("cluster").agg(F.count(F.lit(1)).alias("ends"))
    medians = ranked.groupBy("cluster").agg(F.median("q").alias("m")).join(cut, "cluster", "left").na.fill(0, ["ends"])
    found = {r["cluster"]: r for r in medians.join(small, "cluster").collect()}
    out, rng = [], np.random.default_rng(seed)
    for r in rows:
        got = found[r["cluster"]]
        share = got["ends"] / r["n"]
        if share <= 0.5 or share / 0.05 <= 10:
            continue
        # ranks are evenly spread, so a random draw of cells is a draw of ranks
        draws = np.median(np.abs(rng.integers(0, n, (permutations, r["n"])) / n - 0.5), axis=1)
        if (draws >= got["m"]).mean() <= 0.05:
            out.append(r["cluster"])
    return out


def cluster_embedding(
    spark, embedding: DataFrame, cells: DataFrame | None = None, method: str = "louvain", resolution: float = 2.0, correlation_cutoff: float = 0.75, cells_to_sample: int = 10_000,
    k: int = 20, vote_k: int = 10, min_cells: int = 5, max_clusters: int | None = None, bias_test: bool = True, scale: bool = True, prefix: str = "C", seed: int = 17, depth: str = "fragments",
) -> DataFrame:
    """(cell_id, cluster like ``C1``): scaling, dimension filter, sampling and vote, bias test,
    outlier clusters, merging beyond ``max_clusters``, and names in dendrogram order."""
    ship_package(spark)
    if scale:
        embedding = mx.zscore(embedding.select("cell_id", "embedding"))
    if cells is not None:
        embedding = drop_depth_dims(embedding, cells, correlation_cutoff, depth)
    embedding = materialize(spark, embedding, "cluster-embedding")
    total = embedding.count()
    sampled = embedding
    if total > cells_to_sample:
        order = F.xxhash64("cell_id", F.lit(seed))
        sampled = embedding.orderBy(order, "cell_id").limit(cells_to_sample)
    labels = graph_clusters(spark, sampled, k, method, resolution, seed)
    if total > cells_to_sample:
        rest = embedding.join(sampled.select("cell_id"), "cell_id", "left_anti")
        voted = vote(exact_knn(rest, sampled, vote_k), labels, ties="last")
        labels = labels.unionByName(voted.select(F.col("query_id").alias("cell_id"), "cluster"))
    labels = materialize(spark, labels, "cluster-labels")
    if bias_test and cells is not None:
        for c in biased_clusters(labels, cells.select("cell_id", F.col(depth).alias("depth")), seed=seed):
            labels = materialize(spark, reassign(embedding, labels, labels.where(F.col("cluster") == c), vote_k), "cluster-bias")
    sizes = {r["cluster"]: r["n"] for r in labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c, n in sorted(sizes.items()):
        if n < min_cells and len(sizes) > 1 and total > min_cells:
            labels = materialize(spark, reassign(embedding, labels, labels.where(F.col("cluster") == c), vote_k), "cluster-small")
    return rename_by_tree(spark, embedding, labels, max_clusters, prefix)


def rename_by_tree(spark, embedding: DataFrame, labels: DataFrame, max_clusters: int | None = None, prefix: str = "C") -> DataFrame:
    """Merges to ``max_clusters`` by complete linkage of centroids, then names along the leaves."""

    def tree(labels: DataFrame):
        rows = mx.centroids(embedding, labels).collect()  # clusters x dimensions
        names = sorted({r["cluster"] for r in rows})
        x = np.zeros((len(names), 1 + max((r["dim"] for r in rows), default=0)))
        for r in rows:
            x[names.index(r["cluster"]), r["dim"]] = r["value"]
        return names, graph.complete_linkage(x)

    names, merges = tree(labels)
    if max_clusters and len(names) > max_clusters:
        groups = graph.cut_tree(len(names), merges, max_clusters)
        pairs = [(c, int(g) + 1) for c, g in zip(names, groups, strict=True)]
        labels = labels.join(F.broadcast(spark.createDataFrame(pairs, "cluster int, _to int")), "cluster").select("cell_id", F.col("_to").alias("cluster"))
        names, merges = tree(labels)
    order = graph.leaf_order(len(names), merges)
    pairs = [(names[c], f"{prefix}{i + 1}") for i, c in enumerate(order)]
    return labels.join(F.broadcast(spark.createDataFrame(pairs, "cluster int, _to string")), "cluster").select("cell_id", F.col("_to").alias("cluster"))
