"""Composite operators: decompositions, clusters, integration, the study container."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromalake.functions import graph
from chromalake.model import Experiment, Study, create_study
from chromalake.operators import cluster as cl, integrate as ig, knn, lsi, markers as mk, matrix as mx
from chromalake.streaming import sizes


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(3)
    rows = []
    for c in range(90):
        k = c % 3
        for f in range(60):
            v = r.poisson(3.0 if f // 20 == k else 0.2)
            if v:
                rows.append((f, f"s#c{c:02d}", int(v)))
    counts = spark.createDataFrame(rows, "feature_id int, cell_id string, value int").cache()
    cells = counts.groupBy("cell_id").agg(F.sum("value").alias("fragments")).withColumn("sample", F.lit("s")).cache()
    return counts, cells


def test_decomposition(spark, blobs):
    counts, _ = blobs
    embedding, model = lsi.fit_lsi(spark, counts, 4, outlier_quantiles=None)
    w = mx.tf_idf(counts, 2, 1e4, 90).toPandas().pivot(index="feature_id", columns="cell_id", values="value").fillna(0)
    s = np.linalg.svd(w.to_numpy(), compute_uv=False)[:3]
    assert np.allclose(model.d[:3], s, rtol=2e-3)
    assert np.allclose(model.u.T @ model.u, np.eye(model.u.shape[1]), atol=1e-8)
    again = lsi.projection_check(embedding, lsi.project_cells(counts, model)).collect()
    assert min(r["correlation"] for r in again) > 0.999


def test_clusters_and_iteration(spark, blobs):
    counts, cells = blobs
    embedding, _ = lsi.iterative_lsi(spark, counts, cells, rank=5, num_features=50, filter_quantile=1.0, resolution=0.8, total_features=60)
    got = cl.cluster_embedding(spark, embedding, cells, resolution=0.8).toPandas()
    got["k"] = got["cell_id"].str[3:].astype(int) % 3
    assert got["cluster"].str.match("C[0-9]+").all()
    assert got.groupby("cluster")["k"].nunique().max() == 1


def test_vote_ties(spark):
    n = spark.createDataFrame([("q", r) for r in "abcd"], "query_id string, ref_id string")
    lab = spark.createDataFrame([("a", "C1"), ("b", "C1"), ("c", "C2"), ("d", "C2")], "cell_id string, cluster string")
    assert knn.vote(n, lab, ties="last").first()["cluster"] == "C2"
    assert knn.vote(n, lab, ties="first").first()["cluster"] == "C1"


@pytest.mark.parametrize("small", [0, knn.SMALL])
def test_knn_blocks(spark, small):
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 4))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id int, embedding array<double>")
    got = knn.exact_knn(d, d, 3, exclude_self=True, block=17, small=small).toPandas()
    dist = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(dist, np.inf)
    want = {(i, j) for i in range(60) for j in np.argsort(dist[i])[:3]}
    assert set(zip(got["query_id"], got["ref_id"], strict=True)) == want


@pytest.mark.parametrize("small", [0, knn.SMALL])
def test_knn_apart(spark, small):
    x = [0.0, 1.0, 2.0, 3.0, 10.0, 11.0]
    d = spark.createDataFrame([(i, [v], "ab"[i % 2]) for i, v in enumerate(x)], "cell_id int, embedding array<double>, side string")
    got = knn.exact_knn(d, d, 9, apart="side", block=2, small=small).toPandas()
    want = {i: sorted((j for j in range(6) if (i - j) % 2), key=lambda j: (abs(x[i] - x[j]), j)) for i in range(6)}  # noqa: B023
    assert {i: g.sort_values("rank")["ref_id"].tolist() for i, g in got.groupby("query_id")} == want


@pytest.mark.parametrize("k", [1, 16])
def test_matched_cells(spark, k):
    """Nearest of all members first, in hashed order, then the second nearest; asked again while too few."""
    r = np.random.default_rng(4)
    n = 40
    x, side = r.integers(0, 9, (n, 2)).astype(float), np.array(["a" if i < 25 else "b" if i < 39 else "c" for i in range(n)])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id int, embedding array<double>")
    g = spark.createDataFrame([(i, str(s)) for i, s in enumerate(side)] + [(99, None)], "cell_id int, cluster string")
    got = mk.matched_cells(p, g, k=k).toPandas()
    for name in "abc":
        ins, outs = np.flatnonzero(side == name), np.flatnonzero(side != name)
        turn = sorted(ins, key=lambda i: hashlib.md5(f"{i}:1".encode()).hexdigest())
        near = [sorted(outs, key=lambda j: (((x[i] - x[j]) ** 2).sum(), j)) for i in turn]  # noqa: B023
        want = list(dict.fromkeys(c for rank in zip(*near, strict=True) for c in rank))[: min(len(ins), len(outs))]
        mine = got[got["group"] == name]
        assert set(mine[mine["inside"]]["cell_id"]) == set(ins)
        assert sorted(mine[~mine["inside"]]["cell_id"]) == sorted(want)


def test_walks_and_cut():
    r = np.random.default_rng(6)
    edges = {(i, j): 1.0 for i in range(30) for j in range(i + 1, 30) if r.random() < (0.8 if i // 10 == j // 10 else 0.04)}
    a = np.zeros((30, 30))
    for (i, j), w in edges.items():
        a[i, j] = a[j, i] = w
    a[np.diag_indices(30)] = a.sum(1) / np.maximum((a > 0).sum(1), 1)
    d = a.sum(1)
    want = np.linalg.matrix_power(a / d[:, None], 4) / np.sqrt(d)
    assert np.allclose(graph._walks(graph._adjacency(30, edges), 4, block=7), want)
    assert graph.walktrap(30, edges).tolist() == [i // 10 for i in range(30)]
    assert graph.walktrap(3, {}).tolist() == [0, 1, 2]


def test_integration(spark, blobs):
    counts, cells = blobs
    rna = counts.withColumn("cell_id", F.concat(F.lit("r"), "cell_id"))
    groups = cells.select(F.concat(F.lit("r"), "cell_id").alias("cell_id"), (F.substring("cell_id", 4, 2).cast("int") % 3).cast("string").alias("group"))
    labels, imputed = ig.gene_integration(spark, counts, cells, rna, groups, n_genes=60, rank=5)
    got = labels.toPandas()
    assert (got["predicted_group"].astype(int) == got["cell_id"].str[3:].astype(int) % 3).mean() > 0.95
    assert imputed.count() > 0


def test_study(spark):
    f = spark.createDataFrame([("S", "c", 10, 400, "A"), ("T", "c", 10, 600, "B")], "sample string, chrom string, start long, end long, barcode string")
    study = create_study(f)
    e = study.find("TileMatrix500")
    assert {r["cell_id"] for r in e.cells.collect()} == {"S#A", "T#B"} and study.samples.count() == 2
    child = Experiment(cells=e.cells.select("cell_id", F.lit(9).alias("fragments")))
    nested = study.replace_experiment("TileMatrix500", Experiment(e.counts, e.features, e.cells, alt={"peaks": child}))
    found = nested.find("peaks").cells
    assert set(found.columns) == {"cell_id", "fragments", "sample"} and found.first()["fragments"] == 9
    assert Study({"a": Experiment().with_reduced_dim("x", found)}).find_reduced_dim("x") is found
    with pytest.raises(KeyError):
        study.find("none")
    with pytest.raises(ValueError):
        study.with_experiment("TileMatrix500", e)


def test_streamed_sizes(spark, tmp_path):
    f = spark.createDataFrame([("S", "c", 100, 250, "A"), ("S", "c", 1, 151, "B")], "sample string, chrom string, start long, end long, barcode string")
    f.write.parquet(str(tmp_path / "in"))
    q = sizes.stream_sizes(spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("sizes").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("sizes").collect()] == [(150, 2)]
