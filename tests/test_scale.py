"""Dense inputs: few rows on the way, even where many pairs come out."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromalake.functions import stats as st
from chromalake.operators import counting as ct, intervals as iv, knn, lsi, markers as mk, peaks, qc, scores as sc


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def intervals(rng, n, top, widths, strands="+-*"):
    return [(f"k{i}", rng.choice("ab"), s := rng.randrange(1, top), s + rng.choice(widths), rng.choice(strands)) for i in range(n)]


RANGE = "seqname string, start long, end long, strand string"


@pytest.fixture(scope="module")
def dense(spark):
    rng = random.Random(8)
    genes = intervals(rng, 60, 9000, (50, 300)) + [("k3", "a", 100, 7000, "+"), ("wide", "b", 1, 90_000, "-")]  # a name twice, and a wide one
    frags = [(rng.choice(["S", "T"]), rng.choice("ab"), s := rng.randrange(0, 12_000), s + rng.choice([1, 1, 40, 400]), f"B{rng.randrange(5)}") for _ in range(300)]
    return spark.createDataFrame(genes, f"name string, {RANGE}"), spark.createDataFrame(frags, "sample string, chrom string, start long, end long, barcode string"), genes, frags


def test_gene_scores_shuffle_no_products(spark, dense):
    genes, frags, _, _ = dense
    t = ct.tile_counts(frags).withColumn("feature_id", F.concat_ws(":", "seqname", "tile"))
    tiles = t.select("feature_id", "seqname", (F.col("tile") * 500 + 1).alias("start"), (F.col("tile") * 500 + 500).alias("end")).distinct()
    got = sc.gene_scores(t, genes, tiles, extend=(1000, 1000), upstream=500)
    want = sc.gene_weights(genes, tiles, (1000, 1000), upstream=500).join(t, "feature_id").groupBy("gene", "cell_id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    table = lambda df: {(r["gene"], r["cell_id"]): r["value"] for r in df.collect()}
    a, b = table(got), table(want)
    assert a.keys() == b.keys() and np.allclose([a[k] for k in b], list(b.values()))
    single = genes.where("name not in ('k3', 'wide')")
    assert "hashpartitioning(l_gene" not in plan(sc.gene_scores(t, single, tiles, extend=(1000, 1000), upstream=500))


def test_tss_enrichment_makes_no_hits(spark, dense):
    """Against the hits of all windows, one by one; sequences end where given."""
    genes, frags, _, rows = dense
    lengths = spark.createDataFrame([("a", 8000)], "seqname string, length long")
    for known in (None, lengths):
        mid, out = sc.tss_windows(genes, known)
        windows = [(k, r["seqname"], r["start"], r["end"]) for k, df in (("w", mid), ("f", out)) for r in df.collect()]
        want = {}
        for s, q, a, b, cell in rows:
            n = want.setdefault(f"{s}#{cell}", {"w": 0, "f": 0})
            for k, seq, lo, hi in windows:
                n[k] += seq == q and (lo <= a + 1 <= hi or lo <= b <= hi)
        got = sc.tss_enrichment(frags, genes, known)
        assert {r["cell_id"]: r["tss_enrichment"] for r in got.collect()} == pytest.approx({c: 2 * (n["w"] / 101) / max(n["f"] / 100, 0.2) for c, n in want.items()}, abs=6e-4)
        assert "FlatMapCoGroups" in plan(got) and "region" not in plan(got)


def test_region_counts_shuffle_no_hits(spark, dense):
    genes, frags, rows, fr = dense
    got = ct.region_counts(frags, genes.withColumnRenamed("name", "feature_id"))
    want = {}
    for name, q, lo, hi, _ in rows:
        for s, chrom, a, b, cell in fr:
            if chrom == q and (lo <= a + 1 <= hi or lo <= b <= hi):
                want[name, f"{s}#{cell}"] = want.get((name, f"{s}#{cell}"), 0) + 1
    assert {(r["feature_id"], r["cell_id"]): r["value"] for r in got.collect()} == want
    assert "hashpartitioning(l_feature_id" not in plan(ct.region_counts(frags, genes.where("name not in ('k3', 'wide')").withColumnRenamed("name", "feature_id"))).split("Window")[0]


def test_bins_and_tasks_follow_the_expected_pairs(spark):
    rows = [(f"k{i}", "a", 1 + i % 5000, 60 + i % 5000, "+") for i in range(60_000)]
    d = spark.createDataFrame(rows, f"k string, {RANGE}")
    size, tasks = iv._layout(d, d)
    assert size == 128 and tasks > 8
    assert "REPARTITION_BY_NUM" in plan(iv.overlap_join(d, d))
    sparse = d.where("start <= 3").withColumn("seqname", F.lit("b"))
    assert iv._layout(sparse, d) == (1 << 14, 1)


@pytest.mark.parametrize("gap", [0, 30])
@pytest.mark.parametrize("strandless", [True, False])
def test_overlaps_any_makes_no_pairs(spark, gap, strandless):
    rng = random.Random(2)
    a, b = intervals(rng, 80, 60_000, (-20, 0, 30, 40_000)), intervals(rng, 40, 60_000, (-1, 0, 200))
    got = iv.overlaps_any(spark.createDataFrame(a, f"name string, {RANGE}"), spark.createDataFrame(b, f"name string, {RANGE}"), "name", "hit", ignore_strand=strandless, max_gap=gap)

    def meets(x, y):
        fits = strandless or x[4] == y[4] or "*" in (x[4], y[4])
        return fits and x[1] == y[1] and x[2] - gap <= x[3] + gap and y[2] <= y[3] and x[2] - gap <= y[3] and y[2] <= x[3] + gap

    assert {r["name"]: r["hit"] for r in got.collect()} == {x[0]: any(meets(x, y) for y in b) for x in a}
    assert "r_start" not in plan(got)


def test_more_ties_than_slack_go_by_id():
    """Hundreds of references at one distance: the smallest ids are neighbours, of whole numbers or not."""
    r = np.random.default_rng(2)
    for scale in (1.0, 0.1):
        y = r.integers(0, 3, (900, 3)) * scale
        x, ids = y[:50], np.arange(900)
        got = knn._nearest(x, ids[:50], ids[:50] % 2, y, ids, ids % 2, 5)
        d2 = ((x[:, None] - y[None]) ** 2).sum(2)
        for q, g in got.groupby("query_id"):
            want = sorted((j for j in ids if (j - q) % 2), key=lambda j: (d2[q, j], j))[:5]  # noqa: B023
            assert g.sort_values("rank")["ref_id"].tolist() == want


def test_blocks_stay_few_and_distances_small(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 4)
    d = spark.createDataFrame([(i, [float(i * i % 101), float(i % 7)]) for i in range(400)], "cell_id int, embedding array<double>")
    got = knn.exact_knn(d, d, 3, exclude_self=True, small=0)
    assert knn.parts(400, 2) == knn.parts(40_000, 64) == knn.parts(600_000, 64) == 16 and knn.parts(3, 64) == 1
    assert set(map(tuple, got.select("query_id", "ref_id", "rank").collect())) == set(map(tuple, knn.exact_knn(d, d, 3, exclude_self=True).select("query_id", "ref_id", "rank").collect()))
    seen = []
    monkeypatch.setattr(np, "argpartition", lambda a, n, axis: seen.append(a.size) or np.argsort(a, axis=axis))
    y = np.random.default_rng(1).normal(size=(100_000, 2))
    knn._nearest(y[:100], np.arange(100), None, y, np.arange(len(y)), None, 2)
    assert max(seen) <= 1 << 22


def test_decomposition_by_the_smaller_side(spark):
    """Many features and few cells: nothing as long as the features reaches the driver."""
    r = np.random.default_rng(3)
    rows = [(f, f"c{c:02d}", int(v)) for c in range(40) for f in range(120) if (v := r.poisson(4.0 * (1 + c % 4) if f // 30 == c % 4 else 0.3))]
    counts = spark.createDataFrame(rows, "feature_id int, cell_id string, value int").cache()
    a, one = lsi.fit_lsi(spark, counts, 4, outlier_quantiles=None)
    b, two = lsi.fit_lsi(spark, counts, 4, outlier_quantiles=None, small=0)
    assert isinstance(one.u, np.ndarray) and not isinstance(two.u, np.ndarray) and np.allclose(one.d, two.d, rtol=1e-3)
    table = lambda e: np.array([x["embedding"] for x in e.orderBy("cell_id").collect()])
    assert np.allclose(table(a)[:, :3], table(b)[:, :3], atol=0.02 * one.d[0])
    u = np.array([x["u"] for x in two.u.collect()])
    assert np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-3) and (u[np.abs(u).argmax(0), np.arange(u.shape[1])] > 0).all()
    assert min(x["correlation"] for x in lsi.projection_check(b, lsi.project_cells(counts, two)).collect()) > 0.999


def test_adjusted_values_by_ranges(spark):
    """Ties, nulls and several groups (one without a name), with no window over a whole group of rows."""
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), i, rng.choice([None, 0.0, 1.0, round(rng.random(), 2), rng.random() ** 4])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, p double")
    got = st.benjamini_hochberg(df, "p", "q", ["g"])
    assert got.columns == ["g", "i", "p", "q"]
    found = {r["i"]: r["q"] for r in got.collect()}
    assert len(found) == 500
    for name in ("x", "y", None):
        ps = sorted((p, i) for g, i, p in rows if g == name and p is not None)
        least, want = 1.0, {}
        for r in range(len(ps), 0, -1):
            least = min(least, ps[r - 1][0] * len(ps) / r)
            want[ps[r - 1][1]] = least
        assert all(found[i] == pytest.approx(q) for i, q in want.items())
    assert all(found[i] is None for _, i, p in rows if p is None)
    windows = [line for line in plan(got).splitlines() if "Window [" in line]
    assert windows and all("_part" in line for line in windows)


def test_neighbours_within_a_radius_make_no_rows(spark):
    """Crowded, lone and repeated points, some a radius apart; squares wholly within reach are summed."""
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(0, 30, (300, 2)), r.integers(-9, 9, (200, 2)) * 10.0, [[1e5, -1e5], [1e5, -1e5 + 50]]])
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(-1, None, 1.0)], "cell_id int, u double, v double")
    got = qc.neighbour_density(d, "u", "v", 50)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    assert {v["cell_id"]: v["neighbours"] for v in got.collect()} == {i: int((row <= 2500).sum()) - 1 for i, row in enumerate(d2)}
    assert "MapInArrow" in plan(got) and "_px" not in plan(got)


def test_short_runs_are_picked_together(spark):
    """Many runs of overlapping peaks, one without a sequence name, in no call of their own."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), s := 100 * rng.randrange(400) + rng.randrange(30), s + 60, float(rng.randrange(5))) for _ in range(300)]
    rows = list({r[:3]: r for r in rows}.values())
    got = peaks.remove_overlaps(spark.createDataFrame(rows, "seqname string, start long, end long, score double"), "score", ["seqname"])
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        if not any(k[0] == r[0] and k[1] <= r[2] and r[1] <= k[2] for k in kept):
            kept.append(r)
    assert {tuple(r) for r in got.collect()} == set(kept)
    assert "MapInPandas" in plan(got) and "FlatMapGroups" not in plan(got)


def test_ranks_shuffle_a_value_once(spark):
    """Values go to their feature's task before they are copied to the groups of their cell."""
    r = np.random.default_rng(3)
    counts = spark.createDataFrame([(f, f"c{c}", int(v)) for f in range(6) for c in range(12) if (v := r.poisson(1.0))], "feature_id int, cell_id string, value int").cache()
    members = [(g, f"c{c}", c % 3 == k) for k, g in enumerate("xyz") for c in range(12) if (c + k) % 5]
    got = mk.rank_test(counts, spark.createDataFrame(members, "group string, cell_id string, inside boolean"))
    value = {(x["feature_id"], x["cell_id"]): x["value"] for x in counts.collect()}
    seen = 0
    for x in got.collect():
        ins, outs = ([value.get((x["feature_id"], c), 0) for g, c, i in members if g == x["group"] and i == side] for side in (True, False))
        assert x["auc"] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in ins for b in outs])) and (x["sum1"], x["sum2"]) == (sum(ins), sum(outs))
        seen += 1
    assert seen == 18
    assert not re.search(r"hashpartitioning\(group#\d+, feature_id", plan(got))
