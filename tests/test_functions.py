"""Values worked out by hand from the formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromalake.functions import genomic as g, graph, stats as st
from chromalake.operators import counting as ct, doublets as db, intervals as iv, markers as mk, matrix as mx, peaks as pk, pseudobulk as pb, scores as sc
from chromalake.sources import fragments as fs

FRAG = "sample string, chrom string, start long, end long, barcode string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fragment_file(spark, tmp_path):
    p = tmp_path / "f.tsv"
    p.write_text("# id=x\n# genome = hg=38\nchr1\t100\t250\tAAAC-1\t2\nchr1\t300\t301\tAAAG-1\t1")
    assert rows(fs.read_fragments(spark, str(p)), "chrom", "start", "end", "barcode") == [("chr1", 100, 250, "AAAC-1"), ("chr1", 300, 301, "AAAG-1")]
    assert rows(fs.read_fragment_header(spark, str(p)), "key", "value") == [("genome", "hg=38"), ("id", "x")]


@pytest.mark.parametrize(("bad", "line"), [("chr1\t1\t2\tA\n", 2), ("chr1\t1\t2\tA\t1\t9\n", 2), ("chr1\t1\t2\t\t1\n", 2), ("chr1\t1a\t2\tA\t1\n", 2), ("\nchr1\t1\t2\tA\t1\n", 2), ("# late\n", 2)])
def test_fragment_errors_name_the_line(spark, tmp_path, bad, line):
    p = tmp_path / "f.tsv"
    p.write_text("chr1\t1\t2\tA\t1\n" + bad)
    with pytest.raises(Exception, match=f"line {line}:"):
        fs.read_fragments(spark, str(p)).collect()
    found = fs.read_fragments(spark, str(p), "permissive").where("problem is not null")
    assert [r["line_no"] for r in found.collect()] == [line]


def test_gzip_summits_and_coverage(spark, tmp_path):
    import gzip

    p = tmp_path / "f.tsv.gz"
    p.write_bytes(gzip.compress(b"#h\nchr1\t1\t9\tA\t1\n"))
    assert fs.read_fragments(spark, str(p)).count() == 1
    (tmp_path / "s.bed").write_text("chr1\t10\t11\tpk\t4.5\n")
    assert rows(fs.read_summits(spark, str(tmp_path / "s.bed")), "seqname", "start", "end", "score") == [("chr1", 11, 11, 4.5)]
    f = spark.createDataFrame([("S", "chr1", 1, 9, "A"), ("S", "chr1", 2, 9, "B"), ("T", "chr1", 3, 9, "A")], FRAG)
    sel = spark.createDataFrame([("g", 1, "S", "A"), ("g", 2, "S", "A")], "group string, rep int, sample string, barcode string")
    out = str(tmp_path / "cov")
    fs.write_coverage(f, sel, out)
    assert rows(fs.read_coverage(spark, out), "group", "rep", "start", "barcode") == [("g", 1, 1, "A"), ("g", 2, 1, "A")]
    with pytest.raises(Exception, match="(?i)exist"):
        fs.write_coverage(f, sel, out)


def test_sizes_and_tiles(spark):
    f = spark.createDataFrame([("S", "c", 100, 250, "A"), ("S", "c", 300, 301, "A"), ("S", "c", 0, 5501, "A")], FRAG)
    got = ct.fragment_sizes(f).where("n > 0")
    assert rows(got, "size", "n", "percent") == [(1, 1, 50.0), (150, 1, 50.0)]
    assert ct.fragment_sizes(f).count() == 5500
    assert rows(ct.oversize(f), "n", "largest") == [(1, 5501)]
    t = spark.createDataFrame([("S", "c", 10, 400, "A"), ("S", "c", 10, 600, "A"), ("S", "c", 10, 1200, "B")], FRAG)
    assert rows(ct.tile_counts(t), "tile", "cell_id", "value") == [(0, "S#A", 2), (0, "S#B", 1), (1, "S#A", 1), (2, "S#B", 1)]


def test_region_counts_once_per_region(spark):
    f = spark.createDataFrame([("S", "c", 9, 20, "A"), ("S", "c", 9, 35, "A")], FRAG)
    r = spark.createDataFrame([("x", "c", 5, 22), ("y", "c", 30, 40), ("z", "c", 10, 35)], "feature_id string, seqname string, start long, end long")
    assert rows(ct.region_counts(f, r), "feature_id", "value") == [("x", 2), ("y", 1), ("z", 2)]


def test_gene_weights(spark):
    genes = spark.createDataFrame([("G1", "chr1", 10001, 12000, "+"), ("G2", "chr1", 50001, 50500, "-")], "name string, seqname string, start long, end long, strand string")
    tiles = spark.createDataFrame([(f"t{s}", "chr1", s, s + 499) for s in (4501, 5001, 12001, 14501)], "feature_id string, seqname string, start long, end long")
    w = {(r["gene"], r["feature_id"]): r for r in sc.gene_weights(genes, tiles).collect()}
    assert w["G1", "t4501"]["distance"] == 0
    assert w["G1", "t14501"]["distance"] == 2500
    for t, v in (("t4501", 21.430111), ("t5001", 21.430111), ("t12001", 21.430111), ("t14501", 15.265758)):
        assert w["G1", t]["weight"] == pytest.approx(v, abs=1e-5)


def test_tss_score_formula(spark):
    for w, f, want in ((5, 3, 0.495), (40, 25, 3.168), (0, 0, 0)):
        s = spark.range(1).select(F.bround(2 * (F.lit(w) / 101) / F.greatest(F.lit(f) / 100, F.lit(0.2)), 3).alias("s"))
        assert s.first()["s"] == pytest.approx(want)


def test_tf_idf(spark):
    c = spark.createDataFrame([("f1", "c1", 1.0), ("f2", "c1", 1.0), ("f1", "c2", 1.0), ("f3", "c3", 2.0), ("f1", "c3", 2.0)], "feature_id string, cell_id string, value double")
    b = mx.binarize(c)
    assert b.count() == 5
    got = {m: {(r["cell_id"], r["feature_id"]): r["value"] for r in mx.tf_idf(c, m).collect()} for m in (1, 2, 3)}
    # row sums 4, 1, 2; column sums 2, 1, 4; three cells
    assert got[1]["c1", "f1"] == pytest.approx(0.5 * math.log(1 + 3 / 4), abs=1e-6)
    assert got[2]["c1", "f2"] == pytest.approx(math.log(0.5 * 3 / 1 * 1e4 + 1), abs=1e-6)
    assert got[2]["c1", "f2"] == pytest.approx(9.615872, abs=1e-5)
    assert got[3]["c3", "f3"] == pytest.approx(math.log(1.5) * math.log(1 + 3 / 2), abs=1e-6)
    assert got[3]["c3", "f3"] == pytest.approx(0.371524, abs=1e-5)


def test_rank_sum(spark):
    v = [("f", f"a{i}", x) for i, x in enumerate([3, 0, 0, 2])] + [("f", f"b{i}", x) for i, x in enumerate([0, 1, 0, 0])]
    c = spark.createDataFrame([(f, k, float(x)) for f, k, x in v if x], "feature_id string, cell_id string, value double")
    m = spark.createDataFrame([("g", k, k[0] == "a") for _, k, _ in v], "group string, cell_id string, inside boolean")
    r = mk.rank_test(c, m).first()
    assert (r["u"], r["auc"]) == (11, 0.6875)
    assert r["z"] == pytest.approx(0.826797, abs=1e-6)
    assert r["pval"] == pytest.approx(0.408352, abs=1e-6)
    s = mk.marker_statistics(c, m).first()
    assert s["log2_fc"] == pytest.approx(1.584963, abs=1e-6)
    assert s["log2_mean"] == pytest.approx(2.0)


def test_tails():
    assert math.exp(st.log_binomial_tail(3, 1000, 1e-4)) == pytest.approx(1.542235e-04, rel=1e-5)
    assert st.log_binomial_tail(0, 10, 0.1) == 0
    assert math.exp(st.log_poisson_tail(2, 1.0)) == pytest.approx(1 - 2 / math.e)


def test_rank_quantile(spark):
    d = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 4.0)], "i int, v double")
    assert [r["q"] for r in d.withColumn("q", st.rank_quantile("v", [])).orderBy("i").collect()] == [0.25, 0.5, 0.5, 1.0]


def test_dedupe_features(spark):
    names = ["a", "b", "a", None, None, "a"]
    f = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "feature_id int, name string")
    c = spark.createDataFrame([(1, "c", 5), (2, "c", 1), (3, "c", 9), (6, "c", 9)], "feature_id int, cell_id string, value int")
    assert rows(mx.dedupe_features(c, f), "feature_id") == [(2,), (3,), (4,), (5,)]


def test_peak_annotation(spark):
    gene = spark.createDataFrame([("c", 1000, 5000, "+", "G")], "seqname string, start long, end long, strand string, symbol string")
    exon = spark.createDataFrame([("c", 1000, 1200)], "seqname string, start long, end long")
    p = spark.createDataFrame([(1, "c", 900, 950), (2, "c", 1050, 1090), (3, "c", 1150, 1190), (4, "c", 3000, 3100), (5, "c", 9000, 9100), (6, "d", 1, 2)], "feature_id int, seqname string, start long, end long")
    got = {r["feature_id"]: r for r in sc.annotate_peaks(p, gene, exon).collect()}
    assert [got[i]["peak_type"] for i in range(1, 7)] == ["Promoter", "Promoter", "Exonic", "Intronic", "Distal", "Distal"]
    assert got[5]["dist_to_gene_start"] == 7999 and got[6]["nearest_gene"] is None


def test_strand_aware_windows(spark):
    d = spark.createDataFrame([(10001, 12000, "+"), (50001, 50500, "-")], "start long, end long, strand string")
    x = g.extended(F.col("start"), F.col("end"), F.col("strand"), 5000, 0)
    assert rows(d.select(x[0].alias("a"), x[1].alias("b")), "a", "b") == [(5001, 12000), (50001, 55500)]
    w = g.widened(F.col("start"), F.col("end"), 100, F.col("strand"), anchor_end_on_minus=True)
    assert rows(d.select(w[0].alias("a"), w[1].alias("b")), "a", "b") == [(9901, 12100), (49701, 50400)]


def test_self_overlaps_and_binned_join(spark):
    import random

    r = random.Random(1)
    iv_ = [(i, "c" if r.random() < 0.5 else "d", s := r.randrange(1, 3000), s + r.randrange(0, 400)) for i in range(120)]
    d = spark.createDataFrame(iv_, "k int, seqname string, start long, end long")
    want = sorted((a[0], b[0]) for a in iv_ for b in iv_ if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert rows(iv.self_overlaps(d, "k", bin_size=64), "l_k", "r_k") == want


@pytest.mark.parametrize(("counts", "tier"), [((60, 50), 1), ((50, 30, 30), 2), ((85,), 3), ((75,), 4), ((65,), 5), ((63,), None)])
def test_pseudobulk_tiers(spark, counts, tier):
    cells = spark.createDataFrame([(f"S{s}#{i}", "g", f"S{s}") for s, n in enumerate(counts) for i in range(n)], "cell_id string, cluster string, sample string")
    assert pb.tiers(cells).first()["tier"] == tier
    sel = pb.select_cells(cells, max_cells=45).groupBy("rep").count().collect()
    if tier is None:
        assert sel == []
    else:
        assert len(sel) >= 2 and all(r["count"] >= 32 for r in sel)
    if tier in (1, 2, 3):
        assert pb.select_cells(cells).groupBy("cell_id").count().where("count > 1").count() == 0


def test_combine_and_scores(spark):
    s = "cell_id string, doublet_score double, doublet_enrichment double"
    a = spark.createDataFrame([("x", 1.0, 1.0), ("y", 2.0, None), ("z", None, None)], s)
    b = spark.createDataFrame([("x", None, None), ("y", None, 5.0)], s)
    assert sorted(map(str, (tuple(r) for r in db.combine_results([a, b]).collect()))) == ["('x', 1.0, 1.0)", "('y', None, 5.0)", "('z', None, None)"]
    hits = spark.createDataFrame([("x", 3)], "cell_id string, hits long")
    got = {r["cell_id"]: r for r in db.scores(hits, a.select("cell_id"), 2000).collect()}
    assert got["x"]["doublet_enrichment"] == 10000 and got["y"]["doublet_enrichment"] == 0
    assert got["x"]["doublet_score"] == pytest.approx(-math.log10(min(1, 3 * math.exp(st.log_binomial_tail(15, 15, 1e-4)))), rel=1e-6)


def test_filter_doublets(spark):
    # ten cells a sample, of which two may go: the strongest, by name where they tie, and none below ``least``
    cells = [(f"a{i}", "a", e) for i, e in enumerate([9.0, 5.0, 5.0, 5.0, 0.5, 0.0, None, None, 1.0, 2.0])]
    cells += [(f"b{i}", "b", e) for i, e in enumerate([3.0, *[0.5] * 8, None])] + [("c0", "c", 9.0)]
    d = spark.createDataFrame(cells, "cell_id string, sample string, doublet_enrichment double")
    got = db.filter_doublets(d, 1.0, 0.02)
    assert got.columns == d.columns
    assert {c for c, *_ in cells} - {r["cell_id"] for r in got.collect()} == {"a0", "a1", "b0"}


def test_greedy_peaks(spark):
    d = spark.createDataFrame([("c", 1, 10, 5.0), ("c", 8, 17, 9.0), ("c", 16, 25, 7.0), ("c", 100, 109, 1.0)], "seqname string, start long, end long, score double")
    assert rows(pk.remove_overlaps(d, "score", ["seqname"]), "start") == [(8,), (100,)]


def test_graph_clustering():
    edges = {(a, b): 1.0 for base in (0, 5) for a in range(base, base + 5) for b in range(a + 1, base + 5)} | {(4, 5): 0.1}
    for label in (graph.louvain(10, edges), graph.walktrap(10, edges)):
        assert label.tolist() == [0] * 5 + [1] * 5
    x = np.array([[0.0], [0.1], [5.0], [5.2]])
    merges = graph.complete_linkage(x)
    assert graph.cut_tree(4, merges, 2).tolist() == [0, 0, 1, 1]
    assert graph.leaf_order(4, merges) == [0, 1, 2, 3]
