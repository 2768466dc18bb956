"""The study functions, one after the other on a small made-up study."""

import random

import pytest
from pyspark.sql import functions as F

from chromalake import api
from chromalake.model import Experiment, create_study


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(4)
    rows = []
    for c in range(84):
        k = c % 2
        for _ in range(60):
            site = r.choice(range(20)) * 5000 + (0 if r.random() < 0.9 else 2500) + 100_000 * (k if r.random() < 0.9 else 1 - k)
            a = 10_000 + site + r.randrange(-60, 60)
            rows.append(("S", "chr1", a, a + r.randrange(40, 300), f"B{c:02d}"))
    f = spark.createDataFrame(rows, "sample string, chrom string, start long, end long, barcode string").cache()
    genes = spark.createDataFrame([(f"G{i}", "chr1", 10_000 + 5000 * i, 12_000 + 5000 * i, "+-"[i % 2]) for i in range(40)], "name string, seqname string, start long, end long, strand string")
    return f, genes


def test_study_functions(spark, made):
    f, genes = made
    tile = "TileMatrix500"
    s = create_study(f)
    s = api.add_tss_enrichment(s, tile, f, genes)
    assert s.find(tile).cells.where("tss_enrichment > 0").count() == 84
    with pytest.raises(ValueError):
        api.add_tss_enrichment(s, tile, f, genes)
    s = api.add_lsi(s, tile, rank=5, num_features=300, filter_quantile=1.0, iterations=1)
    assert s.find_reduced_dim("iterativeLSI").count() == 84
    s = api.add_clusters(s, tile, "iterativeLSI", resolution=0.5)
    cells = s.find(tile).cells.select("cell_id", "clusters").toPandas()
    cells["k"] = cells["cell_id"].str[3:].astype(int) % 2
    assert cells.groupby("clusters")["k"].nunique().max() == 1
    s, selected = api.add_group_coverages(s, tile, min_cells=10, max_cells=30)
    assert "pseudobulk_rep1" in s.find(tile).cells.columns and s.find(f"{tile}_pseudobulk").cells.count() >= 4
    s = api.add_peaks(s, tile, f, selected, 250_000.0, genes, cutoff=0.1, use_q=False, reproducibility="2")
    peaks = s.find("PeakMatrix")
    assert peaks.features.count() >= 10 and peaks.counts.count() > 100 and "peak_type" in peaks.features.columns
    s = api.add_gene_scores(s, tile, genes, extend=(1000, 2000))
    s = api.add_markers(s, tile)
    m = s.find(f"{tile}_marker_features").features
    assert m.where("auc > 0.6 and pval < 0.05").count() > 0
    act = s.find("GeneScoreMatrix")
    rna = Experiment(act.counts.withColumn("cell_id", F.concat(F.lit("r"), "cell_id")), None, s.find(tile).cells.select(F.concat(F.lit("r"), "cell_id").alias("cell_id"), F.col("clusters").alias("group")))
    s = api.add_gene_integration(s, "GeneScoreMatrix", rna, n_genes=40, rank=4)
    both = s.find("GeneScoreMatrix").cells.select("cell_id", "predicted_group").join(s.find(tile).cells, "cell_id")
    assert both.where("predicted_group = clusters").count() > 0.8 * 84
    s = api.add_doublet_scores(s, tile, rank=4, num_features=300, filter_quantile=1.0, iterations=1)
    assert s.find(tile).cells.where("doublet_score is not null").count() == 84
    assert api.combine_doublets([s, s], tile).find(tile).cells.count() == 84
    one = api.filter_duplicates(Experiment(act.counts, genes.select(F.col("name").alias("feature_id"), F.lit("same").alias("name")), act.cells))
    assert one.features.count() == 1
    assert api.plot_fragment_sizes(f, "S").count() == 700 and api.plot_cluster_confusion(s.find(tile).cells, "clusters").count() >= 2
