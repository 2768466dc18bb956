"""Operators on a Study: each returns a new one with columns, embeddings or experiments added.

A study's experiments are found by name, alternative experiments included, and results are
written back to where the experiment was found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalake.functions import genomic as g
from chromalake.model import Experiment, Study
from chromalake.operators import cluster as cl, counting as ct, doublets as db, integrate as ig, lsi, markers as mk, matrix as mx, peaks as pk, pseudobulk as pb, qc, scores as sc
from chromalake.runtime import materialize


def _spark(e: Experiment):
    return e.counts.sparkSession


def add_tss_enrichment(study: Study, name: str, fragments: DataFrame, genes: DataFrame, column: str = "tss_enrichment", force: bool = False, **how) -> Study:
    """Cells gain their promoter enrichment."""
    e = study.find(name)
    if column in e.cells.columns and not force:
        raise ValueError(f"column {column} exists")
    scores = sc.tss_enrichment(fragments, genes, **how).withColumnRenamed("tss_enrichment", column)
    return study.replace_experiment(name, e.with_cell_columns(scores))


def add_gene_scores(study: Study, tiles: str, genes: DataFrame, name: str = "GeneScoreMatrix", **how) -> Study:
    """A new experiment of gene activities from a tile matrix."""
    e = study.find(tiles)
    counts = sc.gene_scores(e.counts, genes, e.features, **how).withColumnRenamed("gene", "feature_id")
    return study.with_experiment(name, Experiment(counts, genes.withColumn("feature_id", F.col("name")), e.cells))


def add_lsi(study: Study, name: str, embedding: str = "iterativeLSI", force: bool = False, depth: tuple[str, str] | None = None, **how) -> Study:
    """An embedding of the experiment's cells; ``depth`` may name another experiment's column."""
    e = study.find(name)
    if embedding in e.reduced_dims and not force:
        raise ValueError(f"embedding {embedding} exists")
    cells = e.cells.select("cell_id", "sample", "fragments") if depth is None else e.cells.select("cell_id", "sample").join(study.find(depth[0]).cells.select("cell_id", F.col(depth[1]).alias("fragments")), "cell_id")
    got = lsi.iterative_lsi(_spark(e), e.counts, cells, **how)
    if got is None:
        raise ValueError("clustering found one cluster only")
    return study.replace_experiment(name, e.with_reduced_dim(embedding, got[0], force))


def add_clusters(study: Study, name: str, embeddings: list[str] | str, column: str = "clusters", dims: dict[str, list[int]] | None = None, force: bool = False, **how) -> Study:
    """Cells gain cluster labels from one or more embeddings side by side."""
    e = study.find(name)
    if column in e.cells.columns and not force:
        raise ValueError(f"column {column} exists")
    names = [embeddings] if isinstance(embeddings, str) else embeddings
    both = mx.concat_embeddings({n: study.find_reduced_dim(n) for n in names}, dims)
    labels = cl.cluster_embedding(_spark(e), both, e.cells, **how).withColumnRenamed("cluster", column)
    return study.replace_experiment(name, e.with_cell_columns(labels))


def add_doublet_scores(study: Study, name: str, **how) -> Study:
    e = study.find(name)
    return study.replace_experiment(name, e.with_cell_columns(db.doublet_scores(_spark(e), e.counts, e.cells.select("cell_id", "sample", "fragments"), **how)))


def combine_doublets(studies: list[Study], name: str) -> Study:
    """The first study with the other studies' scores where these are known."""
    parts = [s.find(name).cells for s in studies]
    return studies[0].replace_experiment(name, studies[0].find(name).with_cell_columns(db.combine_results(parts)))


def filter_duplicates(experiment: Experiment, column: str = "name", stat: Callable = F.sum, best: str = "max") -> Experiment:
    """The experiment with one feature per name."""
    kept = mx.dedupe_features(experiment.counts, experiment.features, column, stat, best)
    return Experiment(mx.subset(experiment.counts, kept), kept, experiment.cells, experiment.reduced_dims, experiment.alt)


def add_group_coverages(study: Study, name: str, group: str = "clusters", new: str | None = None, **how) -> tuple[Study, DataFrame]:
    """(study, selected): replicate columns on the cells and an experiment of replicate sums."""
    e = study.find(name)
    selected = materialize(_spark(e), pb.select_cells(e.cells, group, **how), "pseudobulk")
    study = study.replace_experiment(name, Experiment(e.counts, e.features, pb.membership_columns(e.cells, selected), e.reduced_dims, e.alt))
    table = pb.replicate_table(selected).withColumnRenamed("replicate", "cell_id")
    sums = pb.pseudobulk_counts(e.counts, selected).withColumnRenamed("replicate", "cell_id")
    return study.with_experiment(new or f"{name}_pseudobulk", Experiment(sums, e.features, table)), selected


def add_peaks(study: Study, name: str, fragments: DataFrame, selected: DataFrame, genome_size: float, genes: DataFrame | None = None, exons: DataFrame | None = None, new: str = "PeakMatrix",
              reproducibility: str = "2", extend: int = 250, lengths: DataFrame | None = None, groups: list[str] | None = None, **how) -> Study:
    """Calls peaks per replicate, merges them, counts fragments and annotates."""
    e = study.find(name)
    use = selected if groups is None else selected.where(F.col("group").isin(groups))
    reps = use.select(F.concat_ws("/", "group", F.col("rep").cast("string")).alias("unit"), g.cell_sample(F.col("cell_id")).alias("sample"), g.cell_barcode(F.col("cell_id")).alias("barcode"))
    cuts = fragments.join(reps, ["sample", "barcode"]).select(F.col("unit").alias("group"), F.col("chrom").alias("seqname"), "start")
    summits = pk.call_peaks(cuts, genome_size, **how)
    named = summits.select(F.split("group", "/")[0].alias("group"), F.col("group").alias("replicate"), "seqname", "start", "end", "score")
    peaks = materialize(_spark(e), pk.peak_set(named, reproducibility, extend, lengths), "peaks")
    features = sc.annotate_peaks(peaks, genes, exons) if genes is not None else peaks
    return study.with_experiment(new, Experiment(ct.region_counts(fragments, peaks, cells=e.cells), features, e.cells))


def add_markers(study: Study, name: str, group: str = "clusters", groups_from: str | None = None) -> Study:
    """An experiment ``<name>_marker_features`` with a row of statistics per group and feature."""
    e = study.find(name)
    cells = study.find(groups_from or name).cells.select("cell_id", F.col(group).alias("cluster"))
    return study.with_experiment(f"{name}_marker_features", Experiment(features=mk.marker_features(e.counts, cells)))


def add_gene_integration(study: Study, activity: str, rna: Experiment, group: str = "group", new: str = "GeneIntegrationMatrix", **how) -> Study:
    """Cells gain transferred labels; imputed expression becomes an experiment."""
    e = study.find(activity)
    labels, imputed = ig.gene_integration(_spark(e), e.counts, e.cells, rna.counts, rna.cells.select("cell_id", F.col(group).alias("group")), **how)
    study = study.replace_experiment(activity, e.with_cell_columns(labels))
    return study.with_experiment(new, Experiment(imputed, None, e.cells))


#: The tables behind the three quality-control plots.
plot_enrichment_vs_depth = qc.enrichment_vs_depth
plot_fragment_sizes = qc.size_distribution
plot_cluster_confusion = qc.cluster_confusion
