"""Doublet scores from simulated doublets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from chromalake.functions import stats as st
from chromalake.operators import lsi as ls
from chromalake.operators.knn import exact_knn
from chromalake.operators.sweep import numbered
from chromalake.runtime import materialize

P = 1e-4
PER = 10_000


def simulate(counts: DataFrame, cells: DataFrame, n: int, seed: int = 5) -> DataFrame:
    """Counts of ``n`` synthetic cells, each the average of two different cells of ``cells``.

    Positions come from hashes of the synthetic cell's number, so any task can make them.
    """
    spark = counts.sparkSession
    total = cells.select("cell_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    at = numbered(cells.select("cell_id").distinct(), "cell_id", "pos")
    a = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(1)), total)
    b = F.pmod(a + 1 + F.pmod(F.xxhash64("id", F.lit(seed), F.lit(2)), F.greatest(total - 1, F.lit(1).cast("long"))), total)
    pairs = spark.range(n).select(F.concat(F.lit("doublet"), "id").alias("synthetic"), F.explode(F.array(a, b)).alias("pos"))
    return pairs.join(at, "pos").join(counts, "cell_id").groupBy(F.col("synthetic").alias("cell_id"), "feature_id").agg((F.sum("value") / 2).alias("value"))


def scores(hits: DataFrame, cells: DataFrame, n_synthetic: int) -> DataFrame:
    """(cell_id, doublet_score, doublet_enrichment) from (cell_id, hits) of neighbour counts."""
    j = cells.select("cell_id").join(hits, "cell_id", "left").na.fill(0, ["hits"])
    sums = hits.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("s")).scalar()
    n = cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    k = F.bround(F.col("hits") * PER / n_synthetic)
    trials = F.bround(sums * PER / n_synthetic)
    p = st.bonferroni(st.binomial_tail(k, trials, P), n)
    return j.select("cell_id", (-F.log10(F.greatest(p, F.lit(st.TINY)))).alias("doublet_score"), F.when(sums > 0, F.col("hits") * float(PER) / sums).otherwise(0.0).alias("doublet_enrichment"))


def doublet_scores(spark, counts: DataFrame, cells: DataFrame, seed: int = 5, trials: int = 5, rank: int = 30, max_synthetic: int = 2000, k: int = 10, samples: list[str] | None = None, **lsi) -> DataFrame:
    """Scores per sample; samples with no more cells than dimensions are left out (nulls)."""
    sizes = {r["sample"]: r["n"] for r in cells.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc()).collect()}  # one row per sample
    out = None
    for name, n in sizes.items():
        if n <= rank or (samples and name not in samples):
            continue
        own = cells.where(F.col("sample") == name)
        mine = materialize(spark, counts.join(own.select("cell_id"), "cell_id", "left_semi"), "doublet-counts")
        got = ls.iterative_lsi(spark, mine, own, rank=rank, seed=seed, **lsi)
        if got is None:
            continue
        embedding, model = got
        made = min(trials * n, max_synthetic)
        synthetic = ls.project_cells(simulate(mine, embedding.select("cell_id"), made, seed), model)
        near = exact_knn(synthetic, embedding, k)
        hits = near.groupBy(F.col("ref_id").alias("cell_id")).agg(F.count(F.lit(1)).alias("hits"))
        part = scores(hits, embedding.select("cell_id"), made)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return cells.select("cell_id", F.lit(None).cast("double").alias("doublet_score"), F.lit(None).cast("double").alias("doublet_enrichment"))
    return cells.select("cell_id").join(out, "cell_id", "left")


def combine_results(parts: list[DataFrame]) -> DataFrame:
    """Later rows with a score or an enrichment win over earlier ones."""
    out = None
    for i, p in enumerate(parts):
        row = p.select("cell_id", "doublet_score", "doublet_enrichment", F.lit(i).alias("_i"))
        out = row if out is None else out.unionByName(row)
    known = F.col("doublet_score").isNotNull() | F.col("doublet_enrichment").isNotNull()
    pick = F.max_by(F.struct("doublet_score", "doublet_enrichment"), F.when(known, F.col("_i")).otherwise(F.lit(-1)))
    base = parts[0].select("cell_id")
    return base.join(out.groupBy("cell_id").agg(pick.alias("p")), "cell_id").select("cell_id", "p.doublet_score", "p.doublet_enrichment")


def filter_doublets(cells: DataFrame, least: float = 1.0, ratio: float = 1e-5) -> DataFrame:
    """Cells without the strongest doublets: at most ``n^2 * ratio`` of each sample."""
    per = W.partitionBy("sample")
    ranked = cells.withColumn("_r", F.row_number().over(per.orderBy(F.col("doublet_enrichment").desc_nulls_last(), "cell_id"))).withColumn("_n", F.count(F.lit(1)).over(per))
    gone = (F.coalesce(F.col("doublet_enrichment"), F.lit(0.0)) >= least) & (F.col("_r") <= F.floor(F.col("_n") * F.col("_n") * ratio))
    return ranked.where(~gone).drop("_r", "_n")
