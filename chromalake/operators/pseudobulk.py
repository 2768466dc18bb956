"""Pseudobulk replicates: which cells of a group make which replicate, by five tiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def group_sample_counts(cells: DataFrame, group: str = "cluster", sample: str = "sample") -> DataFrame:
    return cells.groupBy(F.col(group).alias("group"), F.col(sample).alias("sample")).agg(F.count(F.lit(1)).alias("n"))


def tiers(cells: DataFrame, group: str = "cluster", sample: str = "sample", min_cells: int = 40, min_reps: int = 2, ratio: float = 0.8) -> DataFrame:
    """(group, total, tier): the first policy that applies, or null.

    1: enough samples have more than ``min_cells`` cells; 2: small samples put together exceed
    ``min_cells * min_reps``; 3: the group is large enough for disjoint random replicates;
    4: for smaller disjoint ones topped up from what is left; 5: for independent draws.
    """
    per = group_sample_counts(cells, group, sample)
    stats = per.groupBy("group").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("samples"),
        F.sum((F.col("n") > min_cells).cast("int")).alias("big"), F.sum(F.least(F.col("n"), F.lit(min_cells))).alias("capped"))
    need = min_cells * min_reps
    tier = (
        F.when(F.col("big") >= min_reps, 1)
        .when((F.col("samples") > 1) & (F.col("capped") > need), 2)
        .when(F.col("total") >= need, 3)
        .when(F.col("total") >= need * ratio + min_cells - min_cells * ratio, 4)
        .when(F.col("total") >= need * ratio, 5)
    )
    return stats.select("group", "total", tier.alias("tier"))


def _packed(min_cells: int, min_reps: int, max_reps: int):
    """Greedy packing of samples into replicates of ``min_cells``, from their counts only."""

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["n", "sample"], ascending=[False, True])
        pool = [[s, int(n)] for s, n in zip(left["sample"], left["n"], strict=True)]
        rows, rep = [], 1
        used: dict[str, int] = dict.fromkeys(left["sample"], 0)
        reps: list[list[tuple[str, int, int]]] = []
        while pool and len(reps) < max_reps:
            now, have = [], 0
            while pool and have < min_cells:
                name, n = pool[0]
                take = min(n, min_cells - have) if now else min(n, min_cells)
                now.append((name, used[name], take))
                used[name] += take
                have += take
                pool.pop(0)
            reps.append(now)
        spare = {s: int(n) - used[s] for s, n in zip(left["sample"], left["n"], strict=True)}
        if reps and (short := min_cells - sum(t for _, _, t in reps[-1])) > 0:
            for s, n in spare.items():  # the last one is topped up from cells not used yet
                take = min(n, short)
                if take:
                    reps[-1].append((s, used[s], take))
                    used[s] += take
                    short -= take
            if short > 0:
                reps.pop()
        for now in reps:
            rows += [(pdf["group"].iloc[0], rep, s, a, a + t) for s, a, t in now]
            rep += 1
        return pd.DataFrame(rows, columns=["group", "rep", "sample", "lo", "hi"])

    return plan


def select_cells(
    cells: DataFrame, group: str = "cluster", sample: str = "sample", min_cells: int = 40, max_cells: int = 500, min_reps: int = 2, max_reps: int = 5, ratio: float = 0.8, seed: int = 1,
) -> DataFrame:
    """(group, rep, cell_id); a cell may be in several replicates of its group in tier 5."""
    base = cells.select("cell_id", F.col(group).alias("group"), F.col(sample).alias("sample"))
    tier = tiers(cells, group, sample, min_cells, min_reps, ratio)
    drawn = F.md5(F.concat_ws("/", "cell_id", F.lit(seed)))
    at = base.join(F.broadcast(tier), "group").withColumns({
        "rs": F.row_number().over(W.partitionBy("group", "sample").orderBy(drawn, "cell_id")),
        "rg": F.row_number().over(W.partitionBy("group").orderBy(drawn, "cell_id")),
    })
    # tier 1: the largest samples are the replicates
    big = group_sample_counts(cells, group, sample).where(F.col("n") >= min_cells).withColumn("rep", F.row_number().over(W.partitionBy("group").orderBy(F.col("n").desc(), "sample"))).where(F.col("rep") <= max_reps)
    one = at.where("tier = 1").join(F.broadcast(big.drop("n")), ["group", "sample"]).where(F.col("rs") <= max_cells)
    # tier 2: a plan over counts, one row per sample
    plan = group_sample_counts(cells, group, sample).join(tier.where("tier = 2").select("group"), "group", "left_semi").groupBy("group").applyInPandas(
        _packed(min_cells, min_reps, max_reps), "group string, rep int, sample string, lo int, hi int")
    two = at.where("tier = 2").join(F.broadcast(plan), ["group", "sample"]).where((F.col("rs") > F.col("lo")) & (F.col("rs") <= F.col("hi")))
    # tier 3: one random order, cut into replicates; a leftover of min_cells or more makes one more
    size3 = F.least(F.lit(max_cells), F.greatest(F.lit(min_cells), F.floor(F.col("total") / min_reps))).cast("int")
    three = at.where("tier = 3").withColumn("rep", (F.floor((F.col("rg") - 1) / size3) + 1).cast("int")).where(F.col("rep") <= max_reps)
    three = three.where((F.col("rep") * size3 <= F.col("total")) | (F.col("total") - (F.col("rep") - 1) * size3 >= min_cells))
    # tier 4: disjoint parts, each topped up from the shared remainder
    part = int(min_cells * ratio)
    in_part = F.col("rg") <= part * min_reps
    four = at.where("tier = 4").withColumn("rep", F.explode(F.when(in_part, F.array((F.floor((F.col("rg") - 1) / part) + 1).cast("int"))).otherwise(F.sequence(F.lit(1), F.lit(min_reps)))))
    four = four.where(in_part | (F.col("rg") <= part * min_reps + (min_cells - part)))
    # tier 5: an order of its own for each replicate
    five = at.where("tier = 5").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(min_reps))))
    five = five.withColumn("_r", F.row_number().over(W.partitionBy("group", "rep").orderBy(F.md5(F.concat_ws("/", "cell_id", "rep", F.lit(seed))), "cell_id"))).where(F.col("_r") <= min_cells)
    cols = ["group", "rep", "cell_id"]
    out = one.select(cols)
    for part_ in (two, three, four, five):
        out = out.unionByName(part_.select(cols))
    return out


def pseudobulk_counts(counts: DataFrame, selected: DataFrame) -> DataFrame:
    """(feature_id, replicate, value) with replicate ids like ``C1_pseudobulk_rep1``."""
    rep = F.concat(F.col("group"), F.lit("_pseudobulk_rep"), F.col("rep"))
    return counts.join(selected.select("cell_id", rep.alias("replicate")), "cell_id").groupBy("feature_id", "replicate").agg(F.sum("value").alias("value"))


def replicate_table(selected: DataFrame) -> DataFrame:
    """(replicate, group, rep, num_cells)."""
    rep = F.concat(F.col("group"), F.lit("_pseudobulk_rep"), F.col("rep"))
    return selected.groupBy(rep.alias("replicate"), "group", "rep").agg(F.count(F.lit(1)).alias("num_cells"))


def membership_columns(cells: DataFrame, selected: DataFrame, max_reps: int = 5) -> DataFrame:
    """Cells with boolean columns ``pseudobulk_rep1`` … ``max_reps``."""
    flags = selected.groupBy("cell_id").agg(*[F.max(F.col("rep") == j).alias(f"pseudobulk_rep{j}") for j in range(1, max_reps + 1)])
    return cells.join(flags, "cell_id", "left").na.fill(False, [f"pseudobulk_rep{j}" for j in range(1, max_reps + 1)])
