"""Sweeps over bins equal what a pass over the whole sequence finds."""

import random

import pytest
from pyspark.sql import functions as F

from chromalake.operators import integrate, intervals as iv, peaks
from chromalake.operators.sweep import BIN, in_bins, numbered


@pytest.mark.parametrize("seed", range(3))
def test_nearest_by_brute_force(spark, seed):
    rng = random.Random(seed)
    ranges = lambda n, p: [(f"{p}{i}", rng.choice("ab"), s := rng.randrange(1, 9 * BIN), s + rng.choice([0, 5, 900, 3 * BIN])) for i in range(n)]
    q, s = ranges(60, "q"), ranges(12, "s")
    q.append(("alone", "c", 5, 9))
    cols = "string, seqname string, start long, end long"
    got = iv.nearest(spark.createDataFrame(q, f"k {cols}"), spark.createDataFrame(s, f"name {cols}"), "k", "name").collect()
    assert len(got) == len(q)
    for r in got:
        _, chrom, a, b = next(x for x in q if x[0] == r["k"])
        gaps = {n: max(0, a - e - 1, f - b - 1) for n, c, f, e in s if c == chrom}
        assert r["distance"] == min(gaps.values(), default=None)
        assert r["name"] is None if not gaps else gaps[r["name"]] == r["distance"]


def test_values_are_carried_over_empty_bins_and_null_keys(spark):
    rows = [("a", 1, 5), ("a", 10 * BIN, 7), ("a", 10 * BIN + 1, 1), (None, 3, 2), (None, 5 * BIN, 4)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    out = {(r["k"], r["pos"]): (r["s"], r["m"]) for r in in_bins(df, ["k"], F.col("pos"), {"s": (F.sum, F.col("v"))}, {"m": (F.min, F.col("v"))}).collect()}
    assert out == {("a", 1): (None, 1), ("a", 10 * BIN): (5, None), ("a", 10 * BIN + 1): (5, None), (None, 3): (None, 4), (None, 5 * BIN): (2, None)}
    assert in_bins(df.limit(0), ["k"], F.col("pos"), {"s": (F.sum, F.col("v"))}).count() == 0


def test_depth_and_regions_cross_bins(spark):
    edge = 3 * BIN
    cuts = spark.createDataFrame([("g", "a", edge + d) for d in (-60, -10, 0, 60)] + [("g", "a", edge + 5 * BIN)], "group string, seqname string, start long")
    depth = [0] * (9 * BIN)
    for r in cuts.collect():
        for i in range(r["start"] - 75, r["start"] + 75):
            depth[i] += 1
    seen = [0] * len(depth)
    for r in peaks.pileup(cuts).collect():
        seen[r["start"] : r["end"]] = [r["depth"]] * (r["end"] - r["start"])
    assert seen == depth
    got = peaks.call_peaks(cuts, 1e7, 0.5, use_q=False).collect()
    assert sorted(r["start"] // BIN for r in got) in ([2, 8], [3, 8])


def test_overlaps_in_chains_across_bins(spark):
    step = BIN // 3
    rows = [("a", i * step, i * step + step + 10, float(i % 4)) for i in range(40)] + [("b", 1, 5, 1.0), ("b", 1, 5, 2.0)]
    got = [tuple(r) for r in peaks.remove_overlaps(spark.createDataFrame(rows, "seqname string, start long, end long, score double"), "score", ["seqname"]).collect()]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        if not any(k[0] == r[0] and k[1] <= r[2] and r[1] <= k[2] for k in kept):
            kept.append(r)
    assert sorted(got) == sorted(kept)


def test_one_replicate_keeps_its_peaks_without_a_reproducibility(spark):
    s = spark.createDataFrame([("r1", "a", 1000, 1000, 2.0), ("r1", "a", 9000, 9000, 1.0)], "replicate string, seqname string, start long, end long, score double")
    got = peaks.reproducible_peaks(s).collect()
    assert len(got) == 2 and all(r["reproducibility"] is None and r["reproducibility_percent"] is None for r in got)


def test_numbers_have_no_gap_and_blocks_are_even(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("cell_id"))
    assert sorted(r["n"] for r in numbered(df, "cell_id", "n", buckets=7).collect()) == list(range(1003))
    sizes = [r["count"] for r in integrate.blocks(df, 100).groupBy("block").count().collect()]
    assert len(sizes) == 11 and max(sizes) <= 100 and max(sizes) - min(sizes) <= 1
