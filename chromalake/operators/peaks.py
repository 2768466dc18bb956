"""Peak calling on cut sites, and reproducible peaks across replicates and groups."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from chromalake.functions import genomic as g
from chromalake.functions.stats import poisson_log10_tail, rank_quantile
from chromalake.operators import intervals as iv
from chromalake.operators.sweep import bin_window, in_bins
from chromalake.runtime import materialize


#: Peaks of runs a task picks from at once.
MANY = 50_000


def pileup(cuts: DataFrame, shift: int = -75, extend: int = 150) -> DataFrame:
    """(group, seqname, start, end, depth): runs of equal depth, 0-based half-open.

    ``cuts``: (group, seqname, start).  Every cut covers [start + shift, start + shift + extend).
    """
    s = F.greatest(F.lit(0).cast("long"), F.col("start") + shift)
    steps = cuts.select("group", "seqname", F.explode(F.array(F.struct(s.alias("pos"), F.lit(1).alias("d")), F.struct((F.col("start") + shift + extend).alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy("group", "seqname", F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d")).where("d <> 0")
    key = ["group", "seqname"]
    steps = in_bins(steps, key, F.col("pos"), {"_below": (F.sum, F.col("d"))}, {"_next": (F.min, F.col("pos"))})
    over = bin_window(key, "pos")
    depth = F.coalesce("_below", F.lit(0)) + F.sum("d").over(over)
    runs = steps.select(*key, F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(over), "_next").alias("end"), depth.alias("depth"))
    return runs.where("depth > 0 and end is not null")


def _chained(df: DataFrame, key: list[str], out: str) -> DataFrame:
    """Numbers chains along a sequence: each row gets the start of the last row that is ``_new``."""
    first = F.when(F.col("_new"), F.col("start"))
    df = in_bins(df, key, F.col("start"), {"_chain": (F.max, first)})
    here = F.max(first).over(bin_window(key, "start"))
    return df.withColumn(out, F.coalesce(here, F.col("_chain"))).drop("_new", "_chain", "_bin")


def call_peaks(cuts: DataFrame, genome_size: float, cutoff: float = 0.1, use_q: bool = True, shift: int = -75, extend: int = 150, min_length: int | None = None, max_gap: int = 50) -> DataFrame:
    """Summits (group, seqname, start, end, score): local maxima of runs above the cutoff.

    The background is one rate per group, cuts * extend / genome size; p-values are Poisson
    upper tails, and q-values adjust over bases by Benjamini-Hochberg.
    """
    spark = cuts.sparkSession
    runs = materialize(spark, pileup(cuts, shift, extend), "pileup")
    rate = cuts.groupBy("group").agg((F.count(F.lit(1)) * F.lit(float(extend)) / F.lit(float(genome_size))).alias("rate"))
    # one row per group and depth
    hist = runs.groupBy("group", "depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases")).join(rate, "group")
    hist = hist.withColumn("p", poisson_log10_tail(F.col("depth").cast("double"), F.col("rate")))
    down = W.partitionBy("group").orderBy(F.col("p").desc()).rowsBetween(W.unboundedPreceding, 0)
    rank = F.sum("bases").over(down)
    total = F.lit(float(genome_size))
    raw = F.col("p") + F.log10(rank) - F.log10(total)
    # walking down from the best p, a q-value is never better than a better-ranked one
    hist = hist.withColumn("_q", raw).withColumn("q", F.greatest(F.lit(0.0), F.min("_q").over(down)))
    level = "q" if use_q else "p"
    above = runs.join(hist.select("group", "depth", "p", "q"), ["group", "depth"]).where(F.col(level) >= -F.log10(F.lit(cutoff)))
    above = materialize(spark, above, "peaks-above")
    key = ["group", "seqname"]
    # runs do not overlap, so the largest end before a run is that of the run before it
    above = in_bins(above, key, F.col("start"), {"_reach": (F.max, F.col("end"))})
    last = F.coalesce(F.lag("end").over(bin_window(key, "start")), "_reach")
    above = _chained(above.withColumn("_new", last.isNull() | (F.col("start") - last > max_gap)).drop("_reach", "_bin"), key, "region")
    region = above.groupBy("group", "seqname", "region").agg(
        F.min("start").alias("s"), F.max("end").alias("e"), F.max(F.struct(F.col("depth"), -F.col("start"), F.col("end"), F.col("q"), F.col("p"))).alias("top"))
    region = region.where(F.col("e") - F.col("s") >= (extend if min_length is None else min_length))
    middle = F.floor((-F.col("top.col2") + F.col("top.end")) / 2)
    score = F.col(f"top.{level}")
    return region.select("group", "seqname", (middle + 1).alias("start"), (middle + 1).alias("end"), score.alias("score"))


def _greedy(pdf: pd.DataFrame, group: list[str]) -> pd.DataFrame:
    """In each group the best peak stays and removes what it overlaps, and so on."""
    pdf = pdf.sort_values(["rank_by", "start"], ascending=[False, True], kind="stable")
    kept: dict[int, tuple[list, list]] = {}
    keep = []
    for n, s, e in zip(pdf.groupby(group, dropna=False, sort=False).ngroup(), pdf["start"], pdf["end"], strict=True):
        starts, ends = kept.setdefault(n, ([], []))
        i = bisect.bisect_right(starts, e)
        clash = i > 0 and ends[i - 1] >= s
        keep.append(not clash)
        if not clash:
            starts.insert(bisect.bisect_left(starts, s), s)
            ends.insert(bisect.bisect_left(ends, e), e)
    return pdf[keep]


def remove_overlaps(peaks: DataFrame, by: str, key: list[str]) -> DataFrame:
    """Greedy selection by ``by``; a group is a connected run of overlapping peaks, not a sequence.

    A task takes all its runs at once: they are many and short, and a call for each costs more than its work.
    """
    spark = peaks.sparkSession
    # tables, as every sweep reads its input twice
    binned = in_bins(materialize(spark, peaks, "peaks"), key, F.col("start"), {"_reach": (F.max, F.col("end"))})
    here = F.max("end").over(bin_window(key, "start", "end").rowsBetween(W.unboundedPreceding, -1))
    reach = F.greatest(here, F.col("_reach"))
    binned = binned.withColumn("_new", reach.isNull() | (reach < F.col("start"))).drop("_reach", "_bin")
    runs = materialize(spark, _chained(binned, key, "_run").withColumn("rank_by", F.col(by)), "peak-runs")
    # most runs are single peaks and never leave the JVM
    size = runs.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*key, "_run")))
    single = size.where("_n = 1").drop("_n")
    many = size.where("_n > 1").drop("_n")
    group = [*key, "_run"]

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            yield _greedy(pd.concat(parts, ignore_index=True), group)

    rows = runs.count()
    tasks = max(-(-rows // MANY), min(spark.sparkContext.defaultParallelism, -(-rows // 1000)), 1)
    picked = many.repartition(tasks, *group).mapInPandas(pick, many.schema)
    return single.unionByName(picked).drop("_run", "rank_by")


def reproducible_peaks(summits: DataFrame, reproducibility: str = "2", extend: int = 250, by: str = "score", unit: str = "replicate", group: list[str] | None = None, out: str = "replicate_quantile", lengths: DataFrame | None = None, literal: bool = False) -> DataFrame:
    """Fixed-width peaks that enough units support.

    ``summits``: (unit, seqname, start, end, score, …) within ``group``.  Scores become rank
    quantiles per unit; overlaps are resolved greedily; ``reproducibility`` is a Spark SQL
    expression of ``n``, the number of units.  A single unit cannot be reproduced: its peaks stay
    and both reproducibility columns are null.  ``literal`` keeps overlapping and unsupported peaks.
    """
    group = group or []
    width = 2 * extend + 1
    wide = g.with_pair(summits, g.centered(F.col("start"), F.col("end"), width)).withColumn(out, rank_quantile(by, [*group, unit]))
    if lengths is not None:
        wide = g.with_pair(wide.join(F.broadcast(lengths), "seqname", "left"), g.trimmed(F.col("start"), F.col("end"), F.col("length"))).where(F.col("end") - F.col("start") + 1 == width).drop("length")
    wide = materialize(wide.sparkSession, wide, "peaks-wide")
    first = W.partitionBy(*group, "seqname", "start", "end").orderBy(F.col(out).desc(), unit)
    distinct = wide.withColumn("_f", F.row_number().over(first)).where("_f = 1").drop("_f")
    chosen = distinct if literal else remove_overlaps(distinct, out, [*group, "seqname"])
    key = F.concat_ws(":", *group, "seqname", "start", "end")
    chosen = materialize(wide.sparkSession, chosen.withColumn("peak", key), "peaks-chosen")
    space = F.concat_ws("/", *group, "seqname") if group else F.col("seqname")
    a = chosen.select("peak", space.alias("seqname"), "start", "end")
    b = wide.select(space.alias("seqname"), "start", "end", F.col(unit).alias("_u"))
    seen = iv.overlap_join(a, b).groupBy(F.col("l_peak").alias("peak")).agg(F.count_distinct("r__u").alias("reproducibility"))
    n = wide.groupBy(*group).agg(F.count_distinct(unit).alias("n")) if group else wide.agg(F.count_distinct(unit).alias("n"))
    joined = chosen.join(seen, "peak", "left").na.fill(0, ["reproducibility"])
    joined = joined.join(F.broadcast(n), group) if group else joined.withColumn("n", n.scalar())
    joined = joined.withColumn("reproducibility_percent", F.bround(F.col("reproducibility") / F.col("n"), 3))
    alone = F.col("n") == 1
    if not literal:
        joined = joined.where(alone | (F.col("reproducibility") >= F.expr(reproducibility)))
    joined = joined.withColumns({c: F.when(~alone, F.col(c)) for c in ("reproducibility", "reproducibility_percent")})
    return joined.drop("peak", "n")


def peak_set(summits: DataFrame, reproducibility: str = "2", extend: int = 250, lengths: DataFrame | None = None) -> DataFrame:
    """Two passes: replicates within a group by score, then groups by their quantile."""
    within = reproducible_peaks(summits, reproducibility, extend, "score", "replicate", ["group"], "replicate_quantile", lengths)
    tidy = within.withColumn("group_quantile", rank_quantile("replicate_quantile", ["group"]))
    best = remove_overlaps(tidy, "group_quantile", ["seqname"])
    number, name = g.natural_order(F.col("seqname"))
    return best.withColumn("feature_id", F.concat_ws("-", F.concat_ws(":", "seqname", "start"), "end")).orderBy(number, name, "start")
