"""URL filtering: rules by host and path, and a character language-model ratio.

Two smoothed variable-order Markov models of characters, one of accepted and one of
rejected URLs, give every URL the mean log-likelihood difference of its characters.
The models are learned from the URLs that the rules allow or block.  Contexts have 0 to
ORDER characters, as they are; a longer context is trusted as far as it was seen (Witten-Bell
interpolation: weight N / (N + T) with N sightings and T distinct successors) and an
unseen one passes to the next shorter one.  Every run of ORDER + 1 characters that occurs is a
row of a table, counted before it is shuffled, so the models grow with the input.  The
threshold is calibrated on seed URLs that the models were not learned from (one in four, by
their digest) as the score that maximises true-accept rate minus false-accept rate.

Runs that very many URLs hold are looked up in a broadcast table of at most HUBS rows (see
``components.hub_size``) without a shuffle; only the rest is joined by its run, so no key
meets many rows.  Differences are whole micro-nats, so sums do not depend on the order of rows.

Edge cases: a null URL or one without ``://`` has an empty host and path, hence no rule;
its score is that of its characters (a null URL has the end sign only); a URL of any length
is scored whole; of equal cuts the lowest is taken.  Without seed URLs of both kinds every
difference is 0, and without such among those for calibration the threshold is 0.
Repeated rows are all returned; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from chromalake.llm.components import hub_size
from chromalake.runtime import materialize, release

ORDER = 5
#: Signs before and after a URL, and the size of the alphabet (all code points).
BEFORE, AFTER, ALPHABET = "\x02", "\x03", 1_114_112
#: Seed URLs whose MD5 begins with one of these digits are for calibration only.
APART = "0123"
MICRO = 1_000_000
#: Scores are put in bins of this many micro-nats for calibration.
BIN = 10_000
#: Scores beyond this many bins share the outermost bins.
SPAN = 2_000

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null without one."""
    out = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        cut = rule.index("/")
        h, p = rule[:cut], rule[cut:]
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(url: Column) -> Column:
    """All overlapping runs of ORDER + 1 characters; one for each character and one for the end."""
    signs = F.split(F.concat(F.lit(BEFORE * ORDER), url, F.lit(AFTER)), "")
    run = lambda s, i: F.array_join(F.slice(s, i, F.lit(ORDER + 1)), "")
    # a variable of the outer function holds the split, which is then done once a URL
    return F.transform(F.array(signs), lambda s: F.transform(F.sequence(F.lit(1), F.size(s) - ORDER), lambda i: run(s, i)))[0]


def markov_differences(counts: DataFrame) -> DataFrame:
    """(gram, n, d): accepted minus rejected log probability of a run's last character.

    ``counts``: (gram, n, a, r), every run once with its number of rows, and how often
    accepted and rejected seeds hold it.
    """
    levels = {ORDER: counts.select(F.col("gram").alias(f"g{ORDER}"), "a", "r", "n")}
    for k in range(ORDER - 1, -1, -1):  # the run without its first characters
        levels[k] = levels[k + 1].groupBy(F.substring(f"g{k + 1}", 2, k + 1).alias(f"g{k}")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    prob = None
    for k in range(ORDER + 1):
        same = W.partitionBy(F.substring(f"g{k}", 1, k)) if k else W.partitionBy(F.lit(0))  # as many rows as characters follow a context
        t = levels[k]
        for x in "ar":
            t = t.withColumn(f"{x}N", F.sum(x).over(same)).withColumn(f"{x}T", F.sum((F.col(x) > 0).cast("long")).over(same))
        if prob is None:
            t = t.withColumns({"ap": F.lit(1.0 / ALPHABET), "rp": F.lit(1.0 / ALPHABET), "both": (F.col("aN") > 0) & (F.col("rN") > 0)})
        else:
            t = t.withColumn(f"g{k - 1}", F.substring(f"g{k}", 2, k)).join(prob, f"g{k - 1}")
        for x in "ar":
            n, d = F.col(f"{x}N"), F.col(f"{x}T")
            t = t.withColumn(f"{x}p", F.when(n > 0, (F.col(x) + d * F.col(f"{x}p")) / (n + d)).otherwise(F.col(f"{x}p")))
        prob = t.select(f"g{k}", "ap", "rp", "both", *(["n"] if k == ORDER else []))
    return prob.select(F.col(f"g{ORDER}").alias("gram"), "n", F.when(F.col("both"), F.round((F.log("ap") - F.log("rp")) * MICRO)).otherwise(0).cast("long").alias("d"))


def score_urls(spark, pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score long in micro-nats a character, threshold)."""
    u = F.col("_url")
    base = pages.select(F.col(page_id).alias("_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url")).withColumns(
        {"_h": host(u), "_p": path(u), "_k1": F.xxhash64(u), "_k2": F.xxhash64(u, F.lit(1))})
    base = base.withColumns({"_m": match_rule(F.col("_h"), F.col("_p"), rules), "_apart": F.substring(F.md5(u.cast("binary")), 1, 1).isin(*APART)})
    learned = lambda verdict: F.sum(F.coalesce((F.col("_m.verdict") == verdict) & ~F.col("_apart"), F.lit(False)).cast("long"))
    counts = base.select("_m", "_apart", F.explode(grams(u)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), learned("allow").alias("a"), learned("block").alias("r"))
    counts = materialize(spark, counts, "url-grams")
    model = materialize(spark, markov_differences(counts), "url-model")
    total = model.agg(F.sum("n")).first()[0] or 0
    common = model.where(F.col("n") > hub_size(total)).select("gram", "d")
    rows = base.select("_k1", "_k2", F.explode(grams(u)).alias("gram")).join(F.broadcast(common), "gram", "left")
    sums = [F.sum("d").alias("d"), F.count(F.lit(1)).alias("c")]
    rest = rows.where("d is null").drop("d").join(model.where(F.col("n") <= hub_size(total)).select("gram", "d"), "gram")
    by_url = rows.where("d is not null").groupBy("_k1", "_k2").agg(*sums).unionByName(rest.groupBy("_k1", "_k2").agg(*sums)).groupBy("_k1", "_k2").agg(F.sum("d").alias("d"), F.sum("c").alias("c"))
    # the mean over equal URLs is that of one
    scores = materialize(spark, by_url.select("_k1", "_k2", F.floor(F.col("d") / F.col("c")).cast("long").alias("_score")), "url-scores")
    release(spark, counts, model)
    out = base.join(scores, ["_k1", "_k2"])
    threshold = calibrate(base.where("_m is not null and _apart").join(scores, ["_k1", "_k2"])).scalar()
    out = out.withColumn("threshold", threshold)
    verdict = F.coalesce(F.col("_m.verdict"), F.when(F.col("_score") >= F.col("threshold"), "allow").otherwise("block"))
    return out.select(F.col("_id").alias(page_id), F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_m.rule").alias("rule"), verdict.alias("verdict"), F.col("_score").alias("score"), "threshold")


def calibrate(scored: DataFrame) -> DataFrame:
    """One row: the cut that best parts allowed from blocked rows, midway between their bins.

    At most 2 x SPAN + 1 bins; ties go to the lowest cut.
    """
    bin_ = F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.floor(F.col("_score") / BIN))).cast("int")
    hist = scored.groupBy(bin_.alias("bin")).agg(
        F.sum((F.col("_m.verdict") == "allow").cast("long")).alias("a"), F.sum((F.col("_m.verdict") == "block").cast("long")).alias("r"))
    up = W.partitionBy(F.lit(0)).orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(F.lit(0))
    below = F.coalesce(F.lead("bin").over(W.partitionBy(F.lit(0)).orderBy(F.col("bin").desc())), F.col("bin") - 1)
    ranked = hist.select("bin", below.alias("below"), F.sum("a").over(up).alias("ta"), F.sum("r").over(up).alias("tr"), F.sum("a").over(every).alias("na"), F.sum("r").over(every).alias("nr"))
    gain = F.col("ta") * F.col("nr") - F.col("tr") * F.col("na")
    # without both kinds of seeds max_by sees no rows and the threshold is 0
    best = ranked.where((F.col("na") > 0) & (F.col("nr") > 0)).agg(F.max(F.struct(gain.alias("g"), (-F.col("bin")).alias("b"), "below")).alias("m"))
    cut = (F.col("m.below").cast("long") - F.col("m.b") + 1) * (BIN // 2)
    return best.select(F.coalesce(cut, F.lit(0)).cast("long").alias("threshold"))


def op2_url_language_model(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return score_urls(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
