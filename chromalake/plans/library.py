"""Queries over the driver's tables, one or more for each operator, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from chromalake.functions import genomic as g, stats as st
from chromalake.operators import cluster as cl, counting as ct, doublets as db, integrate as ig, intervals as iv, knn, lsi, markers as mk, matrix as mx, peaks as pk, pseudobulk as pb, qc, scores as sc
from chromalake.plans.fixtures import CELLS, COUNTS, FRAGMENTS, GENES, SPAN, cells, counts, embeddings, fragments, genes, table
from chromalake.runtime import ship_package
from chromalake.sources import fragments as fs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark, d):
            ship_package(spark)
            return f(spark, d)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# --- scans and sinks -------------------------------------------------------------------


@query(f"""WITH f AS (SELECT "end" - "start" AS size FROM {FRAGMENTS} WHERE "end" - "start" BETWEEN 1 AND 5500)
SELECT s.size, coalesce(n, 0)::BIGINT n, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM f), 6) percent
FROM (SELECT unnest(range(1, 5501)) size) s LEFT JOIN (SELECT size, count(*) n FROM f GROUP BY 1) USING (size)""")
def fragment_size_distribution(spark, d):
    return ct.fragment_sizes(fragments(spark, d)).select("size", "n", r6(F.col("percent"), "percent"))


@query(f"SELECT count(*)::BIGINT n, max(\"end\" - \"start\")::BIGINT largest FROM {FRAGMENTS} WHERE \"end\" - \"start\" > 300")
def fragment_oversize(spark, d):
    return ct.oversize(fragments(spark, d), 300).select("n", "largest")


@query(f'SELECT chrom, "start", "end", barcode FROM {FRAGMENTS}')
def fragment_parse(spark, d):
    """Lines of text, parsed as the file reader parses them."""
    f = fragments(spark, d)
    lines = f.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "barcode", F.lit("1")).alias("line"))
    return lines.select(*[c.alias(k) for k, c in fs.parse_line(F.col("line")).items()]).where("problem is null").drop("problem")


@query(f"""SELECT seqname, tile, cell_id, count(*)::BIGINT AS value FROM (
  SELECT chrom AS seqname, cell_id, unnest(list_distinct(["start" // 500, ("end" - 1) // 500])) AS tile FROM {FRAGMENTS}) GROUP BY ALL""")
def tile_counts(spark, d):
    return ct.tile_counts(fragments(spark, d))


@query(f"""WITH ends AS (SELECT event_id, chrom, cell_id, unnest([("start" + 1), "end"]) AS pos FROM {FRAGMENTS})
SELECT name AS feature_id, cell_id, count(*)::BIGINT AS value FROM (SELECT DISTINCT name, cell_id, event_id, g."start", g."end" FROM ends JOIN {GENES} g ON chrom = seqname AND pos BETWEEN g."start" AND g."end") GROUP BY ALL""")
def region_counts(spark, d):
    return ct.region_counts(fragments(spark, d), genes(spark, d).withColumnRenamed("name", "feature_id"))


@query(f"SELECT cell_id, sample, count(*)::BIGINT fragments FROM {FRAGMENTS} GROUP BY ALL")
def cell_depths(spark, d):
    return ct.cell_depths(fragments(spark, d))


@query(f"""WITH c AS (SELECT cell_id, sample, count(*) n FROM {FRAGMENTS} GROUP BY ALL)
SELECT CASE WHEN f.sample IN ('S0', 'S1') THEN 'A' ELSE 'B' END AS "group", (length(f.barcode) % 2 + 1)::INT AS rep, chrom, "start", "end", barcode
FROM {FRAGMENTS} f JOIN c USING (cell_id) WHERE c.n >= 60""")
def pseudobulk_coverage(spark, d):
    f = fragments(spark, d)
    deep = ct.cell_depths(f).where("fragments >= 60")
    bar = g.cell_barcode(F.col("cell_id"))
    sel = deep.select(F.when(F.col("sample").isin("S0", "S1"), "A").otherwise("B").alias("group"), (F.length(bar) % 2 + 1).cast("int").alias("rep"), "sample", bar.alias("barcode"))
    return fs.coverage_rows(f, sel)


@query(COUNTS[1:-1])
def run_length_counts(spark, d):
    return fs.run_length_counts(table(spark, d, "lineitem").select(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").cast("string").alias("cell_id")))


@query(f"""SELECT seqname, tile, tile * 500 + 1 AS "start", least((tile + 1) * 500, length)::BIGINT AS "end" FROM (
  SELECT chrom seqname, max("end") length, unnest(range(0, (max("end") - 1) // 500 + 1)) tile FROM {FRAGMENTS} GROUP BY 1)""")
def tile_ranges(spark, d):
    return ct.tile_ranges(fragments(spark, d).groupBy(F.col("chrom").alias("seqname")).agg(F.max("end").alias("length")))


# --- projections, filters, joins by key ------------------------------------------------


@query(f"SELECT feature_id, cell_id, value FROM {COUNTS} WHERE feature_id IN (SELECT p_partkey FROM part WHERE p_size >= 25)")
def feature_subset(spark, d):
    return mx.subset(counts(spark, d), table(spark, d, "part").where("p_size >= 25").select(F.col("p_partkey").alias("feature_id")))


@query(f"SELECT feature_id, cell_id, 1.0::DOUBLE AS value FROM {COUNTS} WHERE value <> 0")
def binarize(spark, d):
    return mx.binarize(counts(spark, d))


@query(f"SELECT feature_id, cell_id, round(value / s, 6) AS value FROM {COUNTS} JOIN (SELECT cell_id, sum(value) s FROM {COUNTS} GROUP BY 1) USING (cell_id)")
def broadcast_arithmetic(spark, d):
    c = counts(spark, d)
    return mx.broadcast_arithmetic(c, mx.col_sums(c), "cell_id", "col_sum", "/").select("feature_id", "cell_id", r6(F.col("value"), "value"))


@query(f"SELECT feature_id, cell_id, value FROM {COUNTS} WHERE value >= 2")
def threshold_compare(spark, d):
    return mx.at_least(counts(spark, d), 2)


@query(f"SELECT cell_id, sample, fragments FROM {CELLS} WHERE fragments >= 550 AND balance >= 1000")
def quality_cells(spark, d):
    return qc.quality_cells(cells(spark, d).withColumn("tss_enrichment", F.col("balance")), 1000, 550).select("cell_id", "sample", "fragments")


@query(f"""SELECT cell_id, sample FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY balance DESC, cell_id) r, count(*) OVER (PARTITION BY sample) n FROM {CELLS})
WHERE NOT (balance >= 1 AND r <= floor(n * n * 0.01))""")
def doublet_filter(spark, d):
    return db.filter_doublets(cells(spark, d).withColumn("doublet_enrichment", F.col("balance")), 1.0, 0.01).select("cell_id", "sample")


@query(f"SELECT feature_id, cell_id, value FROM (SELECT feature_id, cell_id, value - 1 AS value FROM {COUNTS}) WHERE feature_id IN (SELECT feature_id FROM {COUNTS} GROUP BY 1 HAVING sum(value - 1) > 0)")
def drop_zero_features(spark, d):
    return mx.drop_zero(counts(spark, d).withColumn("value", F.col("value") - 1), "feature_id")


@query(f"SELECT name, seqname FROM {GENES} WHERE seqname IN (SELECT event_type FROM events WHERE event_type < 'purchase')")
def prune_seqnames(spark, d):
    other = table(spark, d, "events").where("event_type < 'purchase'").select(F.col("event_type").alias("seqname"))
    return iv.prune_seqnames(genes(spark, d), other).select("name", "seqname")


@query("""SELECT cell_id, i::INT AS dim, round(v::DOUBLE, 6) AS value FROM (SELECT vec_id AS cell_id, unnest(list_concat(embedding[1:8], [embedding[3], embedding[1]])) v, generate_subscripts(list_concat(embedding[1:8], [embedding[3], embedding[1]]), 1) i FROM embeddings)""")
def concat_embeddings(spark, d):
    e = embeddings(spark, d)
    both = mx.concat_embeddings({"a": e, "b": e}, {"a": list(range(1, 9)), "b": [3, 1]})
    return both.select("cell_id", F.posexplode("embedding").alias("dim", "v")).select("cell_id", (F.col("dim") + 1).alias("dim"), r6(F.col("v"), "value"))


@query(f"SELECT DISTINCT cell_id, barcode, sample FROM {FRAGMENTS}")
def cell_keys(spark, d):
    f = fragments(spark, d).select(g.cell_id(F.col("sample"), F.col("barcode")).alias("cell_id")).distinct()
    return f.select("cell_id", g.cell_barcode(F.col("cell_id")).alias("barcode"), g.cell_sample(F.col("cell_id")).alias("sample"))


@query(f"""SELECT name, seqname, "start", "end" FROM {GENES}""")
def interval_strings(spark, d):
    text = F.concat(F.col("seqname"), F.lit(":"), "start", F.lit("-"), "end")
    q, s, e = g.parse_interval(F.col("interval"))
    return genes(spark, d).select("name", text.alias("interval")).select("name", q.alias("seqname"), s.alias("start"), e.alias("end"))


# --- intervals ---------------------------------------------------------------------------


@query(f"""SELECT g.name, f.cell_id, greatest(g."start", f."start") AS s, least(g."end", f."end") AS e FROM {GENES} g JOIN {FRAGMENTS} f ON g.seqname = f.chrom AND g."start" <= f."end" AND f."start" <= g."end" """)
def overlap_join(spark, d):
    f = fragments(spark, d).select(F.col("chrom").alias("seqname"), "start", "end", g.cell_id(F.col("sample"), F.col("barcode")).alias("cell_id"))
    p = iv.overlap_join(genes(spark, d), f)
    return p.select(F.col("l_name").alias("name"), F.col("r_cell_id").alias("cell_id"), F.greatest("l_start", "r_start").alias("s"), F.least("l_end", "r_end").alias("e"))


@query(f"""SELECT a.name AS l_name, b.name AS r_name FROM {GENES} a JOIN {GENES} b ON a.seqname = b.seqname AND a."start" - 400 <= b."end" + 400 AND b."start" - 400 <= a."end" + 400 AND a.strand = b.strand AND a.name < b.name""")
def self_overlap_stranded(spark, d):
    s, e = g.widened(F.col("start"), F.col("end"), 400)
    return iv.self_overlaps(genes(spark, d).withColumns({"start": s, "end": e}), "name", ignore_strand=False)


@query(f"""SELECT name, EXISTS (SELECT 1 FROM {FRAGMENTS} f WHERE f.chrom = g.seqname AND f."start" <= g."end" AND g."start" <= f."end") AS hit FROM {GENES} g""")
def overlaps_any(spark, d):
    f = fragments(spark, d).select(F.col("chrom").alias("seqname"), "start", "end")
    return iv.overlaps_any(genes(spark, d), f, "name", "hit").select("name", "hit")


_POINTS = f"""(SELECT seqname, pos, min(name) AS label FROM (SELECT seqname, name, CASE WHEN strand = '-' THEN "end" ELSE "start" END pos FROM {GENES}) GROUP BY 1, 2)"""


@query(f"""WITH q AS (SELECT event_id, chrom AS seqname, "start" AS s, "end" AS e FROM {FRAGMENTS}), p AS {_POINTS},
l AS (SELECT q.*, p.pos lp, p.label ll FROM q ASOF LEFT JOIN p ON q.seqname = p.seqname AND q.e >= p.pos),
b AS (SELECT l.*, p.pos rp, p.label rl, CASE WHEN lp IS NOT NULL THEN greatest(0, s - lp - 1) END ld, CASE WHEN p.pos IS NOT NULL THEN greatest(0, p.pos - e - 1) END rd FROM l ASOF LEFT JOIN p ON l.seqname = p.seqname AND l.e < p.pos)
SELECT event_id, CASE WHEN lp IS NULL THEN rl WHEN rp IS NULL OR ld < rd OR (ld = rd AND ll <= rl) THEN ll ELSE rl END AS name,
  least(ld, rd)::BIGINT AS distance FROM b""")
def nearest_gene(spark, d):
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))").cast("long")
    q = table(spark, d, "events").select("event_id", F.col("event_type").alias("seqname"), start.alias("start"), (start + F.floor("value").cast("long") + 1).alias("end"))
    pts = genes(spark, d).select("seqname", g.tss(F.col("start"), F.col("end"), F.col("strand")).alias("start"), "name")
    return iv.nearest_points(q, pts, "event_id", "name")


@query(f"""SELECT name, CASE WHEN strand = '-' THEN "end" ELSE "start" END AS tss,
  "start" + floor(("end" - "start" + 1 - 101) / 2)::BIGINT AS c_start, "start" + floor(("end" - "start" + 1 - 101) / 2)::BIGINT + 100 AS c_end,
  greatest(1, "start" - 5000) AS t_start, least("end" + 5000, {SPAN}) AS t_end,
  "end" + 1901 AS fr_start, "end" + 2000 AS fr_end, "start" - 2000 AS fl_start, "start" - 1901 AS fl_end,
  CASE WHEN strand = '-' THEN "start" ELSE "start" - 5000 END AS x_start, CASE WHEN strand = '-' THEN "end" + 5000 ELSE "end" END AS x_end,
  "start" - 700 AS w_start, "end" + 700 AS w_end,
  CASE WHEN strand = '-' THEN "end" - 99 ELSE "start" - 2000 END AS p_start, CASE WHEN strand = '-' THEN "end" + 2000 ELSE "start" + 99 END AS p_end FROM {GENES}""")
def interval_functions(spark, d):
    s, e, k = F.col("start"), F.col("end"), F.col("strand")
    c, t, (fr, fl) = g.centered(s, e, 101), g.trimmed(s - 5000, e + 5000, F.lit(SPAN)), g.flanks(s, e, 2000, 100)
    x, w, p = g.extended(s, e, k, 5000, 0), g.widened(s, e, 700), g.promoter(s, e, k)
    pairs = {"c": c, "t": t, "fr": fr, "fl": fl, "x": x, "w": w, "p": p}
    return genes(spark, d).select("name", g.tss(s, e, k).alias("tss"), *[v.cast("long").alias(f"{n}_{side}") for n, pair in pairs.items() for side, v in zip(("start", "end"), pair, strict=True)])


# --- sums, ranks, quantiles ----------------------------------------------------------------


@query(f"SELECT feature_id, sum(value)::BIGINT AS row_sum FROM {COUNTS} GROUP BY 1")
def row_sums(spark, d):
    return mx.row_sums(counts(spark, d))


@query(f"SELECT cell_id, sum(value)::BIGINT AS col_sum FROM {COUNTS} GROUP BY 1")
def col_sums(spark, d):
    return mx.col_sums(counts(spark, d))


@query(f"SELECT feature_id, round((sum(value * value) - sum(value) * sum(value) / n) / (n - 1), 6) AS variance FROM {COUNTS}, (SELECT count(*)::DOUBLE n FROM supplier) GROUP BY feature_id, n")
def row_variance(spark, d):
    return mx.row_variance(counts(spark, d), table(spark, d, "supplier").count()).select("feature_id", r6(F.col("variance"), "variance"))


_GROUPED = f"(SELECT feature_id, cluster, sum(value)::BIGINT AS value FROM {COUNTS} JOIN {CELLS} USING (cell_id) GROUP BY ALL)"


@query(f"SELECT * FROM {_GROUPED}")
def group_sums(spark, d):
    return mx.group_sums(counts(spark, d), cells(spark, d))


@query(f"SELECT feature_id, cluster, round(log2(value / t * 10000 + 1), 6) AS value FROM {_GROUPED} JOIN (SELECT cluster, sum(value)::DOUBLE t FROM {_GROUPED} GROUP BY 1) USING (cluster)")
def log_normalize(spark, d):
    return mx.log_normalize(mx.group_sums(counts(spark, d), cells(spark, d))).select("feature_id", "cluster", r6(F.col("value"), "value"))


@query(f"SELECT cluster, sample, n, round(n / sum(n) OVER (PARTITION BY cluster), 6) AS fraction FROM (SELECT CASE WHEN fragments >= 600 THEN 'deep' ELSE 'flat' END AS cluster, sample, count(*)::BIGINT AS n FROM {CELLS} GROUP BY ALL)")
def cluster_confusion(spark, d):
    c = cells(spark, d).withColumn("cluster", F.when(F.col("fragments") >= 600, "deep").otherwise("flat"))
    return qc.cluster_confusion(c).select("cluster", "sample", "n", r6(F.col("fraction"), "fraction"))


@query(f"SELECT sample, count(*)::BIGINT AS n FROM {CELLS} GROUP BY 1 ORDER BY n DESC, sample")
def group_counts(spark, d):
    return cells(spark, d).groupBy("sample").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "sample")


@query(f"SELECT sample, round(quantile_cont(balance, 0.01), 6) q0, round(quantile_cont(balance, 0.5), 6) q1, round(quantile_cont(balance, 0.99), 6) q2 FROM {CELLS} GROUP BY 1")
def quantiles(spark, d):
    q = mx.quantiles(cells(spark, d), "balance", [0.01, 0.5, 0.99], ["sample"])
    return q.select("sample", *[r6(F.col(c), c) for c in ("q0", "q1", "q2")])


@query(f"SELECT sample, round(median(balance), 6) AS median FROM {CELLS} GROUP BY 1")
def medians(spark, d):
    return cells(spark, d).groupBy("sample").agg(r6(F.median("balance"), "median"))


@query(f"""SELECT seqname, "start" // 5000 * 5000 + 1 AS "start", "start" // 5000 * 5000 + 5000 AS "end", min(name) AS name FROM {GENES} GROUP BY ALL""")
def distinct_ranges(spark, d):
    s = F.floor(F.col("start") / 5000) * 5000
    return iv.distinct_ranges(genes(spark, d).withColumns({"start": s + 1, "end": s + 5000}), "name").select("seqname", "start", "end", "name")


@query(f"SELECT cell_id, i AS threshold, count(*)::BIGINT AS n FROM (SELECT cell_id, unnest(range(1, value + 1)) AS i FROM {COUNTS}) GROUP BY ALL")
def threshold_profile(spark, d):
    return mx.threshold_profile(counts(spark, d))


@query("SELECT cluster, dim, round(avg(v), 6) AS value FROM (SELECT label AS cluster, (generate_subscripts(embedding, 1) - 1)::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL")
def centroids(spark, d):
    e = embeddings(spark, d)
    return mx.centroids(e.select("cell_id", "embedding"), e).select("cluster", "dim", r6(F.col("value"), "value"))


@query(f"SELECT feature_id, row_sum, rank FROM (SELECT feature_id, sum(value)::BIGINT AS row_sum, row_number() OVER (ORDER BY sum(value) DESC, feature_id)::INT AS rank FROM {COUNTS} GROUP BY 1) WHERE rank BETWEEN 11 AND 110")
def top_features(spark, d):
    return mx.top_features(mx.row_sums(counts(spark, d)), "row_sum", 100, 10)


@query(f"""WITH s AS (SELECT feature_id, cluster, log2(value / t * 10000 + 1) AS v FROM {_GROUPED} JOIN (SELECT cluster, sum(value)::DOUBLE t FROM {_GROUPED} GROUP BY 1) USING (cluster)),
k AS (SELECT count(DISTINCT cluster)::DOUBLE k FROM {CELLS}),
v AS (SELECT feature_id, round((sum(v * v) - sum(v) * sum(v) / k) / (k - 1), 6) AS variance FROM s, k GROUP BY feature_id, k)
SELECT feature_id, variance, row_number() OVER (ORDER BY variance DESC, feature_id)::INT AS rank FROM v QUALIFY rank <= 100""")
def variable_features(spark, d):
    c = cells(spark, d)
    s = mx.log_normalize(mx.group_sums(counts(spark, d), c))
    v = mx.row_variance(s, c.select("cluster").distinct().count()).select("feature_id", r6(F.col("variance"), "variance"))
    return mx.top_features(v, "variance", 100)


@query("""SELECT vec_id AS cell_id, round_even(floor(rank() OVER (PARTITION BY label ORDER BY round(embedding[1], 1)) + (count(*) OVER (PARTITION BY label, round(embedding[1], 1)) - 1) / 2) / count(*) OVER (PARTITION BY label), 3) AS quantile FROM embeddings""")
def rank_quantiles(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.round(F.element_at("embedding", 1), 1).alias("v"))
    return e.select(F.col("vec_id").alias("cell_id"), st.rank_quantile("v", ["label"]).alias("quantile"))


@query(f"""WITH s AS (SELECT feature_id, sum(value) t FROM {COUNTS} GROUP BY 1)
SELECT p_partkey AS feature_id, p_name AS name FROM part LEFT JOIN s ON feature_id = p_partkey QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY coalesce(t, 0) DESC, p_partkey) = 1""")
def dedupe_features(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"))
    return mx.dedupe_features(counts(spark, d), f)


@query(f"""WITH s AS (SELECT p_partkey, p_name, coalesce(t, 0) AS t FROM part LEFT JOIN (SELECT feature_id, sum(value) AS t FROM {COUNTS} GROUP BY 1) ON feature_id = p_partkey),
m AS (SELECT p_name, median(t) AS m, count(*) AS c FROM s GROUP BY 1)
SELECT p_partkey AS feature_id, p_name AS name FROM s JOIN m USING (p_name) WHERE t = m OR c = 1 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1""")
def dedupe_features_metric(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"))
    return mx.dedupe_features(counts(spark, d), f, best=F.median)


@query("""SELECT vec_id AS cell_id, i - 1 AS dim, round((v - m) / s, 6) AS value FROM (SELECT vec_id, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1)::INT i, list_avg(embedding::DOUBLE[]) m, list_stddev_samp(embedding::DOUBLE[]) s FROM embeddings)""")
def zscores(spark, d):
    e = mx.zscore(embeddings(spark, d))
    return e.select("cell_id", F.posexplode("embedding").alias("dim", "v")).select("cell_id", "dim", r6(F.col("v"), "value"))


@query("SELECT seqname FROM (SELECT DISTINCT event_type AS seqname FROM events) INTERSECT SELECT seqname FROM (SELECT unnest(['click', 'view', 'other']) AS seqname) UNION SELECT seqname FROM (SELECT unnest(['zeta', 'alpha']) AS seqname)")
def set_operations(spark, d):
    names = lambda *n: spark.range(1).select(F.explode(F.array(*map(F.lit, n))).alias("seqname"))
    a = table(spark, d, "events").select(F.col("event_type").alias("seqname")).distinct()
    return a.intersect(names("click", "view", "other")).union(names("zeta", "alpha")).distinct()


@query(f"SELECT cell_id FROM {CELLS} WHERE cell_id NOT IN (SELECT cell_id FROM {COUNTS} WHERE value >= 4)")
def anti_join_cells(spark, d):
    return cells(spark, d).select("cell_id").join(counts(spark, d).where("value >= 4"), "cell_id", "left_anti")


# --- scores -----------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT DISTINCT seqname, strand, CASE WHEN strand = '-' THEN "end" ELSE "start" END pos FROM {GENES}),
w AS (SELECT seqname, 'w' kind, greatest(1, pos - 50) s, pos + 50 e, row_number() OVER () id FROM p),
f AS (SELECT seqname, 'f' kind, greatest(1, unnest([pos + 1901, pos - 2000])) s, unnest([pos + 2000, pos - 1901]) e FROM p),
win AS (SELECT seqname, kind, s, e, count(*) times FROM (SELECT seqname, kind, s, e FROM w UNION ALL SELECT * FROM f) WHERE s <= e GROUP BY ALL),
ends AS (SELECT event_id, chrom, cell_id, unnest(list_distinct(["start" + 1, "end"])) pos FROM {FRAGMENTS}),
hits AS (SELECT DISTINCT event_id, cell_id, seqname, kind, s, e, times FROM ends JOIN win ON chrom = seqname AND pos BETWEEN s AND e),
per AS (SELECT cell_id, coalesce(sum(times) FILTER (kind = 'w'), 0) w, coalesce(sum(times) FILTER (kind = 'f'), 0) f FROM hits GROUP BY 1)
SELECT cell_id, round_even(2 * (coalesce(w, 0) / 101) / greatest(coalesce(f, 0) / 100, 0.2), 3) AS tss_enrichment FROM (SELECT DISTINCT cell_id FROM {FRAGMENTS}) LEFT JOIN per USING (cell_id)""")
def tss_enrichment(spark, d):
    return sc.tss_enrichment(fragments(spark, d), genes(spark, d))


_TILES = f"""(SELECT seqname, tile, tile * 500 + 1 AS s, tile * 500 + 500 AS e FROM (SELECT DISTINCT chrom AS seqname, unnest(["start" // 500, ("end" - 1) // 500]) AS tile FROM {FRAGMENTS}))"""


def _tiles(spark, d):
    t = ct.tile_counts(fragments(spark, d)).withColumn("feature_id", F.concat_ws(":", "seqname", "tile"))
    ranges = t.select("feature_id", "seqname", (F.col("tile") * 500 + 1).alias("start"), (F.col("tile") * 500 + 500).alias("end")).distinct()
    return t.select("feature_id", "cell_id", "value"), ranges


_WEIGHTS = f"""(WITH b AS (SELECT name, seqname, CASE WHEN strand = '-' THEN "start" ELSE "start" - 500 END gs, CASE WHEN strand = '-' THEN "end" + 500 ELSE "end" END ge FROM {GENES}),
m AS (SELECT *, 1.0::DOUBLE / (ge - gs + 1) m FROM b), x AS (SELECT max(m) hi, min(m) lo FROM m)
SELECT name AS gene, t.seqname || ':' || tile AS feature_id, greatest(0, greatest(gs, s) - least(ge, e) - 1)::BIGINT AS distance,
  (exp(-abs(greatest(0, greatest(gs, s) - least(ge, e) - 1)) / 5000) + exp(-1)) * (1 + m * 4 / (hi - lo)) AS weight
FROM m JOIN {_TILES} t ON m.seqname = t.seqname AND gs - 1000 <= e AND s <= ge + 1000, x)"""


@query(f"SELECT gene, feature_id, distance, round(weight, 6) AS weight FROM {_WEIGHTS}")
def gene_weights(spark, d):
    _, ranges = _tiles(spark, d)
    return sc.gene_weights(genes(spark, d), ranges, (1000, 1000), upstream=500).select("gene", "feature_id", "distance", r6(F.col("weight"), "weight"))


@query(f"""SELECT gene, cell_id, round(sum(weight * value), 5) AS value FROM {_WEIGHTS} JOIN (
  SELECT seqname || ':' || tile AS feature_id, cell_id, count(*) AS value FROM (SELECT chrom AS seqname, cell_id, unnest(list_distinct(["start" // 500, ("end" - 1) // 500])) AS tile FROM {FRAGMENTS}) GROUP BY ALL) USING (feature_id) GROUP BY ALL""")
def gene_scores(spark, d):
    c, ranges = _tiles(spark, d)
    return sc.gene_scores(c, genes(spark, d), ranges, extend=(1000, 1000), upstream=500).select("gene", "cell_id", F.round("value", 5).alias("value"))


@query(f"""WITH q AS (SELECT event_id AS feature_id, chrom AS seqname, "start" AS s, "end" AS e FROM {FRAGMENTS}), p AS {_POINTS}, g AS {GENES},
l AS (SELECT q.*, p.pos lp, p.label ll FROM q ASOF LEFT JOIN p ON q.seqname = p.seqname AND q.e >= p.pos),
b AS (SELECT l.*, p.pos rp, p.label rl, CASE WHEN lp IS NOT NULL THEN greatest(0, s - lp - 1) END ld, CASE WHEN p.pos IS NOT NULL THEN greatest(0, p.pos - e - 1) END rd FROM l ASOF LEFT JOIN p ON l.seqname = p.seqname AND l.e < p.pos),
pr AS (SELECT DISTINCT feature_id FROM q JOIN g ON q.seqname = g.seqname AND (CASE WHEN strand = '-' THEN "end" - 99 ELSE "start" - 200 END) <= q.e AND q.s <= (CASE WHEN strand = '-' THEN "end" + 200 ELSE "start" + 99 END)),
ge AS (SELECT DISTINCT feature_id FROM q JOIN g ON q.seqname = g.seqname AND "start" <= q.e AND q.s <= "end"),
ex AS (SELECT DISTINCT feature_id FROM q JOIN g ON q.seqname = g.seqname AND "start" <= q.e AND q.s <= "start" + 20)
SELECT b.feature_id, least(ld, rd)::BIGINT AS dist_to_gene_start,
  CASE WHEN lp IS NULL THEN rl WHEN rp IS NULL OR ld < rd OR (ld = rd AND ll <= rl) THEN ll ELSE rl END AS nearest_gene,
  CASE WHEN pr.feature_id IS NOT NULL THEN 'Promoter' WHEN ge.feature_id IS NOT NULL AND ex.feature_id IS NOT NULL THEN 'Exonic' WHEN ge.feature_id IS NOT NULL THEN 'Intronic' ELSE 'Distal' END AS peak_type
FROM b LEFT JOIN pr ON pr.feature_id = b.feature_id LEFT JOIN ge ON ge.feature_id = b.feature_id LEFT JOIN ex ON ex.feature_id = b.feature_id""")
def peak_annotation(spark, d):
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))").cast("long")
    q = table(spark, d, "events").select(F.col("event_id").alias("feature_id"), F.col("event_type").alias("seqname"), start.alias("start"), (start + F.floor("value").cast("long") + 1).alias("end"))
    gs = genes(spark, d)
    return sc.annotate_peaks(q, gs, gs.select("seqname", "start", (F.col("start") + 20).alias("end")), 200, 100).select("feature_id", "dist_to_gene_start", "nearest_gene", "peak_type")


@query(f"""SELECT cell_id, CASE WHEN balance >= 3000 THEN balance * 2 ELSE balance END AS doublet_score, CASE WHEN balance >= 3000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS doublet_enrichment FROM {CELLS}""")
def combine_doublets(spark, d):
    c = cells(spark, d)
    one = c.select("cell_id", F.col("balance").alias("doublet_score"), F.lit(1.0).alias("doublet_enrichment"))
    two = c.select("cell_id", F.when(F.col("balance") >= 3000, F.col("balance") * 2).alias("doublet_score"), F.when(F.col("balance") >= 3000, F.lit(2.0)).alias("doublet_enrichment"))
    return db.combine_results([one, two])


@query(f"""SELECT cell_id, round(CASE WHEN log10(fragments) > 2.75 THEN 2.75 ELSE log10(fragments) END, 6) AS log10_fragments, balance AS tss_enrichment, (fragments >= 550 AND balance >= 1000) AS passes FROM {CELLS} WHERE sample = 'ASIA'""")
def enrichment_vs_depth(spark, d):
    c = cells(spark, d).withColumn("tss_enrichment", F.col("balance"))
    return qc.enrichment_vs_depth(c, "ASIA", 1000, 550, 2.75).select("cell_id", r6(F.col("log10_fragments"), "log10_fragments"), "tss_enrichment", "passes")


@query(f"""SELECT a.cell_id, count(*) - 1 AS neighbours FROM {CELLS} a JOIN {CELLS} b ON (a.fragments - b.fragments) * (a.fragments - b.fragments) + (a.balance - b.balance) * (a.balance - b.balance) <= 250000 GROUP BY 1""")
def neighbour_density(spark, d):
    return qc.neighbour_density(cells(spark, d), "fragments", "balance", 500)


@query(f"""WITH f AS (SELECT "end" - "start" AS size FROM {FRAGMENTS} WHERE sample = 'S1' AND "end" - "start" BETWEEN 1 AND 5500)
SELECT s.size, coalesce(n, 0)::BIGINT n, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM f), 6) percent FROM (SELECT unnest(range(1, 701)) size) s LEFT JOIN (SELECT size, count(*) n FROM f GROUP BY 1) USING (size)""")
def size_distribution_plot(spark, d):
    return qc.size_distribution(fragments(spark, d), "S1").select("size", "n", r6(F.col("percent"), "percent"))


# --- LSI --------------------------------------------------------------------------------------


def _tfidf_sql(value: str) -> str:
    return f"""WITH c AS {COUNTS}, cs AS (SELECT cell_id, sum(value)::DOUBLE s FROM c GROUP BY 1), rs AS (SELECT feature_id, sum(value)::DOUBLE r FROM c GROUP BY 1), n AS (SELECT count(*)::DOUBLE n FROM cs)
SELECT feature_id, cell_id, round({value}, 6) AS value FROM c JOIN cs USING (cell_id) JOIN rs USING (feature_id), n"""


for _m, _v in ((1, "value / s * ln(1 + n / r)"), (2, "ln(value / s * (n / r) * 10000 + 1)"), (3, "ln(value / s + 1) * ln(1 + n / r)")):

    def _run(spark, d, m=_m):
        return mx.tf_idf(counts(spark, d), m).select("feature_id", "cell_id", r6(F.col("value"), "value"))

    _run.__name__ = f"tf_idf_{_m}"
    query(_tfidf_sql(_v))(_run)


@query(f"""WITH s AS (SELECT cell_id, sum(value)::BIGINT AS col_sum FROM {COUNTS} GROUP BY 1), q AS (SELECT quantile_cont(col_sum::DOUBLE, 0.02) lo, quantile_cont(col_sum::DOUBLE, 0.98) hi FROM s)
SELECT cell_id, col_sum, (col_sum <= lo OR col_sum >= hi) AS outlier FROM s, q""")
def depth_outliers(spark, d):
    return lsi.depth_outliers(counts(spark, d))


@query("""SELECT (generate_subscripts(embedding, 1))::INT AS dim, unnest(embedding)::DOUBLE AS v, ln(vec_id + 1) / ln(10) AS y FROM embeddings""".join(("SELECT dim, round(corr(v, y), 6) AS correlation FROM (", ") GROUP BY 1")))
def depth_correlation(spark, d):
    e = embeddings(spark, d)
    return lsi.depth_correlation(e, e.select("cell_id", F.col("cell_id").alias("fragments"))).select("dim", r6(F.col("correlation"), "correlation"))


@query(f"""WITH c AS (SELECT *, log10(fragments + 1) AS d FROM {CELLS}), q AS (SELECT sample, quantile_cont(d, 0.01) lo, quantile_cont(d, 0.99) hi, count(*) n FROM c GROUP BY 1),
p AS (SELECT c.*, d BETWEEN lo AND hi AS ok, ceil(50 * n / (SELECT count(*) FROM c)::DOUBLE) AS want FROM c JOIN q USING (sample)),
e AS (SELECT *, sum(ok::INT) OVER (PARTITION BY sample) >= want AS enough FROM p)
SELECT cell_id, sample, fragments, cluster, balance FROM e WHERE ok OR NOT enough QUALIFY row_number() OVER (PARTITION BY sample ORDER BY md5(cell_id || '/1'), cell_id) <= want""")
def sampled_cells(spark, d):
    return lsi.sample_cells(cells(spark, d), 50)


@query()
def truncated_svd(spark, d):
    """Embedding of all cells by the ten leading factors."""
    embedding, _ = lsi.fit_lsi(spark, counts(spark, d), 10)
    return embedding


@query()
def iterative_lsi(spark, d):
    embedding, _ = lsi.iterative_lsi(spark, counts(spark, d), cells(spark, d), rank=10, num_features=1500, filter_quantile=1.0, cells_to_sample=10_000, resolution=1.2)
    return embedding


@query("SELECT unnest(range(0, 5))::INT AS dim, 1.0::DOUBLE AS correlation")
def projection_correlation(spark, d):
    """Training cells projected again agree with their embedding."""
    c = counts(spark, d)
    embedding, model = lsi.fit_lsi(spark, c, 5, outlier_quantiles=None)
    return lsi.projection_check(embedding, lsi.project_cells(c, model)).select("dim", r6(F.col("correlation"), "correlation"))


@query("""WITH f AS (SELECT DISTINCT p_size AS size FROM part), c AS (SELECT c_custkey::VARCHAR AS cell_id, c_custkey % 3 = 0 AS first, 1 + c_custkey % 100 AS b FROM customer),
n AS (SELECT sqrt(sum(size * size) FILTER (size > 25)) AS x, sqrt(sum(size * size) FILTER (size <= 25)) AS y FROM f)
SELECT cell_id, round(CASE WHEN first THEN b * x ELSE 0 END, 4) AS large, round(CASE WHEN first THEN 0 ELSE b * y END, 4) AS small FROM c, n""")
def planted_svd(spark, d):
    """Two blocks of rank one that share neither rows nor columns: factors and embedding are known."""
    sizes = table(spark, d, "part").select("p_size").distinct()
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cell_id"), (F.col("c_custkey") % 3 == 0).alias("first"), (F.col("c_custkey") % 100 + 1).alias("b"))
    values = c.join(F.broadcast(sizes), F.col("first") == (F.col("p_size") > 25)).select("cell_id", F.col("p_size").alias("feature_id"), (F.col("p_size") * F.col("b")).cast("double").alias("value"))
    features = sizes.select(F.col("p_size").alias("feature_id"), F.col("p_size").alias("fidx"))
    vectors = lsi._vectors(values, features)
    u, _ = lsi.svd(vectors, 51, 2)
    return lsi.project(vectors, u).select("cell_id", *[F.round(F.element_at("embedding", i + 1), 4).alias(n) for i, n in enumerate(("large", "small"))])


# --- neighbours and clusters --------------------------------------------------------------------


@query("""SELECT a.vec_id AS query_id, b.vec_id AS ref_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), b.vec_id)::INT AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= 5""")
def exact_knn(spark, d):
    e = embeddings(spark, d)
    return knn.exact_knn(e, e, 5, exclude_self=True).select("query_id", "ref_id", "rank")


@query("""WITH k AS (SELECT a.vec_id AS q, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), b.vec_id) r
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY r <= 10), n AS (SELECT q, label, count(*) c FROM k GROUP BY ALL)
SELECT q AS query_id, label AS cluster FROM n QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, label DESC) = 1""")
def neighbour_vote(spark, d):
    e = embeddings(spark, d)
    return knn.vote(knn.exact_knn(e, e, 10, exclude_self=True), e, ties="last")


@query()
def louvain_clusters(spark, d):
    e = embeddings(spark, d)
    return cl.cluster_embedding(spark, e.select("cell_id", "embedding"), e.select("cell_id", F.col("cell_id").alias("fragments")), resolution=0.8, max_clusters=6)


@query()
def walktrap_clusters(spark, d):
    e = embeddings(spark, d).select("cell_id", "embedding")
    return cl.cluster_embedding(spark, e, method="walktrap", k=10)


# --- pseudobulks and peaks ------------------------------------------------------------------------


@query(f"""WITH per AS (SELECT cluster AS "group", sample, count(*) n FROM (SELECT chr((65 + length(barcode) % 3 + CASE WHEN sample = 'S3' THEN 1 ELSE 0 END)::INT) AS cluster, sample FROM (SELECT DISTINCT cell_id, barcode, sample FROM {FRAGMENTS})) GROUP BY ALL),
s AS (SELECT "group", sum(n)::BIGINT total, count(*) samples, sum((n > 20)::INT) big, sum(least(n, 20)) capped FROM per GROUP BY 1)
SELECT "group", total, CASE WHEN big >= 2 THEN 1 WHEN samples > 1 AND capped > 40 THEN 2 WHEN total >= 40 THEN 3 WHEN total >= 36 THEN 4 WHEN total >= 32 THEN 5 ELSE 0 END::INT AS tier FROM s""")
def pseudobulk_tiers(spark, d):
    return pb.tiers(_pb_cells(spark, d), min_cells=20).na.fill(0, ["tier"])


def _pb_cells(spark, d):
    c = fragments(spark, d).select("sample", "barcode").distinct()
    letter = F.chr((65 + F.length("barcode") % 3 + F.when(F.col("sample") == "S3", 1).otherwise(0)).cast("int"))
    return c.select(g.cell_id(F.col("sample"), F.col("barcode")).alias("cell_id"), "sample", letter.alias("cluster"))


_PB_CELLS = f"""(SELECT cell_id, sample, chr((65 + length(barcode) % 3 + CASE WHEN sample = 'S3' THEN 1 ELSE 0 END)::INT) AS "group" FROM (SELECT DISTINCT cell_id, barcode, sample FROM {FRAGMENTS}))"""
_PB_USERS = f"""(SELECT DISTINCT cell_id, 'S' AS sample, CASE WHEN substr(barcode, 2)::BIGINT < 55 THEN 'X' WHEN substr(barcode, 2)::BIGINT < 105 THEN 'Y' ELSE 'Z' END AS "group" FROM {FRAGMENTS})"""


def _replicates_sql(cells: str, least: int, most: int, reps: int = 2, limit: int = 5, ratio: float = 0.8) -> str:
    """The cells of each replicate, policy by policy."""
    need, part = least * reps, int(least * ratio)
    return f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY "group", sample ORDER BY md5(cell_id || '/1'), cell_id) AS rs, row_number() OVER (PARTITION BY "group" ORDER BY md5(cell_id || '/1'), cell_id) AS rg FROM {cells}),
per AS (SELECT "group", sample, count(*) AS n, row_number() OVER (PARTITION BY "group" ORDER BY count(*) DESC, sample) AS i FROM c GROUP BY 1, 2),
t AS (SELECT "group", sum(n) AS total, CASE WHEN sum((n > {least})::INT) >= {reps} THEN 1 WHEN count(*) > 1 AND sum(least(n, {least})) > {need} THEN 2 WHEN sum(n) >= {need} THEN 3
  WHEN sum(n) >= {need * ratio + least - least * ratio} THEN 4 WHEN sum(n) >= {need * ratio} THEN 5 END AS tier FROM per GROUP BY 1),
walk AS (SELECT "group", sample, i, n, 1 AS rep, least(n, {least}) AS have, least(n, {least}) AS take FROM per JOIN t USING ("group") WHERE tier = 2 AND i = 1
  UNION ALL SELECT p."group", p.sample, p.i, p.n, CASE WHEN have >= {least} THEN rep + 1 ELSE rep END, CASE WHEN have >= {least} THEN least(p.n, {least}) ELSE have + least(p.n, {least} - have) END,
    CASE WHEN have >= {least} THEN least(p.n, {least}) ELSE least(p.n, {least} - have) END FROM walk w JOIN per p ON p."group" = w."group" AND p.i = w.i + 1 WHERE NOT (have >= {least} AND rep = {limit})),
spare AS (SELECT p."group", p.sample, p.i, coalesce(take, 0) AS used, p.n - coalesce(take, 0) AS free FROM per p JOIN t USING ("group") LEFT JOIN walk w ON w."group" = p."group" AND w.i = p.i WHERE tier = 2),
final AS (SELECT "group", max(rep) AS rep, {least} - max_by(have, i) AS short FROM walk GROUP BY 1),
top AS (SELECT s."group", rep, sample, used AS lo, used + least(free, greatest(0, short - coalesce(sum(free) OVER (PARTITION BY s."group" ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS hi FROM spare s JOIN final f ON f."group" = s."group"),
lost AS (SELECT f."group", f.rep FROM final f WHERE short > (SELECT sum(free) FROM spare s WHERE s."group" = f."group")),
plan AS (SELECT * FROM (SELECT "group", rep, sample, 0 AS lo, take AS hi FROM walk UNION ALL SELECT "group", rep, sample, lo, hi FROM top) x WHERE hi > lo AND NOT EXISTS (SELECT 1 FROM lost WHERE lost."group" = x."group" AND lost.rep = x.rep)),
s3 AS (SELECT *, (rg - 1) // least({most}, greatest({least}, total // {reps})) + 1 AS rep, least({most}, greatest({least}, total // {reps})) AS size FROM c JOIN t USING ("group") WHERE tier = 3)
SELECT "group", rep::INT AS rep, cell_id FROM (
  SELECT "group", i AS rep, cell_id FROM c JOIN t USING ("group") JOIN per USING ("group", sample) WHERE tier = 1 AND n >= {least} AND i <= {limit} AND rs <= {most}
  UNION ALL SELECT "group", rep, cell_id FROM c JOIN plan USING ("group", sample) WHERE rs > lo AND rs <= hi
  UNION ALL SELECT "group", rep, cell_id FROM s3 WHERE rep <= {limit} AND (rep * size <= total OR total - (rep - 1) * size >= {least})
  UNION ALL SELECT "group", (rg - 1) // {part} + 1, cell_id FROM c JOIN t USING ("group") WHERE tier = 4 AND rg <= {part * reps}
  UNION ALL SELECT "group", unnest(range(1, {reps + 1})), cell_id FROM c JOIN t USING ("group") WHERE tier = 4 AND rg > {part * reps} AND rg <= {part * reps + least - part}
  UNION ALL SELECT "group", rep, cell_id FROM (SELECT "group", cell_id, unnest(range(1, {reps + 1})) AS rep FROM c JOIN t USING ("group") WHERE tier = 5) QUALIFY row_number() OVER (PARTITION BY "group", rep ORDER BY md5(cell_id || '/' || rep || '/1'), cell_id) <= {least})"""


@query(_replicates_sql(_PB_CELLS, 20, 60))
def pseudobulk_cells(spark, d):
    """Groups of several samples: whole samples, or small ones put together."""
    return pb.select_cells(_pb_cells(spark, d), min_cells=20, max_cells=60)


@query(_replicates_sql(_PB_USERS, 27, 60))
def pseudobulk_random_cells(spark, d):
    """Groups of one sample: disjoint random replicates, topped up ones, independent draws."""
    user = F.col("user_id")
    c = table(spark, d, "events").select("user_id").distinct().select(
        g.cell_id(F.concat(F.lit("S"), user % 4), F.concat(F.lit("B"), user)).alias("cell_id"), F.lit("S").alias("sample"), F.when(user < 55, "X").when(user < 105, "Y").otherwise("Z").alias("cluster"))
    return pb.select_cells(c, min_cells=27, max_cells=60)


@query(f"""SELECT feature_id, sample || '_pseudobulk_rep1' AS replicate, sum(value)::BIGINT AS value FROM {COUNTS} JOIN {CELLS} USING (cell_id) GROUP BY ALL""")
def pseudobulk_counts(spark, d):
    sel = cells(spark, d).select(F.col("sample").alias("group"), F.lit(1).alias("rep"), "cell_id")
    return pb.pseudobulk_counts(counts(spark, d), sel)


@query(f"""WITH s AS (SELECT chrom, "group", pos, sum(d) d FROM (SELECT chrom, sample AS "group", unnest([greatest(0, "start" - 75), "start" + 75]) pos, unnest([1, -1]) d FROM {FRAGMENTS}) GROUP BY ALL HAVING sum(d) <> 0),
r AS (SELECT chrom, "group", pos AS "start", lead(pos) OVER w AS "end", sum(d) OVER w AS depth FROM s WINDOW w AS (PARTITION BY chrom, "group" ORDER BY pos))
SELECT "group", chrom AS seqname, "start", "end", depth::BIGINT AS depth FROM r WHERE depth > 0 AND "end" IS NOT NULL""")
def cut_pileup(spark, d):
    return pk.pileup(fragments(spark, d).select(F.col("sample").alias("group"), F.col("chrom").alias("seqname"), "start"))


#: Cuts of one sequence gathered into its first day, so that some places stand out.
_GATHERED = f"""(SELECT * REPLACE (CASE WHEN chrom = 'view' THEN "start" % 86400 ELSE "start" END AS "start") FROM {FRAGMENTS})"""


def _peaks_sql(level: str, cutoff: float, source: str = FRAGMENTS) -> str:
    """Poisson tails are summed upwards from the depth."""
    return f"""WITH s AS (SELECT chrom, "group", pos, sum(d) d FROM (SELECT chrom, sample AS "group", unnest([greatest(0, "start" - 75), "start" + 75]) pos, unnest([1, -1]) d FROM {source}) GROUP BY ALL HAVING sum(d) <> 0),
r AS (SELECT * FROM (SELECT chrom, "group", pos AS s, lead(pos) OVER w AS e, sum(d) OVER w AS depth FROM s WINDOW w AS (PARTITION BY chrom, "group" ORDER BY pos)) WHERE depth > 0 AND e IS NOT NULL),
rate AS (SELECT sample AS "group", count(*) * 150.0::DOUBLE / {5.0 * SPAN} AS m FROM {source} GROUP BY 1),
h0 AS (SELECT "group", depth, m, sum(e - s) AS bases FROM r JOIN rate USING ("group") GROUP BY ALL),
h AS (SELECT *, -log10(list_sum(list_transform(range(depth::BIGINT, depth::BIGINT + 100), lambda i: exp(i * ln(m) - m - lgamma(i + 1))))) AS p FROM h0),
h1 AS (SELECT *, p + log10(sum(bases) OVER w) - log10({5.0 * SPAN}) AS raw FROM h WINDOW w AS (PARTITION BY "group" ORDER BY p DESC)),
h2 AS (SELECT *, greatest(0.0, min(raw) OVER (PARTITION BY "group" ORDER BY p DESC)) AS q FROM h1),
a AS (SELECT r.*, {level} AS score FROM r JOIN h2 USING ("group", depth) WHERE {level} >= -log10({cutoff}::DOUBLE)),
a1 AS (SELECT *, coalesce(s - lag(e) OVER (PARTITION BY chrom, "group" ORDER BY s) > 50, true) AS fresh FROM a),
a2 AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY chrom, "group" ORDER BY s) AS region FROM a1),
a3 AS (SELECT *, max(e) OVER w - min(s) OVER w AS length, row_number() OVER (PARTITION BY chrom, "group", region ORDER BY depth DESC, s) AS best FROM a2 WINDOW w AS (PARTITION BY chrom, "group", region))
SELECT "group", chrom AS seqname, ((s + e) // 2 + 1)::BIGINT AS "start", ((s + e) // 2 + 1)::BIGINT AS "end", round(score, 6) AS score FROM a3 WHERE best = 1 AND length >= 150"""


def _summits(spark, d, cutoff=0.5, use_q=False, gathered=False):
    at = F.when((F.col("chrom") == "view") & F.lit(gathered), F.col("start") % 86400).otherwise(F.col("start"))
    cuts = fragments(spark, d).select(F.col("sample").alias("group"), F.col("chrom").alias("seqname"), at.alias("start"))
    return pk.call_peaks(cuts, 5.0 * SPAN, cutoff, use_q=use_q, max_gap=50).withColumn("score", F.round("score", 6))


@query(_peaks_sql("p", 0.5))
def called_peaks(spark, d):
    return _summits(spark, d)


@query(_peaks_sql("q", 0.1, _GATHERED))
def called_peaks_q(spark, d):
    return _summits(spark, d, 0.1, True, True)


def _greedy_sql(name: str, rows: str, key: str, by: str) -> str:
    """Peaks of ``rows`` in falling order, each kept if it meets none kept before."""
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {by} DESC, "start") AS i FROM {rows}),
{name}_w AS (SELECT {key}, 1 AS i, true AS ok, [{{'s': "start", 'e': "end"}}] AS kept FROM {name}_o WHERE i = 1
  UNION ALL SELECT {", ".join(f"o.{k}" for k in key.split(", "))}, o.i, len(list_filter(w.kept, lambda k: k.s <= o."end" AND k.e >= o."start")) = 0,
    CASE WHEN len(list_filter(w.kept, lambda k: k.s <= o."end" AND k.e >= o."start")) = 0 THEN list_append(w.kept, {{'s': o."start", 'e': o."end"}}) ELSE w.kept END
  FROM {name}_w w JOIN {name}_o o ON o.i = w.i + 1 AND {" AND ".join(f"o.{k} = w.{k}" for k in key.split(", "))}),
{name} AS (SELECT o.* FROM {name}_o o JOIN {name}_w w ON o.i = w.i AND ok AND {" AND ".join(f"o.{k} = w.{k}" for k in key.split(", "))})"""


def _rank_sql(by: str, key: str) -> str:
    return f"""round_even(floor(rank() OVER (PARTITION BY {key} ORDER BY {by}) + (count(*) OVER (PARTITION BY {key}, {by}) - 1) / 2) / count(*) OVER (PARTITION BY {key}), 3)"""


@query(f"""WITH RECURSIVE summits AS MATERIALIZED ({_peaks_sql("p", 0.5)}),
w AS (SELECT "group" AS replicate, CASE WHEN "group" IN ('S0', 'S1') THEN 'A' ELSE 'B' END AS "group", seqname, "start" - 250 AS "start", "end" + 250 AS "end", score FROM summits),
wide AS MATERIALIZED (SELECT *, {_rank_sql("score", '"group", replicate')} AS replicate_quantile FROM w),
d1 AS MATERIALIZED (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY "group", seqname, "start", "end" ORDER BY replicate_quantile DESC, replicate) = 1),
{_greedy_sql("g1", "d1", '"group", seqname', "replicate_quantile")},
seen AS (SELECT a."group", a.seqname, a."start", count(DISTINCT b.replicate) AS reproducibility FROM g1 a JOIN wide b ON a."group" = b."group" AND a.seqname = b.seqname AND a."start" <= b."end" AND b."start" <= a."end" GROUP BY ALL),
n AS (SELECT "group", count(DISTINCT replicate) AS n FROM wide GROUP BY 1),
r1 AS MATERIALIZED (SELECT g1.* EXCLUDE (i), reproducibility, n, round_even(reproducibility / n, 3) AS reproducibility_percent FROM g1 JOIN seen USING ("group", seqname, "start") JOIN n USING ("group") WHERE n = 1 OR reproducibility >= (n + 1) / 2),
d2 AS MATERIALIZED (SELECT *, {_rank_sql("replicate_quantile", '"group"')} AS group_quantile FROM r1),
{_greedy_sql("g2", "(SELECT *, 1 AS one FROM d2)", "seqname", "group_quantile")}
SELECT replicate, "group", seqname, "start", "end", score, replicate_quantile, group_quantile, CASE WHEN n > 1 THEN reproducibility END AS reproducibility, CASE WHEN n > 1 THEN reproducibility_percent END AS reproducibility_percent, seqname || ':' || "start" || '-' || "end" AS feature_id FROM g2""")
def reproducible_peaks(spark, d):
    s = _summits(spark, d).select(F.col("group").alias("replicate"), F.when(F.col("group").isin("S0", "S1"), "A").otherwise("B").alias("group"), "seqname", "start", "end", "score")
    return pk.peak_set(s, "(n + 1) / 2", 250)


# --- markers, doublets, integration ------------------------------------------------------------------


_MEMBERS = f"(SELECT s AS \"group\", cell_id, sample = s AS inside FROM {CELLS}, (SELECT DISTINCT sample s FROM {CELLS}))"


@query(f"""WITH m AS {_MEMBERS}, v AS (SELECT "group", cell_id, inside, feature_id, coalesce(value, 0) value FROM m CROSS JOIN (SELECT DISTINCT feature_id FROM {COUNTS}) LEFT JOIN {COUNTS} USING (feature_id, cell_id)),
r AS (SELECT *, rank() OVER (PARTITION BY "group", feature_id ORDER BY value) + (count(*) OVER (PARTITION BY "group", feature_id, value) - 1) / 2 AS rk, count(*) OVER (PARTITION BY "group", feature_id, value) t FROM v),
a AS (SELECT "group", feature_id, sum(rk) FILTER (inside) rs, count(*) FILTER (inside)::DOUBLE n1, count(*) FILTER (NOT inside)::DOUBLE n2, sum(t::DOUBLE * t - 1) ties, sum(value) FILTER (inside) s1, sum(value) FILTER (NOT inside) s2 FROM r GROUP BY ALL),
u AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) sg FROM a)
SELECT "group", feature_id, round(u / (n1 * n2), 8) AS auc, round(CASE WHEN sg > 0 THEN (u - n1 * n2 / 2 - sign(u - n1 * n2 / 2) * 0.5) / sg ELSE 0 END, 6) AS z,
  s1 / n1 AS mean1, s2 / n2 AS mean2 FROM u""".replace("s1 / n1 AS mean1, s2 / n2 AS mean2", "round(s1 / n1, 6) AS mean1, round(s2 / n2, 6) AS mean2"))
def rank_sum_test(spark, d):
    c = cells(spark, d)
    names = [r["sample"] for r in c.select("sample").distinct().orderBy("sample").collect()]  # one row per group
    members = c.select(F.explode(F.array(*map(F.lit, names))).alias("group"), "cell_id", "sample").select("group", "cell_id", (F.col("sample") == F.col("group")).alias("inside"))
    t = mk.rank_test(counts(spark, d), members)
    return t.select("group", "feature_id", F.round("auc", 8).alias("auc"), r6(F.col("z"), "z"), r6(F.col("sum1") / F.col("n1"), "mean1"), r6(F.col("sum2") / F.col("n2"), "mean2"))


@query("""WITH p AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_returnflag AS "group", (l_extendedprice / 100000) * (l_extendedprice / 100000) AS p FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY "group" ORDER BY p) + count(*) OVER (PARTITION BY "group", p) - 1 AS rk, count(*) OVER (PARTITION BY "group") n FROM p)
SELECT "group", p, round(least(1.0, min(p * n / rk) OVER (PARTITION BY "group" ORDER BY p DESC, rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def benjamini_hochberg(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("group"), ((F.col("l_extendedprice") / 100000) * (F.col("l_extendedprice") / 100000)).alias("p"))
    return st.benjamini_hochberg(p, "p", "q", ["group"]).select("group", "p", r6(F.col("q"), "q"))


#: Cells of a sample and as many others, nearest by threshold profile: rank by rank, in hashed order of the sample's cells.
_MATCHED = f"""fs AS (SELECT feature_id, sum(value) AS t FROM {COUNTS} GROUP BY 1), heavy AS (SELECT feature_id FROM fs WHERE t = (SELECT max(t) FROM fs)),
top AS (SELECT max(s) + 5 AS top FROM (SELECT sum(value) AS s FROM {COUNTS} WHERE feature_id IN (SELECT feature_id FROM heavy) GROUP BY cell_id)),
prof AS MATERIALIZED (SELECT c.cell_id, c.sample, i, count(k.value) AS n FROM {CELLS} c CROSS JOIN (SELECT unnest(range(1, top::BIGINT + 1)) AS i FROM top) LEFT JOIN {COUNTS} k ON k.cell_id = c.cell_id AND k.value >= i GROUP BY ALL),
near AS (SELECT a.sample AS "group", a.cell_id AS q, b.cell_id AS r, row_number() OVER (PARTITION BY a.cell_id ORDER BY sum((a.n - b.n) * (a.n - b.n)), b.cell_id) AS rank FROM prof a JOIN prof b ON a.i = b.i AND a.sample <> b.sample GROUP BY a.sample, a.cell_id, b.cell_id),
once AS (SELECT "group", r, rank, md5(q || ':1') AS h FROM near QUALIFY row_number() OVER (PARTITION BY "group", r ORDER BY rank, md5(q || ':1')) = 1),
size AS (SELECT sample AS "group", least(count(*), (SELECT count(*) FROM {CELLS}) - count(*)) AS want FROM {CELLS} GROUP BY 1),
m AS MATERIALIZED (SELECT sample AS "group", cell_id, true AS inside FROM {CELLS} UNION ALL
  SELECT "group", r, false FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY rank, h, r) AS i FROM once) JOIN size USING ("group") WHERE i <= want)"""


@query(f"WITH {_MATCHED} SELECT * FROM m")
def matched_cells(spark, d):
    g = cells(spark, d).select("cell_id", F.col("sample").alias("cluster"))
    return mk.matched_cells(mk.depth_profiles(counts(spark, d), g), g)


@query(f"""WITH {_MATCHED},
v AS (SELECT "group", cell_id, inside, feature_id, coalesce(value, 0) AS value FROM m CROSS JOIN (SELECT DISTINCT feature_id FROM {COUNTS}) LEFT JOIN {COUNTS} USING (feature_id, cell_id)),
r AS (SELECT *, rank() OVER (PARTITION BY "group", feature_id ORDER BY value) + (count(*) OVER (PARTITION BY "group", feature_id, value) - 1) / 2 AS rk, count(*) OVER (PARTITION BY "group", feature_id, value) t FROM v),
a AS (SELECT "group", feature_id, sum(rk) FILTER (inside) rs, count(*) FILTER (inside)::DOUBLE n1, count(*) FILTER (NOT inside)::DOUBLE n2, sum(t::DOUBLE * t - 1) ties, coalesce(sum(value) FILTER (inside), 0) s1, coalesce(sum(value) FILTER (NOT inside), 0) s2 FROM r GROUP BY ALL HAVING sum(value) > 0),
u AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) sg FROM a),
z AS (SELECT *, greatest(abs(CASE WHEN sg > 0 THEN (u - n1 * n2 / 2 - sign(u - n1 * n2 / 2) * 0.5) / sg ELSE 0 END) / sqrt(2), 1e-12) AS x FROM u),
p AS (SELECT *, greatest(0, 1 - 2 / sqrt(pi()) * exp(-x * x) * x * list_sum(list_transform(range(0, 300), lambda n: exp(n * ln(2 * x * x) - (n + 1) * ln(2) - lgamma(n + 1.5) + ln(pi()) / 2)))) AS pval FROM z),
o AS (SELECT *, rank() OVER (PARTITION BY "group" ORDER BY pval) + count(*) OVER (PARTITION BY "group", pval) - 1 AS rk, count(*) OVER (PARTITION BY "group") AS total FROM p)
SELECT "group", feature_id, round(log2((s1 + 1 + s2 + 1) / 2), 6) AS log2_mean, round(log2((s1 + 1) / (s2 + 1)), 6) AS log2_fc,
  round(least(1.0, min(pval * total / rk) OVER (PARTITION BY "group" ORDER BY pval DESC, rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS fdr, round(pval, 6) AS pval,
  round(s1 / n1, 6) AS mean1, round(s2 / n2, 6) AS mean2, n1::BIGINT AS n, round(u / (n1 * n2), 6) AS auc FROM o""")
def marker_features(spark, d):
    t = mk.marker_features(counts(spark, d), cells(spark, d).select("cell_id", F.col("sample").alias("cluster")))
    return t.select("group", "feature_id", *[r6(F.col(c), c) for c in ("log2_mean", "log2_fc", "fdr", "pval", "mean1", "mean2")], "n", r6(F.col("auc"), "auc"))


@query()
def doublet_scores(spark, d):
    return db.doublet_scores(spark, counts(spark, d), cells(spark, d).withColumn("sample", F.lit("all")), rank=8, num_features=1000, filter_quantile=1.0)


@query()
def gene_integration(spark, d):
    c = cells(spark, d)
    rna = counts(spark, d).withColumn("cell_id", F.concat(F.lit("r"), "cell_id"))
    labels, _ = ig.gene_integration(spark, counts(spark, d), c, rna, c.select(F.concat(F.lit("r"), "cell_id").alias("cell_id"), F.col("sample").alias("group")), n_genes=500, rank=10)
    return labels
