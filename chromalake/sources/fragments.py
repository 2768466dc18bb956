"""Fragment files, summits, sequence lengths and sparse counts: scans and sinks.

A fragment file is tab-separated text (plain or gzip by name): a block of ``#`` lines at its
head, then chrom, start, end, barcode and read count.  Only the head block is comment; a
``#`` later is data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

FRAGMENT_SCHEMA = "chrom string, start long, end long, barcode string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 1, line), in file order.

    Lines are numbered per file split by Spark's own row order: block offsets are summed
    over a table of one row per partition, so a file is never gathered in one task.
    """
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"))
    raw = raw.withColumn("_part", F.shiftright("_id", 33))
    first = raw.groupBy("file", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_lo"))
    before = F.sum("_n").over(W.partitionBy("file").orderBy("_lo").rowsBetween(W.unboundedPreceding, -1))
    first = first.withColumn("_before", F.coalesce(before, F.lit(0)))
    return raw.join(F.broadcast(first.drop("_n")), ["file", "_part"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_lo") + 1).alias("line_no"), "line")


def _head_comment(lines: DataFrame) -> DataFrame:
    """Marks the lines of the head block: ``#`` lines before the first other line."""
    first = lines.where(~F.col("line").startswith("#")).groupBy("file").agg(F.min("line_no").alias("_first"))
    return lines.join(F.broadcast(first), "file", "left").withColumn("is_head", F.col("line_no") < F.coalesce("_first", F.lit(2**62))).drop("_first")


def parse_line(line: Column) -> dict[str, Column]:
    """Fields of a line and the reason why it is bad (null if it is good)."""
    f = F.split(line, "\t", -1)
    digits = lambda c: c.rlike(r"^\d+$")
    problem = (
        F.when(F.size(f) != 5, F.concat(F.lit("expected 5 fields, found "), F.size(f)))
        .when(F.exists(f, lambda x: x == ""), F.lit("empty field"))
        .when(~digits(F.get(f, F.lit(1))), F.lit("start is no number"))
        .when(~digits(F.get(f, F.lit(2))), F.lit("end is no number"))
    )
    good = problem.isNull()
    return {
        "chrom": F.when(good, F.get(f, F.lit(0))),
        "start": F.when(good, F.get(f, F.lit(1)).cast("long")),
        "end": F.when(good, F.get(f, F.lit(2)).cast("long")),
        "barcode": F.when(good, F.get(f, F.lit(3))),
        "problem": problem,
    }


def read_fragments(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """(chrom, start, end, barcode) of a file or folder.

    ``strict`` stops at a bad line with its number, ``permissive`` adds ``problem`` and
    ``line_no``.  In strict mode lines are numbered only in the error's own message.
    """
    lines = _head_comment(read_lines(spark, path)).where("not is_head")
    cols = parse_line(F.col("line"))
    if mode == "permissive":
        return lines.select("file", "line_no", *[c.alias(k) for k, c in cols.items()])
    fail = F.raise_error(F.concat(F.lit("line "), F.col("line_no"), F.lit(": "), F.col("problem")))
    parsed = lines.select("line_no", *[c.alias(k) for k, c in cols.items()])
    return parsed.select(F.when(F.col("problem").isNull(), F.col("chrom")).otherwise(fail).alias("chrom"), "start", "end", "barcode")


def read_fragment_header(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``# key=value`` lines in the head block, split at the first ``=``."""
    head = _head_comment(read_lines(spark, path)).where("is_head")
    parts = F.split(F.trim(F.regexp_replace("line", "^#", "")), "=", 2)
    return head.where(F.size(parts) == 2).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def read_sequence_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(seqname, length): the first two columns of a ``.fai`` index."""
    return spark.read.csv(path, sep="\t", schema="seqname string, length long, a string, b string, c string").select("seqname", "length")


def read_summits(spark: SparkSession, path: str) -> DataFrame:
    """BED columns 1, 2, 3 and 5; the start becomes 1-based."""
    bed = spark.read.csv(path, sep="\t", schema="seqname string, start long, end long, name string, score double")
    return bed.select("seqname", (F.col("start") + 1).alias("start"), "end", "score")


def write_fragments(fragments: DataFrame, path: str, read_count: int = 1) -> None:
    """Text with five columns, as the parser reads it."""
    cols = [F.col(c).cast("string") for c in ("chrom", "start", "end", "barcode")]
    fragments.select(F.concat_ws("\t", *cols, F.lit(str(read_count))).alias("value")).write.mode("errorifexists").text(path)


def coverage_rows(fragments: DataFrame, selected: DataFrame) -> DataFrame:
    """Fragments of selected cells, a row for each replicate that holds the cell.

    ``selected``: (group, rep, sample, barcode).
    """
    return fragments.join(selected, ["sample", "barcode"]).select("group", "rep", "chrom", "start", "end", "barcode")


def write_coverage(fragments: DataFrame, selected: DataFrame, path: str) -> None:
    """``chrom start end barcode`` files below group=…/rep=…; never overwrites."""
    rows = coverage_rows(fragments, selected)
    rows.write.mode("errorifexists").partitionBy("group", "rep").option("sep", "\t").csv(path)


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=f"{FRAGMENT_SCHEMA}, group string, rep int")


def write_counts(counts: DataFrame, path: str) -> None:
    """Sparse counts as Parquet in cell order; zeros are not stored; never overwrites."""
    tidy = counts.where("value <> 0").repartitionByRange("cell_id").sortWithinPartitions("cell_id", "feature_id")
    tidy.write.mode("errorifexists").parquet(path)


def run_length_counts(pairs: DataFrame) -> DataFrame:
    """Occurrences (feature_id, cell_id) become counts."""
    return pairs.groupBy("feature_id", "cell_id").agg(F.count(F.lit(1)).alias("value"))
