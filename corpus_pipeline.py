"""The corpus pipeline: quality rules, quality classifier, near-dedup, packing.

Each stage works on all rows its predecessor kept and, but for the last, returns the
columns of ``documents``.  A stage function takes (spark, docs, sf_dir).

Edge cases, for every stage: an empty table gives an empty table of the same columns; texts
are judged whole, whatever their length; columns other than id and text pass through
untouched, whatever their names (``n_chars``, if there, follows the text).  Null and empty
texts fail the quality rules; the later stages, called on their own, score them by the
classifier's bias, link them with nothing and pack them as a single end mark.  Repeated rows
and ids: the quality stages judge every row by itself; of rows that repeat an id the
near-duplicate stage keeps the one with the smallest text, and of each group the smallest
id (rows without an id stay); packing packs every row it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromalake.llm import minhash, nb_svm, packing, quality_rules
from chromalake.runtime import materialize


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that fail."""
    out = quality_rules.clean(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least ``nb_svm.CUT``, learned from the labels of those that are left."""
    model = nb_svm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return nb_svm.keep_good(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return minhash.keep_one(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: A classifier, MinHash and a tokenizer are beyond SQL; see tests/llm for brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
