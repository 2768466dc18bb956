"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chromalake.llm import oracles
from chromalake.llm.licenses import op1_license_digests
from chromalake.llm.minhash import op10_minhash_large_small_star
from chromalake.llm.nb_svm import op8_nb_support_vectors
from chromalake.llm.packing import op7_sum_of_squares
from chromalake.llm.pieces import op9_piece_viterbi
from chromalake.llm.pivots import op6_pivot_permutation
from chromalake.llm.quality_rules import op4_line_first_rules
from chromalake.llm.sharding import op3_weighted_hash_tree
from chromalake.llm.url_filter import op2_url_language_model
from chromalake.llm.warc import op5_warc_source


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_license_digests,
        op2_url_language_model,
        op3_weighted_hash_tree,
        op4_line_first_rules,
        op5_warc_source,
        op6_pivot_permutation,
        op7_sum_of_squares,
        op8_nb_support_vectors,
        op9_piece_viterbi,
        op10_minhash_large_small_star,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ALL)
