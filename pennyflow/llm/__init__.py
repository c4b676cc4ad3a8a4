"""Operators for training-data corpora, and the queries that apply each to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The query of each operator, by name."""
    from . import bpe, cross_polytope, edit_counts, flac, itq, jaccard_join, kd_shards, langid, mixing, toxicity, url_filter, vector_codes, whitening

    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_mixing": mixing.op2_mixing,
        "op3_edit_counts": edit_counts.op3_edit_counts,
        "op4_kd_shards": kd_shards.op4_kd_shards,
        "op5_jaccard": jaccard_join.op5_jaccard,
        "op6_langid": langid.op6_langid,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_flac": flac.op8_flac,
        "op9_itq": itq.op9_itq,
        "op10_bpe": bpe.op10_bpe,
        "op11_whitening": whitening.op11_whitening,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_cross_polytope": cross_polytope.op13_cross_polytope,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the same rows, where SQL can express the operator."""
    from . import mixing, url_filter

    return {"op1_url_filter": url_filter.OP1_SQL, "op2_mixing": mixing.OP2_SQL}
