"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, hmm, langid, mixcoder, mixing, packing, piececount, quality, simhash, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_iblt_fingerprint": fingerprint.query,
        "op2_context_mixing_coder": mixcoder.query,
        "op3_piece_counts": piececount.query,
        "op4_quality_rules": quality.query,
        "op5_best_fit_packing": packing.query,
        "op6_toxicity": toxicity.query,
        "op7_mixing": mixing.query,
        "op8_byte_cnn_langid": langid.query,
        "op9_simhash_near_dedup": simhash.query,
        "op10_hmm_scoring": hmm.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.oracle()}
