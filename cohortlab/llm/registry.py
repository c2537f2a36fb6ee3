"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from cohortlab.llm import (ann, audit, bpe, fingerprints, importance, langid, lines, minhash, mixing, pii, quality, repeats,
                           toxicity)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_personal_data": pii.op2_personal_data,
        "op3_near_duplicates": minhash.op3_near_duplicates,
        "op4_source_mixing": mixing.op4_source_mixing,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_repeated_bytes": repeats.op6_repeated_bytes,
        "op7_syncmer_fingerprints": fingerprints.op7_syncmer_fingerprints,
        "op8_line_dedup": lines.op8_line_dedup,
        "op9_nearest_neighbours": ann.op9_nearest_neighbours,
        "op10_quality": quality.op10_quality,
        "op11_filter_audit": audit.op11_filter_audit,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_importance_resampling": importance.op13_importance_resampling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_source_mixing": mixing.ORACLE_SQL,
        "op8_line_dedup": lines.ORACLE_SQL,
        "op11_filter_audit": audit.ORACLE_SQL,
        "op13_importance_resampling": importance.ORACLE_SQL,
    }
