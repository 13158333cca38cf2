"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import hnsw, langid, media, mixing, packing, pii, repeats, separators, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": media.op1_media,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_hnsw": hnsw.op3_hnsw,
        "op4_pii": pii.op4_pii,
        "op5_language_id": langid.op5_language_id,
        "op6_token_counts": separators.op6_token_counts,
        "op7_repeats": repeats.op7_repeats,
        "op8_packing": packing.op8_packing,
        "op9_simhash": simhash.op9_simhash,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_pii": pii.ORACLE_OP4, "op7_repeats": repeats.ORACLE_OP7, "op10_mixing": mixing.ORACLE_OP10}
