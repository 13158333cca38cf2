"""The catalogue of registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.plans import card_queries, corpus, gate_queries, generator_queries, merge_queries, model_queries, name_queries, rank_queries, registry, source_queries, text_queries

#: Importing these modules registers their queries.
MODULES = (text_queries, gate_queries, rank_queries, name_queries, merge_queries, card_queries, model_queries, source_queries, generator_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.flagship(registry.table(spark, sf_dir, "documents"), registry.table(spark, sf_dir, "labels"))


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
