"""Registry of the library's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldmend.plans import benchmark_queries, graph_queries, level_queries, registry, repair_queries, sampling_queries, scenario_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired labels of the embeddings' point field, with diagnostics."""
    return repair_queries.q_repair_multisample(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
