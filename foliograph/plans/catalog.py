"""The queries of the engine's own operators, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliograph.plans import block_queries, conversion_queries, corpus_queries, function_queries, gate_queries, operator_queries, page_queries, source_queries, structure_queries, table_queries, tree_queries
from foliograph.streaming import ledger_stream

_MODULES = (page_queries, corpus_queries, table_queries, structure_queries, function_queries, operator_queries, conversion_queries, tree_queries, gate_queries, source_queries, block_queries, ledger_stream)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which links of the corpus lead to pages that don't exist, and was the target ever a page of the source?"""
    return page_queries.internal_links_broken(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
