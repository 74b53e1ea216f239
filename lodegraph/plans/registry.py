"""All queries of the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegraph.plans import graph_queries, problems, search_queries, workspace_queries, written_queries

MODULES = [search_queries, graph_queries, workspace_queries, written_queries, problems]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    return search_queries.QUERIES["fts_search_or"](spark, directory)
