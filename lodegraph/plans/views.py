"""The tables in the state queries work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.session import table

NODE_COLUMNS = ["type", "name", "path", "status", "metadata", "created_at", "updated_at"]


def last_wins(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """The newest row of each key."""
    return df.where(df[key].isNotNull() & (df[key] != "")).groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("r")).select(key, "r.*")


def current_nodes(spark: SparkSession, d: str) -> DataFrame:
    return last_wins(table(spark, d, "nodes"), "id", "updated_at", NODE_COLUMNS)


def unique_edges(spark: SparkSession, d: str) -> DataFrame:
    """One row a (from_id, to_id, type), the earliest; types in one spelling; rows with a null or empty id left aside."""
    edges = table(spark, d, "edges").where("from_id is not null and from_id != '' and to_id is not null and to_id != ''").withColumn("type", F.lower(F.trim("type")))
    w = Window.partitionBy("from_id", "to_id", "type").orderBy(
        F.col("created_at").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("confidence", "source", "subtype", "note")]
    )
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def current_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "search_docs")
    return last_wins(docs, "node_id", "updated_at", [c for c in docs.columns if c != "node_id"])


#: The same views in DuckDB's SQL, as the head of a WITH.
NODES_SQL = """n AS (SELECT * FROM nodes WHERE id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)"""
EDGES_SQL = """e AS (SELECT from_id, to_id, lower(trim(type)) AS type, confidence, source, subtype, note, created_at FROM edges WHERE from_id <> '' AND to_id <> ''
  QUALIFY row_number() OVER (PARTITION BY from_id, to_id, lower(trim(type)) ORDER BY created_at NULLS LAST, confidence NULLS LAST, source NULLS LAST, subtype NULLS LAST, note NULLS LAST) = 1)"""
DOCS_SQL = """sd AS (SELECT * FROM search_docs WHERE node_id <> '' QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC NULLS LAST) = 1)"""
