"""Queries and SQL of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.heavy_keys import heavy_share_of, per_key_figures
from lodegraph.operators.hierarchy import Hierarchy, hierarchy
from lodegraph.operators.orphans import Reference, orphan_references, parents_of_nodes
from lodegraph.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    edges, files, docs = (table(spark, d, t) for t in ("edges", "indexed_files", "search_docs"))
    references = [
        Reference("edges", "from_id", edges, "from_id", "created_at"),
        Reference("edges", "to_id", edges, "to_id", "created_at"),
        Reference("indexed_files", "node_id", files, "node_id", "indexed_at"),
        Reference("search_docs", "node_id", docs, "node_id", "updated_at"),
    ]
    return orphan_references(references, parents_of_nodes(table(spark, d, "nodes")))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field, month and kind."""
    return p1_found(spark, d).groupBy("table_name", "field_name", "period", "kind").agg(F.count(F.lit(1)).alias("n_refs"))


def containment(spark: SparkSession, d: str) -> Hierarchy:
    edges = table(spark, d, "edges")
    rows = edges.where(F.lower(F.trim("type")) == "contains").select(F.col("to_id").alias("child"), F.col("from_id").alias("parent"), F.col("created_at").alias("at"))
    return hierarchy(rows)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return containment(spark, d).summary()


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return containment(spark, d).paths().select("node_id", F.array_join("path", "\n").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return containment(spark, d).pairs()


def _figures(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    edges, pairs = table(spark, d, "edges"), table(spark, d, "candidate_pairs")
    return {
        "edges": per_key_figures(edges, "to_id", "from_id", ["from_id", "to_id", "type"]),
        "candidate_pairs": per_key_figures(pairs, "value", "from_id", ["from_id", "to_id", "source", "value"]),
    }


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (heavy_share_of(f, 0.01).select(F.lit(t).alias("table_name"), "key_value", "n_rows", "n_from") for t, f in _figures(spark, d).items())
    return a.unionByName(b)


def p4_per_key(spark: SparkSession, d: str) -> DataFrame:
    a, b = (f.select(F.lit(t).alias("table_name"), "key_value", "n_rows", "n_from") for t, f in _figures(spark, d).items())
    return a.unionByName(b)


_P1 = """
WITH r AS (
  SELECT 'edges' AS table_name, 'from_id' AS field_name, from_id AS ref_id, created_at AS tm FROM edges
  UNION ALL SELECT 'edges', 'to_id', to_id, created_at FROM edges
  UNION ALL SELECT 'indexed_files', 'node_id', node_id, indexed_at FROM indexed_files
  UNION ALL SELECT 'search_docs', 'node_id', node_id, updated_at FROM search_docs),
m AS (
  SELECT *, coalesce(lower(trim(status)) IN ('deleted', 'removed'), false) OR coalesce(list_contains(map_keys(metadata), 'deleted_at'), false) AS dead
  FROM nodes WHERE id IS NOT NULL AND id <> ''),
n AS (SELECT id, arg_max(dead, updated_at) AS dead, min(created_at) AS born FROM m GROUP BY id),
g AS (
  SELECT table_name, field_name, ref_id, coalesce(strftime(tm, '%Y-%m'), 'unknown') AS period, min(tm) AS tm
  FROM r WHERE ref_id IS NOT NULL AND ref_id <> '' GROUP BY 1, 2, 3, 4),
k AS (
  SELECT g.table_name, g.field_name, g.ref_id, g.period,
    CASE WHEN n.id IS NULL THEN 'missing' WHEN n.dead THEN 'deleted' WHEN g.tm < n.born THEN 'late' END AS kind
  FROM g LEFT JOIN n ON g.ref_id = n.id)
"""

_P3 = """
WITH RECURSIVE r AS (
  SELECT to_id AS c, from_id AS p, created_at AS tm FROM edges
  WHERE lower(trim(type)) = 'contains' AND from_id <> '' AND to_id <> ''),
l AS (SELECT c, p FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY tm DESC NULLS LAST, p) AS k FROM r) WHERE k = 1),
ids AS (SELECT c AS id FROM r UNION SELECT p FROM r),
up(id, tm, d, cyc) AS (
  SELECT c, p, 1, c = p FROM l
  UNION ALL SELECT u.id, l.p, u.d + 1, l.p = u.id FROM up u JOIN l ON l.c = u.tm WHERE NOT u.cyc AND u.d < 400),
ring AS (SELECT DISTINCT id FROM up WHERE cyc),
bad AS (SELECT id FROM ring UNION SELECT u.id FROM up u JOIN ring ON u.tm = ring.id),
"""

_P4 = """
WITH f AS (
  SELECT 'edges' AS table_name, to_id AS key_value, count(*) AS n_rows, count(DISTINCT from_id) AS n_from
  FROM (SELECT DISTINCT from_id, to_id, type FROM edges) WHERE to_id IS NOT NULL AND to_id <> '' GROUP BY 2
  UNION ALL
  SELECT 'candidate_pairs', value, count(*), count(DISTINCT from_id)
  FROM (SELECT DISTINCT * FROM candidate_pairs) WHERE value IS NOT NULL AND value <> '' GROUP BY 2)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
    "p4_found": p4_found,
    "p4_per_key": p4_per_key,
}

ORACLES = {
    "p1_found": _P1 + "SELECT * FROM k WHERE kind IS NOT NULL",
    "p1_report": _P1 + "SELECT table_name, field_name, period, kind, count(*) AS n_refs FROM k WHERE kind IS NOT NULL GROUP BY ALL",
    "p3_found": _P3
    + """t AS (SELECT u.* FROM up u WHERE u.id NOT IN (SELECT id FROM bad)),
below AS (SELECT tm AS id, count(*) AS n FROM t GROUP BY tm),
top AS (SELECT id, max(d) AS d, arg_max(tm, d) AS root FROM t GROUP BY id)
SELECT ids.id AS node_id,
  CASE WHEN ring.id IS NOT NULL THEN 'cycle' WHEN bad.id IS NOT NULL THEN 'below_cycle' ELSE 'tree' END AS place,
  CASE WHEN bad.id IS NOT NULL THEN '' ELSE coalesce(top.root, ids.id) END AS root_id,
  CASE WHEN bad.id IS NOT NULL THEN -1 ELSE coalesce(top.d, 0) END::BIGINT AS depth,
  CASE WHEN bad.id IS NOT NULL THEN -1 ELSE coalesce(below.n, 0) END::BIGINT AS n_below
FROM ids LEFT JOIN ring USING (id) LEFT JOIN bad USING (id) LEFT JOIN top USING (id) LEFT JOIN below USING (id)""",
    "p3_paths": _P3
    + """t AS (SELECT u.* FROM up u WHERE u.id NOT IN (SELECT id FROM bad) UNION ALL SELECT id, id, 0, false FROM ids WHERE id NOT IN (SELECT id FROM bad))
SELECT id AS node_id, string_agg(tm, chr(10) ORDER BY d DESC) AS path FROM t GROUP BY id""",
    "p3_descendants": _P3 + "t AS (SELECT u.* FROM up u WHERE u.id NOT IN (SELECT id FROM bad)) SELECT tm AS ancestor, id AS node, d::INTEGER AS distance FROM t",
    "p4_found": _P4 + "SELECT table_name, key_value, n_rows, n_from FROM (SELECT *, sum(n_rows) OVER (PARTITION BY table_name) AS total FROM f) WHERE n_rows >= 0.01 * total",
    "p4_per_key": _P4 + "SELECT * FROM f",
}
