"""Queries of the problems on texts, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.near_duplicates import near_duplicates
from lodegraph.llm.packing import pack
from lodegraph.llm.set_joins import normal_values, set_similarity_join
from lodegraph.llm.similar import expand, links_of, newest
from lodegraph.llm.spam import spam_pages
from lodegraph.llm.tokenize import token_counts, token_ids
from lodegraph.session import table

CAPACITY = 2048


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = newest(table(spark, d, "search_docs"), "node_id", "updated_at", ["title", "body"])
    text = F.concat(F.coalesce(docs["title"], F.lit("")), F.lit(" "), F.coalesce(docs["body"], F.lit("")))
    return near_duplicates(docs, "node_id", text)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return expand(*_near(spark, d))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return links_of(*_near(spark, d))


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = newest(table(spark, d, "search_docs"), "node_id", "updated_at", ["tags", "aliases"])
    none = F.array().cast("array<string>")
    return set_similarity_join(docs, "node_id", normal_values(F.concat(F.coalesce(docs["tags"], none), F.coalesce(docs["aliases"], none))))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return expand(*_sets(spark, d))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return links_of(*_sets(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    counts = token_counts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return pack(counts, "doc_id", "n_tokens", CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(table(spark, d, "documents"), table(spark, d, "page_labels")).select("doc_id")


_SIMILAR = """,
o AS (SELECT x.node_id AS a, y.node_id AS b, count(*) AS n FROM s x JOIN s y ON x.v = y.v AND x.node_id < y.node_id GROUP BY ALL),
k AS (SELECT node_id, count(*) AS n FROM s GROUP BY node_id),
p AS (SELECT o.a AS node_a, o.b AS node_b FROM o JOIN k x ON x.node_id = o.a JOIN k y ON y.node_id = o.b WHERE o.n >= 0.6 * (x.n + y.n - o.n)),
c AS (SELECT node_id, min(node_id) OVER w AS class_id, count(*) OVER w AS n_copies
  FROM (SELECT node_id, list_sort(list(v)) AS l FROM s GROUP BY node_id) WINDOW w AS (PARTITION BY l)),
b AS (SELECT node_a AS i, node_b AS j FROM p UNION ALL SELECT node_b, node_a FROM p)
"""
_LINKS = """SELECT c.node_id, c.class_id, c.n_copies, count(e.node_id)::BIGINT AS n_links
FROM c LEFT JOIN b ON b.i = c.node_id LEFT JOIN c e ON e.node_id = b.j AND e.class_id <> c.class_id GROUP BY ALL"""

_P2 = (
    r"""
WITH d AS (SELECT node_id, lower(coalesce(title, '') || ' ' || coalesce(body, '')) AS t FROM search_docs WHERE node_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC NULLS LAST, title DESC, body DESC) = 1),
w AS (SELECT node_id, regexp_extract_all(t, '[\p{L}\p{N}]+') AS w FROM d),
g AS (SELECT DISTINCT node_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS v FROM w),
s AS (SELECT * FROM g WHERE node_id IN (SELECT node_id FROM g GROUP BY node_id HAVING count(*) >= 20))"""
    + _SIMILAR
)

_P5 = (
    """
WITH d AS (SELECT node_id, list_concat(coalesce(tags, []), coalesce(aliases, [])) AS l FROM search_docs WHERE node_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC NULLS LAST) = 1),
g AS (SELECT DISTINCT node_id, translate(lower(regexp_replace(trim(v), '^#', '')), '_ ', '--') AS v FROM (SELECT node_id, unnest(l) AS v FROM d) WHERE v IS NOT NULL),
f AS (SELECT * FROM g WHERE v <> ''),
s AS (SELECT * FROM f WHERE node_id IN (SELECT node_id FROM f GROUP BY node_id HAVING count(*) >= 4))"""
    + _SIMILAR
)

QUERIES = {"p2_found": p2_found, "p2_links": p2_links, "p5_found": p5_found, "p5_links": p5_links, "p6_ids": p6_ids, "p7_containers": p7_containers, "p8_found": p8_found}
ORACLES: dict[str, str] = {
    "p2_found": _P2 + "SELECT * FROM p",
    "p2_links": _P2 + _LINKS,
    "p5_found": _P5 + "SELECT * FROM p",
    "p5_links": _P5 + _LINKS,
}
