"""Search, resolution and related items over the workspace's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.text import phrases
from lodegraph.operators import search as s
from lodegraph.plans.views import DOCS_SQL, EDGES_SQL, NODES_SQL, current_docs, current_nodes, unique_edges

QUERIES, ORACLES = {}, {}
TWO, HOME = "harbour ledger", "note:Home.md"

_TEXTS = ["title", "rel_path", "scope", "body", "summary", "array_to_string(aliases, ' ')", "array_to_string(tags, ' ')"]


def _index_sql() -> str:
    columns = ", ".join(f"regexp_extract_all(strip_accents(lower(coalesce({t}, ''))), '[\\p{{L}}\\p{{N}}]+') AS t{n}" for n, t in enumerate(_TEXTS))
    size = " + ".join(f"len(t{n})" for n in range(len(_TEXTS)))
    posts = " UNION ALL ".join(f"SELECT node_id, {n} AS col, unnest(range(1, len(t{n}) + 1)) AS pos, unnest(t{n}) AS term FROM t" for n in range(len(_TEXTS)))
    return f"WITH {NODES_SQL}, {EDGES_SQL}, {DOCS_SQL}, t AS (SELECT node_id, {columns} FROM sd), sz AS (SELECT node_id, {size} AS len FROM t), po AS ({posts}), av AS (SELECT count(*) AS docs, avg(len) AS avg_len FROM sz)"


INDEX = _index_sql()


def _scores(term: str, tag: str = "") -> str:
    parts = []
    for n, phrase in enumerate(phrases(term)):
        joins = "".join(f" JOIN po p{k} ON p{k}.node_id = p0.node_id AND p{k}.col = p0.col AND p{k}.pos = p0.pos + {k} AND p{k}.term = '{w}'" for k, w in enumerate(phrase) if k)
        parts.append(f"SELECT {n} AS phrase, p0.node_id, count(*) AS f FROM po p0{joins} WHERE p0.term = '{phrase[0]}' GROUP BY p0.node_id")
    return f""", hi{tag} AS ({' UNION ALL '.join(parts)}),
df{tag} AS (SELECT phrase, count(*) AS n FROM hi{tag} GROUP BY phrase),
sc{tag} AS (SELECT node_id, sum(greatest(CASE WHEN i <= 0 THEN 1e-6 ELSE i END, 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len)) ORDER BY phrase) AS bm25
  FROM (SELECT h.*, sz.len, av.avg_len, ln((av.docs - d.n + 0.5) / (d.n + 0.5)) AS i FROM hi{tag} h JOIN df{tag} d USING (phrase) JOIN sz USING (node_id) CROSS JOIN av) GROUP BY node_id)"""


def _page(term: str, where: str = "true", mode: str = "hybrid", scope: str = "", limit: int = 20, tag: str = "") -> str:
    low = term.lower()
    scoped = f"(sd.scope = '{scope}')" if scope else "false"
    named = f"(contains(lower(rel_path), '{low}') OR contains(lower(title), '{low}'))"
    factor = {
        "structural": f"CASE WHEN {scoped} THEN 1.5 ELSE 1.0 END",
        "explicit": f"CASE WHEN {named} THEN 1.35 ELSE 1.0 END",
        "semantic": "1.0",
        "hybrid": f"(CASE WHEN {scoped} THEN 1.2 ELSE 1.0 END * CASE WHEN {named} THEN 1.2 ELSE 1.0 END)",
    }[mode]
    why = f"""'fts_match' || CASE WHEN contains(lower(rel_path), '{low}') THEN ',exact_path_token' ELSE '' END || CASE WHEN contains(lower(title), '{low}') THEN ',title_match' ELSE '' END || CASE WHEN {scoped} THEN ',same_scope' ELSE '' END"""
    return _scores(term, tag) + f""", pg{tag} AS (SELECT sd.node_id, n.type, title, rel_path, scope, bm25, bm25 * {factor} AS boosted, {why} AS reasons
FROM sc{tag} s JOIN sd ON sd.node_id = s.node_id JOIN n ON n.id = sd.node_id WHERE {where} ORDER BY bm25 DESC, sd.node_id LIMIT {limit})"""


def _six(c: str) -> str:
    return f"floor({c} * 1e6 + 0.5) / 1e6"


def _shown(page: DataFrame) -> DataFrame:
    return page.select("node_id", "type", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


_SHOW = f" SELECT node_id, type, {_six('boosted')} AS score, reasons FROM pg"


def _add(name: str, options: s.Options, where: str = "true") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _shown(s.search(s.build_index(current_docs(spark, d)), current_nodes(spark, d), options))

    QUERIES[name] = run
    ORACLES[name] = INDEX + _page(options.term, where, options.mode, options.scope, options.limit) + _SHOW


_add("fts_search_or", s.Options(TWO))
_add("fts_phrase", s.Options("audit-trail the-ledger planning-board"))
_add("fts_accents", s.Options("Größen REUNIONS résumé"))
_add("fts_filter_scope", s.Options("gateway", scope="."), "scope = '.'")
_add("fts_filter_path_prefix", s.Options("gateway", path_prefix="Projects"), "rel_path = 'Projects' OR lower(rel_path) LIKE 'projects/%'")
_add("fts_filter_tracked", s.Options("gateway", tracked=True), "tracked_state = 'tracked'")
_add("fts_filter_untracked", s.Options("gateway", untracked=True), "tracked_state = 'untracked'")
_add("fts_filter_both", s.Options("gateway", tracked=True, untracked=True))
_add("fts_filter_type", s.Options("gateway", type="file"), "type = 'file'")
_add("fts_mode_structural", s.Options("ledger", mode="structural", scope="."), "scope = '.'")
_add("fts_mode_explicit", s.Options("summary", mode="explicit"))
_add("fts_mode_semantic", s.Options("summary", mode="semantic"))
_add("fts_mode_hybrid", s.Options("summary", scope="."), "scope = '.'")
_add("fts_reasons", s.Options("planning", limit=50))


def fts_bm25_scores(spark, d):
    """Every document with a hit, common words with the floor of idf among them."""
    scores = s.bm25(s.build_index(current_docs(spark, d)), phrases("the " + TWO))
    return scores.select("node_id", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


def fts_term_stats(spark, d):
    """Document frequency of every term of the index."""
    index = s.build_index(current_docs(spark, d))
    return index.postings.select("term", "node_id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


def fts_corpus_stats(spark, d):
    return s.build_index(current_docs(spark, d)).sizes.agg(F.count(F.lit(1)).alias("docs"), F.sum("len").cast("bigint").alias("n_tokens"))


def fts_snippet(spark, d):
    docs, nodes = current_docs(spark, d), current_nodes(spark, d)
    return s.with_snippets(_shown(s.search(s.build_index(docs), nodes, s.Options(TWO))), docs, TWO)


def _resolve(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: s.resolve(s.build_index(current_docs(spark, d)), current_nodes(spark, d), text)
    ORACLES[name] = sql


_TOP = "the gateway"
_resolve("resolve_exact_id", HOME, f"WITH {NODES_SQL} SELECT id AS node_id, 'exact_id' AS reason FROM n WHERE id = '{HOME}'")
_resolve("resolve_top_hit", _TOP, INDEX + _page(_TOP, limit=1) + " SELECT node_id, 'top_hit' AS reason FROM pg")


def resolve_rel_path(spark, d):
    """The document whose path comes first."""
    docs = current_docs(spark, d)
    path = docs.agg(F.min("rel_path")).first()[0] or ""
    return s.resolve(s.build_index(docs), current_nodes(spark, d), path)


_FIRST = "(SELECT min(rel_path) FROM sd)"


def _related(mode: str):
    def run(spark, d):
        docs = current_docs(spark, d)
        index, nodes, edges = s.build_index(docs), current_nodes(spark, d), unique_edges(spark, d)
        if mode == "explicit":
            items = s.explicit_items(edges, nodes, docs, HOME)
            return items.select("node_id", "score", "reason").distinct()
        if mode == "structural":
            return s.scope_items(docs, nodes, "x.md", "").select("node_id", "score", "reason")
        if mode == "semantic":
            page = s.lexical_items(index, nodes, "Maps/gateway ledger.md", HOME, 10)
        else:
            page = s.related(index, nodes, edges, HOME, "hybrid", 25)
        return page.select("node_id", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"), "reason")

    return run


for _mode, _name in (("explicit", "related_explicit"), ("structural", "related_scope"), ("semantic", "related_lexical"), ("hybrid", "related_hybrid")):
    QUERIES[_name] = _related(_mode)

_NEAR = f"""x AS (SELECT to_id AS id, confidence AS score FROM e WHERE source = 'explicit' AND from_id = '{HOME}' UNION ALL SELECT from_id, confidence FROM e WHERE source = 'explicit' AND to_id = '{HOME}')"""
QUERIES |= {f.__name__: f for f in (fts_bm25_scores, fts_term_stats, fts_corpus_stats, fts_snippet, resolve_rel_path)}
ORACLES |= {
    "fts_bm25_scores": INDEX + _scores("the " + TWO) + f" SELECT node_id, {_six('bm25')} AS score FROM sc",
    "fts_term_stats": INDEX + " SELECT term, count(DISTINCT node_id) AS n_docs FROM po GROUP BY term",
    "fts_corpus_stats": INDEX + " SELECT count(*) AS docs, sum(len)::BIGINT AS n_tokens FROM sz",
    "resolve_rel_path": f"WITH {DOCS_SQL} SELECT min(node_id) AS node_id, 'exact_rel_path' AS reason FROM sd WHERE rel_path = {_FIRST}",
    "related_explicit": f"WITH {NODES_SQL}, {EDGES_SQL}, {_NEAR} SELECT DISTINCT x.id AS node_id, score, 'explicit_edge' AS reason FROM x JOIN n ON n.id = x.id WHERE x.id <> '{HOME}'",
    "related_scope": f"WITH {NODES_SQL}, {DOCS_SQL} SELECT node_id, 0.7::DOUBLE AS score, 'same_scope' AS reason FROM sd JOIN n ON n.id = sd.node_id WHERE scope = '.'",
    "related_lexical": INDEX + _page("gateway ledger", limit=11) + f" SELECT node_id, {_six('boosted')} AS score, 'lexical_match' AS reason FROM pg WHERE node_id <> '{HOME}'",
    "related_hybrid": INDEX + f", {_NEAR}" + _page("note:Home", limit=26) + f""",
b AS (SELECT 0 AS k, x.id AS node_id, score, 'explicit_edge' AS reason FROM x JOIN n ON n.id = x.id WHERE x.id <> '{HOME}'
  UNION ALL SELECT 1, node_id, 0.7, 'same_scope' FROM sd JOIN n ON n.id = sd.node_id WHERE scope = '.' AND node_id <> '{HOME}'
  UNION ALL SELECT 2, node_id, boosted, 'lexical_match' FROM pg WHERE node_id <> '{HOME}'),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY k, score DESC) = 1)
SELECT node_id, {_six('score')} AS score, reason FROM (SELECT * FROM o ORDER BY k, score DESC, node_id LIMIT 25)""",
}
