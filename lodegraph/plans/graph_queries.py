"""Queries on the graph: filters, slices, neighbourhoods, paths, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.model import DEFAULT_STYLE, MODE_SOURCES, NODE_TYPES, SCOPE_RANK, STYLES
from lodegraph.operators import graph as g
from lodegraph.operators import presentation, render
from lodegraph.plans.views import EDGES_SQL, NODES_SQL, current_nodes, unique_edges

HOME, FAR, TOOLS = "note:Home.md", "folder:pahaenba1", "note:Maps/tools.md"
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


N, E, NE = f"WITH {NODES_SQL} ", f"WITH {EDGES_SQL} ", f"WITH {NODES_SQL}, {EDGES_SQL} "
BRIEF = ["id", "type", "name", "status"]
LINK = ["from_id", "to_id", "type"]


@query(N + "SELECT type, count(*) AS n_nodes FROM n GROUP BY type")
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return g.type_counts(current_nodes(spark, d))


@query(N + "SELECT id, type, name, status FROM n WHERE type = 'project'")
def nodes_by_type(spark, d):
    return current_nodes(spark, d).where("type = 'project'").select(*BRIEF)


@query(N + f"SELECT id, type, name, status FROM n WHERE id = '{HOME}'")
def node_by_id(spark, d):
    # The filter on the key is pushed below the choice of the newest row, to the scan.
    return current_nodes(spark, d).where(F.col("id") == HOME).select(*BRIEF)


@query(E + f"SELECT from_id, to_id, type FROM e WHERE from_id = '{FAR}'")
def edges_from(spark, d):
    return unique_edges(spark, d).where(F.col("from_id") == FAR).select(*LINK)


@query(E + f"SELECT from_id, to_id, type FROM e WHERE to_id = '{HOME}'")
def edges_to(spark, d):
    return unique_edges(spark, d).where(F.col("to_id") == HOME).select(*LINK)


@query(N + "SELECT id, status, updated_at FROM n")
def node_last_wins(spark, d):
    return current_nodes(spark, d).select("id", "status", "updated_at")


@query(E + "SELECT from_id, to_id, type, confidence, source, created_at FROM e")
def edge_first_wins(spark, d):
    return unique_edges(spark, d).select(*LINK, "confidence", "source", "created_at")


@query(E + " UNION ALL ".join(f"SELECT '{m}' AS mode, count(*) AS n_edges FROM e" + (f" WHERE source = '{MODE_SOURCES[m]}'" if m in MODE_SOURCES else "") for m in (*MODE_SOURCES, "hybrid")))
def mode_filter(spark, d):
    edges = unique_edges(spark, d).select("source", F.lit(1).alias("one"))
    counts = [g.mode_filter(edges, m).agg(F.count(F.lit(1)).alias("n_edges")).select(F.lit(m).alias("mode"), "n_edges") for m in (*MODE_SOURCES, "hybrid")]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


_STATE = "lower(trim(coalesce(metadata['git_state'], '')))"


@query(NE + f", k AS (SELECT id FROM n WHERE {_STATE} IN ('', 'tracked')) SELECT from_id, to_id, type FROM e WHERE from_id IN (SELECT id FROM k) AND to_id IN (SELECT id FROM k)")
def tracked_filter(spark, d):
    return g.induced(unique_edges(spark, d), g.tracked_slice(current_nodes(spark, d), "tracked")).select(*LINK)


_SCOPE = "(SELECT min(name) FROM n WHERE type = 'folder' AND metadata['path_depth'] = '1')"
_AT = " OR ".join(f"trim(coalesce({c}, ''), '/') = s.s OR starts_with(trim(coalesce({c}, ''), '/'), s.s || '/')" for c in ("name", "path"))


def _first_scope(nodes: DataFrame) -> str:
    return nodes.where((F.col("type") == "folder") & (F.col("metadata")["path_depth"] == "1")).agg(F.min("name")).first()[0] or ""


@query(N + f", s AS (SELECT {_SCOPE} AS s) SELECT id, type, name, status FROM n, s WHERE {_AT}")
def scope_slice(spark, d):
    nodes = current_nodes(spark, d)
    return g.scope_slice(nodes, _first_scope(nodes)).select(*BRIEF)


@query(NE + f", s AS (SELECT {_SCOPE} AS s), k AS (SELECT id FROM n, s WHERE {_AT}) SELECT from_id, to_id, type FROM e WHERE from_id IN (SELECT id FROM k) AND to_id IN (SELECT id FROM k)")
def scope_edges(spark, d):
    nodes = current_nodes(spark, d)
    return g.induced(unique_edges(spark, d), g.scope_slice(nodes, _first_scope(nodes))).select(*LINK)


@query(NE + f", k AS (SELECT to_id AS id FROM e WHERE from_id = '{HOME}' UNION SELECT from_id FROM e WHERE to_id = '{HOME}') SELECT id, type, name, status FROM n WHERE id IN (SELECT id FROM k)")
def neighbors(spark, d):
    return g.neighbours(unique_edges(spark, d), current_nodes(spark, d), HOME).select(*BRIEF)


_HOPS = f""", b AS (SELECT from_id AS a, to_id AS b FROM e UNION ALL SELECT to_id, from_id FROM e),
h0 AS (SELECT id FROM n WHERE id = '{HOME}'),
h1 AS (SELECT id FROM h0 UNION SELECT b FROM b JOIN h0 ON a = id),
h2 AS (SELECT id FROM h1 UNION SELECT b FROM b JOIN h1 ON a = id) """


@query(NE + _HOPS + "SELECT from_id, to_id, type FROM e WHERE from_id IN (SELECT id FROM h1) AND to_id IN (SELECT id FROM h1)")
def subgraph_1hop(spark, d):
    return g.neighbourhood(current_nodes(spark, d), unique_edges(spark, d), HOME, 1)[1].select(*LINK)


@query(NE + _HOPS + "SELECT id, type, name, status FROM n WHERE id IN (SELECT id FROM h2)")
def subgraph_2hop(spark, d):
    return g.neighbourhood(current_nodes(spark, d), unique_edges(spark, d), HOME, 2)[0].select(*BRIEF)


@query(NE + "SELECT DISTINCT from_id, to_id FROM e WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)")
def simple_digraph(spark, d):
    return g.simple_digraph(current_nodes(spark, d), unique_edges(spark, d))


_PHASES = "type = 'contains' AND from_id LIKE 'festival:%' AND to_id LIKE 'festival:%' AND length(from_id) < length(to_id)"


@query(f"""WITH RECURSIVE {EDGES_SQL}, l AS (SELECT DISTINCT from_id, to_id FROM e WHERE {_PHASES}),
ids AS (SELECT from_id AS id FROM l UNION SELECT to_id FROM l),
w(id, layer) AS (SELECT id, 0 FROM ids UNION SELECT l.to_id, w.layer + 1 FROM w JOIN l ON l.from_id = w.id)
SELECT id, max(layer)::INTEGER AS layer FROM w GROUP BY id""")
def topo_layers(spark, d):
    """Layers of the festival steps only, whose ids grow along each edge, so that there is no loop and SQL can tell them; topo_layers_all has all ids."""
    return g.topological_layers(unique_edges(spark, d).where(_PHASES))


@query()
def topo_layers_all(spark, d):
    """Layers over all edges; ids on or behind a loop have layer -1."""
    return g.topological_layers(unique_edges(spark, d), strict=False)


@query(f"""WITH RECURSIVE {EDGES_SQL}, l AS (SELECT DISTINCT from_id, to_id FROM e),
w(id, path, d) USING KEY (id) AS (
  SELECT '{FAR}', ['{FAR}'], 0
  UNION SELECT * FROM (SELECT l.to_id, list_append(w.path, l.to_id), w.d + 1 FROM w JOIN l ON l.from_id = w.id WHERE NOT EXISTS (SELECT 1 FROM recurring.w AS r WHERE r.id = l.to_id)
    QUALIFY row_number() OVER (PARTITION BY l.to_id ORDER BY w.path) = 1)),
p AS (SELECT path FROM w WHERE id = '{TOOLS}')
SELECT (i - 1)::INTEGER AS step, path[i] AS id FROM p, unnest(range(1, len(path) + 1)) AS u(i)""")
def shortest_path(spark, d):
    """However many steps it takes."""
    return g.shortest_path(unique_edges(spark, d), FAR, TOOLS)


@query(E + f""", b AS (SELECT 'out' AS direction, to_id AS other, type FROM e WHERE from_id = '{HOME}' UNION ALL SELECT 'in', from_id, type FROM e WHERE to_id = '{HOME}')
SELECT direction, other, type, row_number() OVER w::INTEGER AS rank, greatest(count(*) OVER (PARTITION BY direction) - 50, 0) AS n_more
FROM b WINDOW w AS (PARTITION BY direction ORDER BY other, type) QUALIFY row_number() OVER w <= 50""")
def preview_caps(spark, d):
    return g.preview(unique_edges(spark, d), HOME)


@query(NE + " UNION ALL ".join(f"""SELECT '{m}' AS mode, '{way}' AS direction, e.type AS edge_type, e.source, e.confidence, n.id, n.type, n.name FROM e JOIN n ON n.id = e.{other}
WHERE e.{own} = '{TOOLS}'""" + (f" AND e.source = '{MODE_SOURCES[m]}'" if m in MODE_SOURCES else "") for m in ("hybrid", "structural", "explicit") for way, own, other in (("out", "from_id", "to_id"), ("in", "to_id", "from_id"))))
def focus_neighbours(spark, d):
    """What a node's edges lead to, each way, in three relation modes."""
    nodes, edges = current_nodes(spark, d), unique_edges(spark, d)
    modes = [g.focus(edges, nodes, TOOLS, m).withColumn("mode", F.lit(m)) for m in ("hybrid", "structural", "explicit")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


_STYLE = "(VALUES " + ", ".join(f"('{t}', '{s}', '{c}', '{f}')" for t, (s, c, f) in STYLES.items()) + ") AS st(type, shape, color, fillcolor)"
_LOOK = ", ".join(f"coalesce(st.{c}, '{v}') AS {c}" for c, v in zip(("shape", "color", "fillcolor"), DEFAULT_STYLE))


@query(N + f"SELECT DISTINCT n.type, coalesce(st.color, '{DEFAULT_STYLE[1]}') AS color, coalesce(st.fillcolor, '{DEFAULT_STYLE[2]}') AS fillcolor FROM n LEFT JOIN {_STYLE} ON st.type = n.type")
def legend(spark, d):
    return render.legend(current_nodes(spark, d))


@query(NE + "SELECT (SELECT count(*) FROM n) || ' nodes, ' || (SELECT count(*) FROM e) || ' edges' AS line")
def summary_line(spark, d):
    return render.summary_line(current_nodes(spark, d), unique_edges(spark, d))


def _esc(c: str) -> str:
    return f"'\"' || replace(replace({c}, '\\', '\\\\'), '\"', '\\\"') || '\"'"


@query(NE + f""", m AS (SELECT n.id, n.name, {_LOOK} FROM n LEFT JOIN {_STYLE} ON st.type = n.type)
SELECT 1 AS part, '  ' || {_esc('id')} || ' [label=' || {_esc("coalesce(name, '')")} || ', shape=' || shape || ', color="' || color || '", fillcolor="' || fillcolor || '"];' AS line FROM m
UNION ALL SELECT 2, '  ' || {_esc('from_id')} || ' -> ' || {_esc('to_id')} || ' [label=' || {_esc('type')} || '];' FROM e""")
def dot_lines(spark, d):
    return render.dot_lines(current_nodes(spark, d), unique_edges(spark, d))


@query(NE + """SELECT 'node' AS kind, id AS a, '' AS b, type, name, path, status, NULL::DOUBLE AS confidence, NULL AS source FROM n
UNION ALL SELECT 'edge', from_id, to_id, type, NULL, NULL, NULL, confidence, source FROM e""")
def render_json(spark, d):
    """Every line of the JSON export, read again."""
    rows = render.json_rows(current_nodes(spark, d), unique_edges(spark, d))
    read = rows.select("kind", "place", F.from_json("json", "id string, from_id string, to_id string, type string, name string, path string, status string, confidence double, source string").alias("j"))
    return read.select("kind", F.coalesce("j.id", "j.from_id").alias("a"), F.coalesce("j.to_id", F.lit("")).alias("b"), "j.type", "j.name", "j.path", "j.status", "j.confidence", "j.source")


_RANKS = "(VALUES " + ", ".join(f"('{t}', {n})" for n, t in enumerate(NODE_TYPES)) + ") AS r(type, rank)"


@query(N + f"SELECT n.id, n.type, coalesce(r.rank, 100)::INTEGER AS type_rank FROM n LEFT JOIN {_RANKS} ON r.type = n.type")
def group_by_type(spark, d):
    return presentation.type_ranks(current_nodes(spark, d)).select("id", "type", "type_rank")


_KINDS = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in SCOPE_RANK.items()) + ") AS k(kind, rank)"


@query(N + f"""SELECT n.id, n.name, k.rank::INTEGER AS rank, metadata['path_depth'] AS depth FROM n JOIN {_KINDS} ON k.kind = metadata['scope_kind']
WHERE n.type = 'folder' AND metadata['path_depth'] <> '' AND (metadata['path_depth'] IN ('0', '1') OR k.kind IN ('repo_root', 'submodule_root', 'campaign_bucket'))""")
def scope_anchors(spark, d):
    return presentation.scope_anchors(current_nodes(spark, d))


@query(N + """SELECT id FROM n WHERE type = 'note' AND lower(trim(coalesce(metadata['tracked_state'], metadata['git_state']))) = 'untracked' AND (path = '/vault/projects' OR starts_with(path, '/vault/projects/'))""")
def anchor_filter(spark, d):
    return presentation.filter_anchors(current_nodes(spark, d), type_="note", tracked="untracked", scope="/vault/projects").select("id")

