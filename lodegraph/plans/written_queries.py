"""Queries over texts written from the tables: links, canvases, frontmatter, metadata, code and work items whose outcome the tables tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import paths as p
from lodegraph.operators import ledger, links, metadata, refresh, scopes
from lodegraph.plans.views import NODES_SQL, current_docs, current_nodes
from lodegraph.plans.workspace_queries import FI, N, _paths
from lodegraph.session import table

QUERIES, ORACLES = {}, {}
PLAIN = r"^[A-Za-z0-9_. /-]+$"  #: names that need no quoting in a link but for spaces


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_PARENT = "CASE WHEN contains({0}, '/') THEN regexp_extract({0}, '^(.*)/[^/]*$', 1) ELSE '.' END"
_WRITTEN = f"""WITH {NODES_SQL}, nt AS (SELECT DISTINCT name, {_PARENT.format('name')} AS folder FROM n WHERE type = 'note' AND id = 'note:' || name AND regexp_matches(name, '{PLAIN}')),
fr AS (SELECT folder, min(name) AS first FROM nt GROUP BY folder)"""


def _notes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Names of notes with their folder, and the first note of each folder."""
    n = current_nodes(spark, d).where((F.col("type") == "note") & (F.col("id") == F.concat(F.lit("note:"), "name")) & F.col("name").rlike(PLAIN)).select("name", p.parent(F.col("name")).alias("folder")).distinct()
    return n, n.groupBy("folder").agg(F.min("name").alias("first"))


@query(_WRITTEN + """SELECT 'note:' || name AS from_id, 'note:' || first AS to_id, CASE WHEN name = first THEN 'embed' ELSE 'markdown_link' END AS subtype FROM nt JOIN fr USING (folder)
UNION ALL SELECT 'note:' || name, 'attachment:assets/' || md5(name) || '.png', 'attachment' FROM nt""")
def link_resolution(spark, d):
    """Each note links (the first embeds) its folder's first note, a picture that isn't there yet, a note that isn't there, the web and an anchor."""
    notes, first = _notes(spark, d)
    to = F.concat(F.lit("](/"), F.replace("first", F.lit(" "), F.lit("%20")), F.lit("#part)"))
    text = F.concat(
        F.lit("Text "), F.when(F.col("name") == F.col("first"), "!").otherwise(""), F.lit("[x"), to, F.lit(" and ![p](/assets/"), F.md5("name"), F.lit(".png), [gone](/none/"), F.md5("name"), F.lit(".md), [web](https://a.example/x.md), [here](#there), [up](/../../../x.png)"),
    )
    written = notes.join(first, "folder").select(F.col("name").alias("rel_path"), text.alias("text"))
    return links.link_edges(written, current_nodes(spark, d))


@query(_WRITTEN + "SELECT 'canvas:' || folder || '/board.canvas' AS from_id, 'note:' || first AS to_id FROM fr")
def canvas_links(spark, d):
    """A canvas in each folder that shows its first note, a text and a file that isn't there; and one that isn't JSON."""
    _, first = _notes(spark, d)
    shown = F.array(F.struct(F.lit("file").alias("type"), F.col("first").alias("file")), F.struct(F.lit("text").alias("type"), F.lit("x").alias("file")), F.struct(F.lit("file").alias("type"), F.lit("none/none.md").alias("file")))
    boards = first.select(F.concat("folder", F.lit("/board.canvas")).alias("rel_path"), F.to_json(F.struct(shown.alias("nodes"))).alias("text"))
    bad = first.select(F.concat("folder", F.lit("/bad.canvas")).alias("rel_path"), F.lit('{"nodes": [').alias("text"))
    every = boards.unionByName(bad)
    return links.canvas_edges(every.where(links.is_json(F.col("text"))), current_nodes(spark, d))


_JOINED = "coalesce(array_to_string(list_sort(list_filter(list_transform({}, lambda x: trim(x)), lambda x: x <> '')), ','), '')"


@query(f"""WITH sd AS (SELECT * FROM search_docs WHERE node_id <> '' AND rel_path <> '' QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC NULLS LAST) = 1)
SELECT node_id, coalesce(title, '') AS title, {_JOINED.format('aliases')} AS aliases, {_JOINED.format('tags')} AS tags, coalesce(scope, '') AS status FROM sd WHERE coalesce(title, '') <> ''""")
def frontmatter_fields(spark, d):
    """Frontmatter written from the search documents and read again."""
    docs = current_docs(spark, d).where("rel_path != '' and coalesce(title, '') != ''")
    quoted = lambda c: F.get_json_object(F.to_json(F.struct(F.array(c).alias("x"))), "$.x[*]")
    lists = [F.concat(F.lit(f"{c}: "), F.coalesce(F.to_json(F.struct(F.col(c).alias("x"))), F.lit("{}"))) for c in ("aliases", "tags")]
    lists = [F.regexp_replace(F.regexp_replace(x, r'\{"x":', ""), r"\}$", "") for x in lists]
    lists = [F.when(F.col(c).isNotNull(), x) for c, x in zip(("aliases", "tags"), lists)]
    block = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), quoted(F.col("title"))), *lists, F.concat(F.lit("status: "), quoted(F.coalesce("scope", F.lit("")))), F.lit("---"), F.lit("body"))
    read = links.note_metadata(docs.select(F.col("node_id").alias("rel_path"), block.alias("text")))
    return read.select(F.col("rel_path").alias("node_id"), *[F.coalesce(F.col("metadata")[c], F.lit("")).alias(c) for c in ("title", "aliases", "tags", "status")])


@query(N + """, f AS (SELECT id FROM n WHERE type IN ('festival', 'phase')), i AS (SELECT id FROM n WHERE type = 'intent'), pr AS (SELECT id, name FROM n WHERE type = 'project' AND id = 'project:' || name), fi AS (SELECT min(id) AS first FROM i)
SELECT f.id AS from_id, pr.id AS to_id, 'links_to' AS type, 1.0::DOUBLE AS confidence FROM f, pr
UNION ALL SELECT i.id, fi.first, 'gathered_from', 1.0 FROM i, fi
UNION ALL SELECT i.id, pr.id, 'relates_to', 0.8 FROM i, pr""")
def stated_edges(spark, d):
    """Festival files that name each project, intents that name the first intent and every project, besides ones that aren't there."""
    n = current_nodes(spark, d)
    projects = n.where((F.col("type") == "project") & (F.col("id") == F.concat(F.lit("project:"), "name"))).select("name")
    steps, intents = n.where(F.col("type").isin("festival", "phase")).select("id"), n.where("type = 'intent'").select("id")
    # The few projects of a workspace; each is named by a file of its own.
    files = steps.join(projects, F.lit(True)).select("id", F.concat(F.lit("project_path: projects/"), "name", F.lit("/\nmetadata: {chain: none}")).alias("text"))
    first = intents.agg(F.expr("substring(min(id), 8)").alias("first"))
    named = projects.agg(F.sort_array(F.collect_list("name")).alias("names"))
    head = F.concat(F.lit('---\ngathered_from: ["'), "first", F.lit('.md", "none such"]\nrelated_projects: ["none", "'), F.array_join("names", '", "'), F.lit('"]\n---\nbody'))
    told = intents.join(first, F.lit(True)).join(named, F.lit(True)).select("id", head.alias("text"))
    return metadata.festival_edges(files, n).unionByName(metadata.intent_edges(told, n)).select("from_id", "to_id", "type", "confidence")


@query(FI + f""", g AS (SELECT p, {_PARENT.format('p')} AS dir, lower(regexp_extract(p, '\\.([^./]*)$', 1)) AS ext FROM fi), c AS (SELECT * FROM g WHERE ext IN ('go', 'py', 'ts', 'tsx', 'js', 'jsx', 'rs', 'java', 'rb', 'c', 'h', 'cc', 'cpp', 'hpp')),
q AS (SELECT *, 'package:' || dir || ':p' || length(dir) AS pkg FROM c WHERE ext = 'go')
SELECT 'folder:' || dir AS from_id, 'file:' || p AS to_id FROM c UNION SELECT 'folder:' || dir, pkg FROM q UNION SELECT pkg, 'file:' || p FROM q""")
def code_edges(spark, d):
    """Code files and packages of the indexed paths, each Go file with a package clause behind a comment."""
    files = scopes.code_files(_paths(spark, d).withColumnRenamed("p", "rel_path"), "rel_path")
    text = F.concat(F.lit("// package nothing\n\npackage p"), F.length(p.parent(F.col("rel_path"))).cast("string"), F.lit("\n\nfunc main() {}\n"))
    return scopes.code_slices(files.withColumn("content", text))[1]


@query(N + """, t AS (SELECT id, updated_at AS seq, unnest([split_part(name, '/', 1), 'R' || length(name), status]) AS alias FROM n WHERE type IN ('design_doc', 'explore_doc', 'intent', 'project') AND name IS NOT NULL)
SELECT alias, arg_max(id, (seq, id)) AS id FROM t WHERE alias <> '' GROUP BY alias""")
def workitem_aliases(spark, d):
    """Names that several items share; the last item counts."""
    n = current_nodes(spark, d).where(F.col("type").isin("design_doc", "explore_doc", "intent", "project") & F.col("name").isNotNull())
    items = n.select("id", F.col("updated_at").alias("seq"), F.split("name", "/")[0].alias("slug"), F.concat(F.lit("R"), F.length("name").cast("string")).alias("ref"), F.col("status").alias("item_id"))
    return ledger.workitem_aliases(items)


_STATES = f"CASE WHEN length({_PARENT.format('rel_path')}) % 3 = 0 THEN 'ignored' ELSE lower(trim(tracked_state)) END"


@query(f"""WITH fi AS (SELECT rel_path AS p, {_STATES} AS s FROM indexed_files WHERE rel_path <> ''), a AS (SELECT s, unnest([array_to_string(string_split(p, '/')[1:i], '/') for i in range(1, len(string_split(p, '/')))]) AS folder FROM fi)
SELECT folder FROM a GROUP BY folder HAVING bool_or(s = 'ignored') AND NOT coalesce(bool_or(s IN ('tracked', 'untracked')), false)""")
def ignored_dirs(spark, d):
    """Folders that hold ignored files only, where those of folders with every third length of name are told to be ignored."""
    files = table(spark, d, "indexed_files").where("rel_path != ''")
    state = F.when(F.length(p.parent(F.col("rel_path"))) % 3 == 0, "ignored").otherwise(F.col("tracked_state"))
    return scopes.ignored_folders(files.select("rel_path", state.alias("tracked_state")), "rel_path", "tracked_state")


_V = "(SELECT max(value) FROM graph_meta WHERE key = 'graph_schema_version')"
_BEFORE = f"CASE WHEN coalesce({_V}, '') = '' THEN 'fresh' WHEN {_V} = v THEN 'matching' ELSE 'incompatible' END"


@query(f"""SELECT v AS version, CASE WHEN has AND {_BEFORE} = 'matching' THEN 'refresh' ELSE 'rebuild' END AS mode, NOT (has AND {_BEFORE} = 'matching') AS stale_before, {_BEFORE} AS verdict, has
FROM (SELECT unnest([{_V}, 'graph/v1', 'graph/v2']) AS v), (SELECT (SELECT count(*) FROM nodes) > 0 AS has UNION ALL SELECT false)
UNION ALL SELECT 'no meta', 'rebuild', true, 'fresh', true""")
def decide_mode(spark, d):
    """What a refresh would do, for the stored version and others, with and without nodes, and without any meta."""
    meta, nodes = table(spark, d, "graph_meta"), table(spark, d, "nodes")
    stored = meta.where("key = 'graph_schema_version'").agg(F.max("value")).head()[0]
    rows = []
    for version in (stored, "graph/v1", "graph/v2"):
        for some in (nodes, nodes.limit(0)):
            rows.append((version, *refresh.decide_mode(meta, some, version), refresh.verdict(meta, version), some is nodes))
    rows.append(("no meta", *refresh.decide_mode(meta.limit(0), nodes), refresh.verdict(meta.limit(0)), True))
    return spark.createDataFrame(rows, "version string, mode string, stale_before boolean, verdict string, has boolean")
