"""Queries on paths, folders, links, inference, refresh and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import paths as p
from lodegraph.model import BUCKETS, CODE_LANGUAGES, EVIDENCE_WEIGHTS
from lodegraph.operators import inference, ledger, links, refresh, scopes
from lodegraph.plans.views import EDGES_SQL, NODES_SQL, current_nodes, last_wins, unique_edges
from lodegraph.session import cut, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


N, NE = f"WITH {NODES_SQL} ", f"WITH {NODES_SQL}, {EDGES_SQL} "
_FILES = "fi AS (SELECT DISTINCT rel_path AS p FROM indexed_files WHERE rel_path <> '')"
FI = f"WITH {_FILES} "
NOTES = "nt AS (SELECT rel_path, coalesce(text, '') AS text FROM documents WHERE rel_path IS NOT NULL)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_files").where("rel_path != ''").select(F.col("rel_path").alias("p")).distinct()


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("rel_path is not null").select("rel_path", F.coalesce("text", F.lit("")).alias("text"))


# Paths.

_BASE = "regexp_extract({}, '[^/]*$', 0)"
_EXT = "lower(regexp_extract({}, '\\.([^./]*)$', 1))"
_PARENT = "CASE WHEN contains({0}, '/') THEN regexp_extract({0}, '^(.*)/[^/]*$', 1) ELSE '.' END"


def _sql_stem(c: str) -> str:
    b = _BASE.format(c)
    return f"CASE WHEN strpos(substr({b}, 2), '.') > 0 THEN regexp_replace({b}, '\\.[^.]*$', '') ELSE {b} END"


@query(FI + f"SELECT p, {_BASE.format('p')} AS base, {_sql_stem('p')} AS stem, {_EXT.format('p')} AS ext, {_PARENT.format('p')} AS parent, len(string_split(p, '/'))::INTEGER AS depth, trim(replace(regexp_replace({_BASE.format('p')}, '\\.[^.]*$', ''), '_', ' ')) AS title FROM fi")
def path_parts(spark, d):
    c = F.col("p")
    return _paths(spark, d).select("p", p.basename(c).alias("base"), p.stem(c).alias("stem"), p.extension(c).alias("ext"), p.parent(c).alias("parent"), p.depth(c).alias("depth"), p.title_of(c).alias("title"))


_SEG = "string_split(p, '/')"


@query(FI + f"SELECT p, array_to_string([array_to_string({_SEG}[1:i], '/') for i in range(1, len({_SEG}))], '|') AS above FROM fi")
def folder_ancestors(spark, d):
    return _paths(spark, d).select("p", F.array_join(p.ancestors(F.col("p")), "|").alias("above"))


@query(FI + f"SELECT p, CASE WHEN len({_SEG}) >= 3 AND {_SEG}[1] = 'projects' THEN array_to_string({_SEG}[1:2], '/') WHEN len({_SEG}) >= 4 AND {_SEG}[1] = 'festivals' THEN array_to_string({_SEG}[1:3], '/') END AS owner FROM fi")
def artifact_owned(spark, d):
    return _paths(spark, d).select("p", p.artifact_scope(F.col("p")).alias("owner"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \\-_/.,()\\[\\]:]+'), lambda x: strlen(x) >= 3))"


@query(FI + f"SELECT p, array_to_string(list_sort({_TOK.format(_sql_stem('p'))}), ' ') AS tokens FROM fi")
def name_tokens(spark, d):
    return _paths(spark, d).select("p", F.array_join(F.array_sort(p.name_tokens(p.stem(F.col("p")))), " ").alias("tokens"))


@query("SELECT node_id, updated_at, array_to_string(list_sort(list_filter(list_transform(coalesce(tags, []), lambda x: trim(x)), lambda x: x <> '')), ',') AS tags FROM search_docs")
def canonical_join(spark, d):
    return table(spark, d, "search_docs").select("node_id", "updated_at", p.join_canonical(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"))


@query("SELECT w, CASE WHEN w <= 0 THEN 0.0 WHEN w >= 1 THEN 1.0 ELSE 1 - (1 - w) * (1 - w) END AS s, floor(w * 1000 + 0.5) / 1000 AS r FROM (SELECT DISTINCT confidence AS w FROM edges WHERE confidence IS NOT NULL)")
def saturation(spark, d):
    w = F.col("w")
    return table(spark, d, "edges").where("confidence is not null").select(F.col("confidence").alias("w")).distinct().select("w", p.saturate(w).alias("s"), p.round3(w).alias("r"))


# Folders and repositories.

_FOLDERS = f"fo AS (SELECT DISTINCT unnest([array_to_string({_SEG}[1:i], '/') for i in range(1, len({_SEG}))]) AS folder FROM fi)"


def _folders(spark, d):
    return scopes.folders(_paths(spark, d), "p")


@query(FI + f", {_FOLDERS} SELECT folder, {_PARENT.format('folder')} AS parent FROM fo")
def folder_contains(spark, d):
    return _folders(spark, d)


_REPOS = "re AS (SELECT DISTINCT repo_root AS rel_path, starts_with(repo_root, 'projects/') AS sub FROM indexed_files WHERE repo_root <> '' AND repo_root <> '.')"


def _repos(spark, d):
    r = table(spark, d, "indexed_files").where("repo_root != '' and repo_root != '.'").select(F.col("repo_root").alias("rel_path")).distinct()
    return r.withColumn("is_submodule", F.col("rel_path").startswith("projects/"))


@query(
    FI + f", {_FOLDERS}, {_REPOS} SELECT folder, CASE WHEN re.sub THEN 'submodule_root' WHEN re.rel_path IS NOT NULL THEN 'repo_root' WHEN folder IN ({', '.join(repr(b) for b in BUCKETS)}) THEN 'campaign_bucket' "
    "WHEN regexp_matches(folder, '^(projects|festivals|workflow|[.]campaign)/') THEN 'artifact_scope' ELSE 'user_scope' END AS kind FROM fo LEFT JOIN re ON re.rel_path = folder"
)
def folder_kind(spark, d):
    return scopes.folder_kinds(_folders(spark, d), _repos(spark, d))


@query(
    N + f""", it AS (SELECT id, name AS p FROM n WHERE type IN ('note', 'canvas', 'attachment') AND name <> ''), fd AS (SELECT DISTINCT name AS folder FROM n WHERE type = 'folder' AND name <> ''),
a AS (SELECT id, unnest([array_to_string({_SEG}[1:i], '/') for i in range(1, len({_SEG}))]) AS folder FROM it),
b AS (SELECT id, arg_max(folder, length(folder)) AS folder FROM a WHERE folder IN (SELECT folder FROM fd) GROUP BY id)
SELECT it.id, coalesce(b.folder, '.') AS folder FROM it LEFT JOIN b USING (id)"""
)
def nearest_ancestor(spark, d):
    n = current_nodes(spark, d)
    items = n.where("type in ('note', 'canvas', 'attachment') and name != ''").select("id", F.col("name").alias("p"))
    return scopes.nearest_ancestor(items, "id", "p", n.where("type = 'folder' and name != ''").select(F.col("name").alias("folder")))


@query(FI + f", {_REPOS} SELECT p, coalesce(arg_max(re.rel_path, length(re.rel_path)), '.') AS owner FROM fi LEFT JOIN re ON p = re.rel_path OR starts_with(p, re.rel_path || '/') GROUP BY p")
def deepest_boundary(spark, d):
    return scopes.owner_boundary(_paths(spark, d), "p", _repos(spark, d))


_LANG = "(VALUES " + ", ".join(f"('{e}', '{x}')" for e, x in CODE_LANGUAGES.items()) + ") AS la(e, language)"


@query(FI + f"SELECT p, language FROM fi JOIN {_LANG} ON la.e = {_EXT.format('p')}")
def code_language(spark, d):
    return scopes.code_files(_paths(spark, d), "p").select("p", "language")


# Links.

_BLOCK = "CASE WHEN starts_with(text, '---' || chr(10)) AND strpos(substr(text, 5), chr(10) || '---') > 0 THEN substr(text, strpos(substr(text, 5), chr(10) || '---') + 8) ELSE text END"


@query(f"""WITH {NOTES}, m AS (SELECT rel_path, unnest(regexp_extract_all(text, '!?\\[[^\\]]*\\]\\(([^)\\s]+)\\)', 1)) AS raw FROM nt),
c AS (SELECT rel_path, regexp_extract(raw, '^[^#?]*', 0) AS t FROM m WHERE NOT regexp_matches(raw, '{links.EXTERNAL}'))
SELECT rel_path, count(*) AS n_links, sum(starts_with(t, '..')::INT)::BIGINT AS n_up FROM c WHERE t <> '' AND NOT contains(t, '../../..') GROUP BY rel_path""")
def md_links(spark, d):
    """Internal markdown links of each note; targets that climb above the root are none."""
    notes = _notes(spark, d)
    found = links.markdown_links(notes).groupBy("rel_path").agg(F.count(F.lit(1)).alias("n_links"))
    up = notes.select("rel_path", F.explode(F.regexp_extract_all("text", F.lit(links.LINK), F.lit(2))).alias("t")).groupBy("rel_path").agg(F.count_if(F.col("t").startswith("..")).alias("n_up"))
    return found.join(up, "rel_path")


@query(f"WITH {NOTES} SELECT DISTINCT rel_path, target FROM (SELECT rel_path, trim(unnest(regexp_extract_all(text, '{links.WIKI}', 1))) AS target FROM nt) WHERE target <> ''")
def wiki_links(spark, d):
    return links.wiki_links(_notes(spark, d))


@query(f"WITH {NOTES}, b AS (SELECT rel_path, {_BLOCK} AS body FROM nt) SELECT DISTINCT rel_path, lower(tag) AS tag FROM (SELECT rel_path, unnest(regexp_extract_all(body, '{links.TAG}', 1)) AS tag FROM b)")
def inline_tags(spark, d):
    return links.inline_tags(_notes(spark, d))


def _note_nodes(spark, d):
    """The notes that exist: those of the graph, and the documents themselves."""
    own = _notes(spark, d).select(F.concat(F.lit("note:"), "rel_path").alias("id"), F.lit("note").alias("type"), F.col("rel_path").alias("name"))
    return current_nodes(spark, d).select("id", "type", "name").unionByName(own)


@query(
    N + f""", {NOTES}, al AS (SELECT id, name FROM n WHERE type = 'note' UNION SELECT 'note:' || rel_path, rel_path FROM nt),
ix AS (SELECT lower({_sql_stem('name')}) AS base, min(id) AS id FROM al GROUP BY 1),
w AS (SELECT DISTINCT rel_path, target FROM (SELECT rel_path, trim(unnest(regexp_extract_all(text, '{links.WIKI}', 1))) AS target FROM nt) WHERE target <> ''),
i AS (SELECT DISTINCT id FROM al)
SELECT DISTINCT 'note:' || rel_path AS from_id, coalesce(a.id, b.id, ix.id) AS to_id FROM w LEFT JOIN i a ON a.id = 'note:' || target LEFT JOIN i b ON b.id = 'note:' || target || '.md' LEFT JOIN ix ON ix.base = lower({_sql_stem('target')})
WHERE coalesce(a.id, b.id, ix.id) IS NOT NULL"""
)
def wiki_edges(spark, d):
    return links.wiki_edges(_notes(spark, d), _note_nodes(spark, d))


@query(N + f"SELECT lower({_sql_stem('name')}) AS base, min(id) AS id FROM n WHERE type = 'note' GROUP BY 1")
def basename_index(spark, d):
    return links.basename_index(current_nodes(spark, d))


@query(f"WITH {NOTES} SELECT rel_path FROM nt WHERE {_EXT.format('rel_path')} IN ('md', 'markdown', 'mdx') AND NOT starts_with(rel_path, '.campaign/intents/') AND NOT regexp_matches(rel_path, '^festivals/[^/]*/[^/]*/[0-9]{{3}}_[^/]*/.*\\.md$')")
def note_files(spark, d):
    return _notes(spark, d).where(links.is_note(F.col("rel_path"))).select("rel_path")


# Inference.

_CAND = NE + f""", c AS (SELECT id, type, name AS p, metadata AS m FROM n WHERE type IN ('note', 'canvas', 'attachment') AND name <> ''),
g0 AS (
  SELECT 'same_folder' AS source, {_PARENT.format('p')} AS value, id FROM c
  UNION ALL SELECT 'shared_ancestor', unnest([array_to_string({_SEG}[1:i], '/') for i in range(1, greatest(len({_SEG}) - 1, 1))]), id FROM c
  UNION ALL SELECT 'shared_tag', lower(trim(unnest(string_split(m['tags'], ',')))), id FROM c
  UNION ALL SELECT 'shared_tag', lower(substr(to_id, 5)), from_id FROM e WHERE type = 'references' AND to_id LIKE 'tag:%' AND from_id IN (SELECT id FROM c)
  UNION ALL SELECT 'shared_frontmatter', 'type=' || m['type'], id FROM c WHERE m['type'] <> ''
  UNION ALL SELECT 'shared_frontmatter', 'status=' || m['status'], id FROM c WHERE m['status'] <> ''
  UNION ALL SELECT 'shared_frontmatter', 'alias=' || lower(trim(unnest(string_split(m['aliases'], ',')))), id FROM c
  UNION ALL SELECT 'shared_repo_root', m['repo_root'], id FROM c WHERE m['repo_root'] <> ''),
g AS (SELECT DISTINCT * FROM g0 WHERE value IS NOT NULL AND value <> ''),
k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY source, value ORDER BY id) <= 128),
cp AS (SELECT a.id AS from_id, b.id AS to_id, source, value FROM k a JOIN k b USING (source, value) WHERE a.id < b.id) """


def _candidates(spark, d):
    return inference.candidate_pairs(inference.groups(current_nodes(spark, d), unique_edges(spark, d)))


def _candidate_query(source: str):
    QUERIES[f"cand_{source}"] = lambda spark, d: _candidates(spark, d).where(F.col("source") == source).select("from_id", "to_id", "value")
    ORACLES[f"cand_{source}"] = _CAND + f"SELECT from_id, to_id, value FROM cp WHERE source = '{source}'"


for _source in inference.SOURCES:
    _candidate_query(_source)


@query(_CAND + "SELECT source, count(*) AS n_pairs FROM cp GROUP BY source")
def cand_counts(spark, d):
    return _candidates(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_pairs"))


@query(_CAND + "SELECT source, value, count(*) AS n_members FROM g GROUP BY ALL HAVING count(*) > 128")
def cand_truncated(spark, d):
    return inference.capped_groups(inference.groups(current_nodes(spark, d), unique_edges(spark, d)))


@query(_CAND + "SELECT source, value, id, count(*) OVER (PARTITION BY source, value) AS n_members FROM g")
def cand_members(spark, d):
    return inference.memberships(inference.groups(current_nodes(spark, d), unique_edges(spark, d)))


_W = "(VALUES " + ", ".join(f"('{s}', {w}::DECIMAL(9, 3))" for s, w in EVIDENCE_WEIGHTS.items()) + ") AS w(source, weight)"
_INFER = f""", cl AS (SELECT DISTINCT from_id, to_id, source, value FROM {{}} WHERE value <> '' AND from_id < to_id),
pf AS (SELECT id, list_distinct(list_concat({_TOK.format(_sql_stem('name'))}, {_TOK.format("coalesce(metadata['title'], '')")})) AS tok,
  CASE WHEN len(string_split(name, '/')) >= 3 AND string_split(name, '/')[1] = 'projects' THEN array_to_string(string_split(name, '/')[1:2], '/')
       WHEN len(string_split(name, '/')) >= 4 AND string_split(name, '/')[1] = 'festivals' THEN array_to_string(string_split(name, '/')[1:3], '/') END AS owner FROM n),
sh AS (SELECT s.from_id, s.to_id, list_sort(list_intersect(a.tok, b.tok)) AS t, CASE WHEN a.owner = b.owner THEN a.owner END AS o FROM (SELECT DISTINCT from_id, to_id FROM cl) s JOIN pf a ON a.id = s.from_id JOIN pf b ON b.id = s.to_id),
si AS (SELECT * FROM cl UNION SELECT from_id, to_id, 'shared_tokens', array_to_string(t, '+') FROM sh WHERE len(t) >= 3 UNION SELECT from_id, to_id, 'artifact_owned', o FROM sh WHERE o IS NOT NULL),
ac AS (SELECT from_id, to_id, sum(weight)::DOUBLE AS raw, count(*)::INTEGER AS n_reasons, bool_or(si.source = 'shared_tokens') AS tk,
  (list(si.source ORDER BY weight DESC, si.source, value))[1] AS subtype FROM si JOIN {_W} ON w.source = si.source GROUP BY ALL),
co AS (SELECT *, CASE WHEN raw >= 1 THEN 1.0 ELSE 1 - (1 - raw) * (1 - raw) END AS confidence FROM ac)
SELECT from_id, to_id, CASE WHEN tk THEN 'similar_to' ELSE 'relates_to' END AS type, floor(confidence * 1e6 + 0.5) / 1e6 AS confidence, subtype, n_reasons FROM co WHERE confidence >= 0.30"""


def _inferred(df):
    return df.select("from_id", "to_id", "type", (F.floor(F.col("confidence") * 1e6 + 0.5) / 1e6).alias("confidence"), "subtype", "n_reasons")


@query(N + _INFER.format("candidate_pairs"))
def inferred_edges(spark, d):
    """Edges of the stored candidate pairs."""
    return _inferred(inference.inferred_edges(table(spark, d, "candidate_pairs"), current_nodes(spark, d)))


@query(_CAND + _INFER.format("cp"))
def inferred_from_nodes(spark, d):
    """Edges of the pairs that the graph itself proposes."""
    return _inferred(inference.inferred_edges(_candidates(spark, d), current_nodes(spark, d)))


# Refresh and status.

_CUT = "2026-01-01"


def _state(df: DataFrame) -> DataFrame:
    return last_wins(df, "rel_path", "indexed_at", ["mtime_ns", "content_hash"])


@query(f"""WITH a AS (SELECT * FROM indexed_files WHERE rel_path <> '' AND indexed_at < '{_CUT}' QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY indexed_at DESC) = 1),
b AS (SELECT * FROM indexed_files WHERE rel_path <> '' AND indexed_at >= '{_CUT}' QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY indexed_at DESC) = 1)
SELECT coalesce(a.rel_path, b.rel_path) AS rel_path, CASE WHEN a.rel_path IS NULL THEN 'added' WHEN b.rel_path IS NULL THEN 'deleted'
  WHEN a.mtime_ns IS DISTINCT FROM b.mtime_ns AND NOT coalesce(a.content_hash = b.content_hash, false) THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.rel_path = b.rel_path""")
def inventory_diff(spark, d):
    files = table(spark, d, "indexed_files")
    day = F.lit(_CUT).cast("timestamp_ntz")
    return refresh.inventory_diff(_state(files.where(F.col("indexed_at") < day)), _state(files.where(F.col("indexed_at") >= day)))


@query(f"WITH {NOTES} SELECT rel_path, 'note:' || rel_path AS node_id, sha256(text) AS content_hash, 'note' AS parser_kind, 'folder:' || {_PARENT.format('rel_path')} AS scope_id FROM nt")
def fingerprints(spark, d):
    return refresh.fingerprints(_notes(spark, d).withColumnRenamed("text", "content"))


_COUNTED = ["nodes", "edges", "search_docs", "indexed_files"]


@query(
    "SELECT key, max(value) AS value FROM graph_meta GROUP BY key UNION ALL SELECT 'stale', ((SELECT count(*) FROM nodes) > 0 AND coalesce((SELECT max(value) FROM graph_meta WHERE key = 'last_refresh_at'), '') = '')::VARCHAR"
    + "".join(f" UNION ALL SELECT '{t}_count', count(*)::VARCHAR FROM {t}" for t in _COUNTED)
)
def status_counts(spark, d):
    return refresh.status(table(spark, d, "graph_meta"), {t: table(spark, d, t) for t in _COUNTED})


# The ledger, told by the events table: users stand for intents.

_KIND = {"signup": "created", "view": "transitioned", "purchase": "completed", "click": "evidence_attached", "error": "error"}


def _events(spark, d):
    e = table(spark, d, "events")
    kind = F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("bigint")
    nothing = F.lit(None).cast("string")
    scope = F.struct(*[(F.concat(F.lit("u"), F.col("user_id").cast("string")) if c == "intent" else nothing).alias(c) for c in ("campaign", "festival", "phase", "sequence", "task", "intent", "workitem", "quest")])
    ev = F.struct(F.lit("path").alias("type"), nothing.alias("repo"), nothing.alias("sha"), F.concat(F.lit("out/"), (k % 20).cast("string")).alias("path"), nothing.alias("url"))
    return e.select(
        F.lit(1).alias("v"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), kind.alias("kind"),
        F.concat(F.lit("a"), (F.col("event_id") % 500).cast("string")).alias("action"), scope.alias("scope"), F.lit(None).cast("struct<type:string,name:string>").alias("actor"), nothing.alias("why"),
        F.to_json(F.struct(F.when(F.col("event_type") == "view", F.concat(F.lit("dungeon/s"), (k % 4).cast("string"))).alias("to"))).alias("payload"),
        F.when(F.col("event_type") == "click", F.array(ev)).alias("evidence"), F.when(F.col("user_id") % 2 == 0, "command").otherwise("backfill").alias("source"),
    )


def _ledger(spark, d):
    events = ledger.prepared(_events(spark, d))
    nodes = table(spark, d, "events").select(F.concat(F.lit("intent:u"), F.col("user_id").cast("string")).alias("id"), F.lit("intent").alias("type"), F.lit("").alias("name")).distinct()
    return ledger.resolved(events, nodes), nodes


@query("SELECT 'read' AS outcome, count(*) AS n_events FROM events UNION ALL SELECT 'applied', count(*) FROM events WHERE event_type <> 'error' UNION ALL SELECT 'unknown', count(*) FROM events WHERE event_type = 'error'")
def ledger_report(spark, d):
    return ledger.report(_events(spark, d))


@query("""WITH t AS (SELECT 'intent:u' || user_id AS artifact, ts, event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 's' || ((json_extract_string(props, '$.k')::BIGINT) % 4) END AS told FROM events WHERE event_type IN ('signup', 'view', 'purchase'))
SELECT artifact, (list(told ORDER BY ts DESC, event_id DESC) FILTER (told IS NOT NULL))[1] AS status, min(ts) AS created_at, max(ts) AS updated_at FROM t GROUP BY artifact""")
def ledger_status(spark, d):
    out = ledger.artifact_status(_ledger(spark, d)[0])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


@query("""SELECT 'action:a' || (event_id % 500) AS id, min(ts) AS created_at, max(ts) AS updated_at FROM events WHERE event_type = 'click' GROUP BY 1""")
def ledger_actions(spark, d):
    return ledger.actions(ledger.prepared(_events(spark, d))).select("id", F.col("created_at").cast("timestamp_ntz"), F.col("updated_at").cast("timestamp_ntz"))


@query("""WITH x AS (SELECT 'action:a' || (event_id % 500) AS from_id, 'out/' || ((json_extract_string(props, '$.k')::BIGINT) % 20) AS note, ts, event_id, user_id FROM events WHERE event_type = 'click')
SELECT from_id, 'file:' || note AS to_id, 'path' AS subtype, note, CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN user_id % 2 = 0 THEN 'ledger' ELSE 'inferred' END AS source
FROM x QUALIFY row_number() OVER (PARTITION BY from_id, note ORDER BY ts, event_id) = 1""")
def ledger_produced(spark, d):
    return ledger.produced(*_ledger(spark, d)).drop("created_at")


# The same table told as a workspace's whole ledger: every scope, kind of event and evidence.

_TOLD = """WITH x AS (SELECT event_id AS id, ts, event_type AS et, json_extract_string(props, '$.k')::BIGINT AS k, user_id AS u, user_id % 5 AS m, user_id % 50 AS f FROM events),
y AS (SELECT *, CASE m WHEN 0 THEN 'intent:u' || u WHEN 1 THEN 'festival:fest-F' || f || CASE WHEN f % 2 = 0 THEN '/p1' ELSE '' END
    WHEN 2 THEN CASE WHEN u % 4 < 2 THEN 'design_doc:w' ELSE 'explore_doc:w' END || u WHEN 3 THEN 'folder:.campaign/quests/q' || (u % 9) END AS art,
  CASE et WHEN 'signup' THEN CASE WHEN k % 5 = 0 THEN 'decided' ELSE 'created' END WHEN 'view' THEN 'transitioned' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'evidence_attached'
    ELSE CASE k % 3 WHEN 0 THEN 'repaired' WHEN 1 THEN 'created' ELSE 'reconciled' END END AS kind, u % 2 = 1 OR (et = 'error' AND k % 3 = 1) AS weak FROM x),
z AS (SELECT *, CASE m WHEN 0 THEN 'folder:.campaign/intents' WHEN 1 THEN CASE WHEN f % 2 = 0 THEN 'festival:fest-F' || f END WHEN 2 THEN 'folder:.' WHEN 3 THEN 'folder:.campaign/quests' END AS parent,
  CASE WHEN weak THEN 0.7 ELSE 1.0 END::DOUBLE AS conf, CASE WHEN weak THEN 'inferred' ELSE 'ledger' END AS src, 'action:a' || (id % 500) AS act FROM y)
"""


def _whole_ledger(spark, d):
    """Events of the events table with every scope, and the nodes of the workspace they belong to."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn("m", F.col("user_id") % 5)
    nothing, text = F.lit(None).cast("string"), lambda c: c.cast("string")
    u, f, k, et = text(F.col("user_id")), text(F.col("user_id") % 50), F.col("k"), F.col("event_type")
    of = {
        "intent": F.when(F.col("m") == 0, F.concat(F.lit("u"), u)), "festival": F.when(F.col("m") == 1, F.concat(F.lit("F"), f)), "phase": F.when(F.col("m") == 1, "p1"),
        "workitem": F.when(F.col("m") == 2, F.concat(F.lit("w"), u)), "quest": F.when(F.col("m") == 3, F.concat(F.lit("q"), text(F.col("user_id") % 9))),
    }
    scope = F.struct(*[of.get(c, nothing).alias(c) for c in ("campaign", "festival", "phase", "sequence", "task", "intent", "workitem", "quest")])
    kind = (
        F.when(et == "signup", F.when(k % 5 == 0, "decided").otherwise("created")).when(et == "view", "transitioned").when(et == "purchase", "completed").when(et == "click", "evidence_attached")
        .otherwise(F.when(k % 3 == 0, "repaired").otherwise("reconciled"))
    )
    said = F.struct(
        F.when(et == "view", F.concat(F.lit("s"), text(k % 4))).alias("from"), F.when(et == "view", F.concat(F.lit("dungeon/s"), text(k % 3))).alias("to"), F.when((et == "error") & (k % 3 == 1), "created").alias("kind"),
        F.when(et == "error", F.concat(F.lit("n"), text(k))).alias("note"), F.when(et == "signup", F.concat(F.lit("d"), text(k))).alias("because_of"), F.when((et == "view") & (k % 7 == 0), F.concat(F.lit("festivals/active/fest-F"), text(k % 50))).alias("promoted_to"),
    )
    sort = F.element_at(F.array(F.lit("path"), F.lit("commit"), F.lit("url")), (k % 3 + 1).cast("int"))
    ev = F.struct(
        sort.alias("type"), F.when(sort == "commit", F.concat(F.lit("r"), text(k % 4))).alias("repo"), F.when(sort == "commit", F.concat(F.lit("c"), text(k))).alias("sha"),
        F.when(sort == "path", F.concat(F.lit("out/"), text(k % 20))).alias("path"), F.when(sort == "url", F.concat(F.lit("https://x/"), text(k))).alias("url"),
    )
    events = e.select(
        F.lit(1).alias("v"), F.lpad(text(F.col("event_id")), 12, "0").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), kind.alias("kind"), F.concat(F.lit("a"), text(F.col("event_id") % 500)).alias("action"),
        scope.alias("scope"), F.lit(None).cast("struct<type:string,name:string>").alias("actor"), F.when(k % 11 == 0, F.concat(F.lit("why"), text(k))).alias("why"), F.to_json(said).alias("payload"), F.when(et == "click", F.array(ev)).alias("evidence"),
        F.when(F.col("user_id") % 2 == 0, "command").otherwise("backfill").alias("source"),
    )
    each = e.select("user_id", "m", f.alias("f")).distinct()
    node = lambda df, i, t, n: df.select(i.alias("id"), F.lit(t).alias("type"), n.alias("name"))
    docs, fest = each.where("m = 2"), each.select("f").distinct().union(spark.range(50).select(text(F.col("id")))).distinct()
    fixed = [("folder:.", "folder", "."), ("folder:.campaign/intents", "folder", ""), ("folder:.campaign/quests", "folder", ""), ("repo:projects/r0", "repo", ""), ("project:r1", "project", "r1")] + [(f"folder:.campaign/quests/q{n}", "folder", "") for n in range(9)]
    name = F.concat(F.lit("fest-F"), "f")
    nodes = [
        node(each.where("m = 0"), F.concat(F.lit("intent:u"), text(F.col("user_id"))), "intent", F.lit("")), node(fest, F.concat(F.lit("festival:"), name), "festival", name),
        node(fest.where("f % 2 = 0"), F.concat(F.lit("festival:"), name, F.lit("/p1")), "phase", F.lit("p1")),
        node(docs.where("user_id % 4 < 2"), F.concat(F.lit("design_doc:w"), text(F.col("user_id"))), "design_doc", F.lit("")), node(docs.where("user_id % 4 >= 2"), F.concat(F.lit("explore_doc:w"), text(F.col("user_id"))), "explore_doc", F.lit("")),
        spark.createDataFrame(fixed, "id string, type string, name string"),
    ]
    every = nodes[0]
    for x in nodes[1:]:
        every = every.unionByName(x)
    every = cut(every)
    return cut(ledger.resolved(ledger.prepared(events), every)), every  # resolved once for all kinds of edges


@query(_TOLD + """, c AS (
  SELECT parent AS from_id, art AS to_id, 'contains' AS type, conf, src, kind AS subtype,
    CASE kind WHEN 'transitioned' THEN 's' || (k % 4) || '->dungeon/s' || (k % 3) WHEN 'completed' THEN 'completed' WHEN 'created' THEN '' ELSE 'n' || k END AS note, ts, id
  FROM z WHERE kind NOT IN ('decided', 'evidence_attached') AND parent IS NOT NULL
  UNION ALL SELECT art, 'decision:' || lpad(id::VARCHAR, 12, '0'), 'contains', conf, src, '', '', ts, id FROM z WHERE kind = 'decided' AND art IS NOT NULL
  UNION ALL SELECT 'decision:' || lpad(id::VARCHAR, 12, '0'), 'decision:d' || k, 'because_of', conf, 'explicit', '', '', ts, id FROM z WHERE kind = 'decided'
  UNION ALL SELECT art, act, 'relates_to', conf, src, '', '', ts, id FROM z WHERE kind = 'evidence_attached' AND art IS NOT NULL
  UNION ALL SELECT art, 'festival:fest-F' || (k % 50), 'promoted_to', conf, src, '', '', ts, id FROM z WHERE et = 'view' AND k % 7 = 0 AND art IS NOT NULL
  UNION ALL SELECT act, CASE k % 3 WHEN 0 THEN 'file:out/' || (k % 20) WHEN 1 THEN CASE k % 4 WHEN 0 THEN 'repo:projects/r0' WHEN 1 THEN 'project:r1' ELSE coalesce(art, 'folder:.') END ELSE coalesce(art, 'folder:.') END,
    'produced', conf, src, CASE k % 3 WHEN 0 THEN 'path' WHEN 1 THEN 'commit' ELSE 'url' END, CASE k % 3 WHEN 0 THEN 'out/' || (k % 20) WHEN 1 THEN 'r' || (k % 4) || '@c' || k ELSE 'https://x/' || k END, ts, id FROM z WHERE kind = 'evidence_attached'),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY from_id, to_id, type ORDER BY ts, id) = 1),
fx AS (SELECT act, max((ts, id)) AS fix FROM z WHERE kind = 'repaired' GROUP BY act)
SELECT from_id, to_id, type, subtype, CASE WHEN type = 'produced' AND fx.fix > (ts, id) AND note <> '' THEN note || ' (repaired)' ELSE note END AS note,
  CASE WHEN type = 'produced' AND fx.fix > (ts, id) THEN 1.0 ELSE conf END::DOUBLE AS confidence, src AS source, ts AS created_at FROM o LEFT JOIN fx ON fx.act = o.from_id""")
def ledger_edges(spark, d):
    """All edges a ledger tells."""
    out = ledger.told_edges(*_whole_ledger(spark, d))
    return out.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query(_TOLD + """, q AS (SELECT * FROM z WHERE kind = 'evidence_attached'),
a AS (SELECT act, min(ts) AS created_at, max(ts) AS seen, min((ts, id)) AS first, (list(CASE WHEN k % 11 = 0 THEN 'why' || k ELSE substr(act, 8) END ORDER BY ts, id))[1] AS name,
  (list('why' || k ORDER BY ts, id) FILTER (k % 11 = 0))[1] AS why FROM q GROUP BY act),
r AS (SELECT z.act, max(ts) AS fixed, string_agg('n' || k, '; ' ORDER BY ts, id) AS repair_note FROM z JOIN a ON a.act = z.act AND (z.ts, z.id) > a.first WHERE kind = 'repaired' GROUP BY z.act)
SELECT a.act AS id, name, why, a.created_at, greatest(seen, fixed) AS updated_at, fixed IS NOT NULL AS repaired, coalesce(repair_note, '') AS repair_note FROM a LEFT JOIN r ON r.act = a.act""")
def ledger_action_facts(spark, d):
    """Actions with what repaired them."""
    out = ledger.actions(_whole_ledger(spark, d)[0])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


@query(_TOLD + """SELECT art AS artifact, (list(CASE kind WHEN 'completed' THEN 'completed' WHEN 'transitioned' THEN 's' || (k % 3) END ORDER BY ts DESC, id DESC) FILTER (kind IN ('completed', 'transitioned')))[1] AS status,
  min(ts) AS created_at, max(ts) AS updated_at FROM z WHERE art IS NOT NULL AND kind NOT IN ('decided', 'evidence_attached') GROUP BY art""")
def ledger_artifacts(spark, d):
    """The state of artifacts of every kind."""
    out = ledger.artifact_status(_whole_ledger(spark, d)[0])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


def _log_lines(spark, d):
    """Event lines that documents hold, wherever in their text, as events of the document's time."""
    docs = table(spark, d, "documents").where("rel_path is not null")
    lines = docs.select("updated_at", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^\s*\{"))
    schema = "v int, id string, kind string, why string, scope struct<festival:string>"
    e = lines.select("updated_at", F.from_json("line", schema).alias("e")).where("e.id is not null").select("e.*", "updated_at")
    nothing = F.lit(None).cast("string")
    return e.select("v", "id", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "kind", nothing.alias("action"), "scope", "why", nothing.alias("payload"), F.lit(None).cast("array<struct<type:string,repo:string,sha:string,path:string,url:string>>").alias("evidence"), nothing.alias("source"))


@query(f"""WITH {NOTES}, l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM nt), v AS (SELECT CASE WHEN regexp_matches(line, '^\\s*\\{{') AND json_valid(line) THEN line END AS line FROM l),
j AS (SELECT json_extract_string(line, '$.id') AS id, json_extract_string(line, '$.kind') AS kind, json_extract_string(line, '$.why') AS why FROM v WHERE line IS NOT NULL)
SELECT DISTINCT 'decision:' || id AS id, coalesce(nullif(why, ''), id) AS name FROM j WHERE kind = 'decided' AND id IS NOT NULL""")
def ledger_decisions(spark, d):
    """Of all documents, wherever in their text an event stands."""
    return ledger.decisions(ledger.prepared(_log_lines(spark, d))).select("id", "name")


@query(
    f"""WITH {EDGES_SQL}, s AS (SELECT * FROM e WHERE source <> 'ledger'), t AS (SELECT DISTINCT ON (from_id, to_id, type) from_id, to_id, type FROM e WHERE source = 'structural')
SELECT s.from_id, s.to_id, s.type, CASE WHEN t.from_id IS NOT NULL AND s.source = 'structural' THEN 'ledger' ELSE s.source END AS source, coalesce(nullif(s.subtype, ''), CASE WHEN t.from_id IS NOT NULL THEN 'created' END, '') AS subtype FROM s LEFT JOIN t USING (from_id, to_id, type)"""
)
def ledger_edge_merge(spark, d):
    """Structural edges told again by a ledger."""
    edges = unique_edges(spark, d).where("source != 'ledger'")
    told = edges.where("source = 'structural'").withColumns({"source": F.lit("ledger"), "subtype": F.lit("created")})
    return ledger.merge_edges(edges, told).select("from_id", "to_id", "type", "source", "subtype")


@query(NE + "SELECT (from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)) AS kept, count(*) AS n_edges FROM e GROUP BY 1")
def dangling_edges(spark, d):
    good, bad = ledger.without_dangling(unique_edges(spark, d), current_nodes(spark, d))
    counts = [x.agg(F.count(F.lit(1)).alias("n_edges")).select(F.lit(k).alias("kept"), "n_edges") for x, k in ((good, True), (bad, False))]
    return counts[0].unionAll(counts[1]).where("n_edges > 0")
