"""From a workspace to a graph: nodes, edges, search documents and fingerprints as DataFrames."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import paths as p
from lodegraph.model import INDEXED_TYPES, SCHEMA_VERSION
from lodegraph.operators import inference, ledger, links, metadata, refresh, scopes, search
from lodegraph.session import cut
from lodegraph.sources import workspace
from lodegraph.sources.store import Store

# Where artifacts lie (folder or file, pattern of the path, type).
ARTIFACTS = [
    (True, r"^projects/[^/.][^/]*$", "project"),
    (True, r"^festivals/(?:active|planning|ready|ritual|dungeon/completed|dungeon/archived|dungeon/someday)/[^/.][^/]*$", "festival"),
    (True, r"^festivals/(?:dungeon/)?[^/]+/[^/.][^/]*/[0-9]{3}_[^/]*$", "phase"),
    (True, r"^festivals/(?:dungeon/)?[^/]+/[^/.][^/]*/[0-9]{3}_[^/]*/[^/.][^/]*$", "sequence"),
    (False, r"^festivals/(?:dungeon/)?[^/]+/[^/.][^/]*/[0-9]{3}_[^/]*/[^/.][^/]*/(?!SEQUENCE_GOAL\.md$)[^/]+\.md$", "task"),
    (False, r"^\.campaign/intents/(?:inbox|active|ready|dungeon/[^/.][^/]*)/[^/]+\.md$", "intent"),
    (True, r"^workflow/design/[^/.][^/]*$", "design_doc"),
    (True, r"^workflow/explore/[^/.][^/]*$", "explore_doc"),
]
BRIDGED = ["project", "festival", "intent", "design_doc", "explore_doc", "chain"]


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    docs: DataFrame
    files: DataFrame
    report: dict[str, int] = field(default_factory=dict)  #: what the ledger told
    truncated: bool = False  #: whether inference left pairs out


def artifacts(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name, rel, status) of artifacts by where they lie, and the containment of festival steps."""
    rel, kind = F.col("rel_path"), None
    for is_dir, pattern, t in ARTIFACTS:
        hit = (F.col("is_dir") == is_dir) & rel.rlike(pattern)
        kind = F.when(hit, t) if kind is None else kind.when(hit, t)
    found = entries.withColumn("type", kind).where("type is not null")
    stage = F.when(F.col("type") == "festival", p.basename(p.parent(rel))).when(F.col("type") == "intent", p.basename(p.parent(rel))).otherwise("")
    step = F.concat(F.lit("festival:"), F.regexp_replace(rel, r"^festivals/(?:dungeon/)?[^/]+/", ""))
    node_id = F.when(F.col("type").isin("festival", "phase", "sequence", "task"), step).when(F.col("type") == "intent", F.concat(F.lit("intent:"), p.stem(rel))).otherwise(F.concat("type", F.lit(":"), p.basename(rel)))
    nodes = found.select(node_id.alias("id"), "type", p.basename(rel).alias("name"), rel.alias("rel"), stage.alias("status")).groupBy("id").agg(F.max(F.struct("rel", "type", "name", "status")).alias("r")).select("id", "r.type", "r.name", "r.rel", "r.status")
    inner = nodes.where("type in ('phase', 'sequence', 'task')").select(F.regexp_extract("id", "^(.*)/[^/]*$", 1).alias("from_id"), F.col("id").alias("to_id"))
    return nodes, inner.join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi")


def _edge(df: DataFrame, kind: str, source: str, confidence: float = 1.0, subtype: Column | None = None) -> DataFrame:
    return df.select("from_id", "to_id", F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), (F.lit("") if subtype is None else subtype).alias("subtype"), F.lit("").alias("note"))


def build(root: str, entries: DataFrame, texts: DataFrame, boundaries: DataFrame, events: DataFrame | None = None, cap: int | None = inference.GROUP_CAP, budget: int | None = inference.PAIR_BUDGET) -> Graph:
    """The graph of a workspace from its inventory, texts (rel_path, text) and repositories, and the ledger's events.

    Each pass is cut off from those before it, so that a plan holds one pass only and nothing is derived twice. ``cap`` and
    ``budget`` bound inference as the store's format has it; None lets whole groups and all pairs through.
    """
    files = entries.where("not is_dir")
    now = F.current_timestamp()
    under = lambda rel: F.concat(F.lit(root + "/"), rel)
    state = F.col("git_state")

    folder_rows = scopes.folders(entries, "rel_path").unionByName(boundaries.where("not is_root").select(F.col("rel_path").alias("folder"), p.parent(F.col("rel_path")).alias("parent"))).distinct()
    folder_rows = cut(folder_rows)
    kinds = scopes.folder_kinds(folder_rows.select("folder").distinct().unionByName(entries.sparkSession.createDataFrame([(".",)], "folder string")), boundaries.where("not is_root"))
    fid = F.concat(F.lit("folder:"), "folder")
    none = F.lit(None).cast("map<string,string>")
    meta = F.create_map(F.lit("scope_kind"), F.col("kind"), F.lit("path_depth"), p.depth(F.col("folder")).cast("string"))
    folder_nodes = kinds.select(fid.alias("id"), F.lit("folder").alias("type"), F.col("folder").alias("name"), F.when(F.col("folder") == ".", root).otherwise(under(F.col("folder"))).alias("path"), F.lit("").alias("status"), meta.alias("metadata"))
    repo_nodes = boundaries.where("not is_root").select(F.concat(F.lit("repo:"), "rel_path").alias("id"), F.lit("repo").alias("type"), F.col("rel_path").alias("name"), F.col("abs_path").alias("path"), F.lit("").alias("status"), F.create_map(F.lit("is_submodule"), F.col("is_submodule").cast("string")).alias("metadata"))

    # Repositories are no entries of the one around them, but may be projects.
    places = entries.select("rel_path", "is_dir").unionByName(boundaries.where("not is_root").select("rel_path", F.lit(True).alias("is_dir")))
    art, steps = map(cut, artifacts(places))
    art_nodes = art.select("id", "type", "name", under(F.col("rel")).alias("path"), "status", none.alias("metadata"))

    note_files = files.where(links.is_note(F.col("rel_path"))).select("rel_path", "git_state", "repo_root")
    note_texts = texts.join(note_files.select("rel_path"), "rel_path", "left_semi")
    rel_repo = F.when(F.col("repo_root") == root, ".").otherwise(F.expr(f"substring(repo_root, {len(root) + 2})"))
    own = F.create_map(F.lit("git_state"), state, F.lit("repo_root"), rel_repo)
    notes = note_files.join(links.note_metadata(note_texts), "rel_path").select(
        F.concat(F.lit("note:"), "rel_path").alias("id"), F.lit("note").alias("type"), F.col("rel_path").alias("name"), under(F.col("rel_path")).alias("path"), F.lit("").alias("status"), F.map_concat(own, "metadata").alias("metadata")
    )
    notes = cut(notes)
    canvases = texts.where(p.extension(F.col("rel_path")) == "canvas").where(links.is_json(F.col("text")))
    canvas_nodes = canvases.select(F.concat(F.lit("canvas:"), "rel_path").alias("id"), F.lit("canvas").alias("type"), F.col("rel_path").alias("name"), under(F.col("rel_path")).alias("path"), F.lit("").alias("status"), none.alias("metadata"))

    targets = notes.select("id", "type", "name").unionByName(canvas_nodes.select("id", "type", "name"))
    bodies = note_texts.select("rel_path", links.body_of(F.col("text")).alias("text"))
    link_rows = cut(links.link_edges(bodies, targets))
    tag_rows = links.inline_tags(note_texts).select(F.concat(F.lit("note:"), "rel_path").alias("from_id"), F.concat(F.lit("tag:"), "tag").alias("to_id"))
    tag_rows = cut(tag_rows)
    tag_nodes = tag_rows.select(F.col("to_id").alias("id")).distinct().select("id", F.lit("tag").alias("type"), F.expr("substring(id, 5)").alias("name"), F.lit("").alias("path"), F.lit("").alias("status"), none.alias("metadata"))
    new = link_rows.where("subtype = 'attachment'").select(F.col("to_id").alias("id")).distinct()
    att = new.select("id", F.lit("attachment").alias("type"), F.expr("substring(id, 12)").alias("name"), under(F.expr("substring(id, 12)")).alias("path"), F.lit("").alias("status"), none.alias("metadata"))

    nested = files.where(F.col("repo_root") != root)
    code_nodes, code_edges = scopes.code_slices(scopes.code_files(nested.join(texts.select("rel_path", F.col("text").alias("content")), "rel_path"), "rel_path"))
    code = code_nodes.select("id", "type", "name", F.when(F.col("type") == "file", under(F.col("name"))).otherwise("").alias("path"), F.lit("").alias("status"), none.alias("metadata"))

    # Of equal ids the later pass counts.
    passes = [folder_nodes, repo_nodes, art_nodes, notes, canvas_nodes, att, tag_nodes, code]
    columns = ["id", "type", "name", "path", "status", "metadata"]
    every = reduce(DataFrame.unionByName, [df.select(*columns, F.lit(n).alias("_p")) for n, df in enumerate(passes)])
    nodes = every.groupBy("id").agg(F.max_by(F.struct(*columns[1:]), "_p").alias("r")).select("id", "r.*")
    nodes = cut(nodes)

    placed = nodes.where(F.col("type").isin("note", "canvas")).select("id", F.col("name").alias("rel")).unionByName(art.where(F.col("type").isin(BRIDGED)).select("id", "rel"))
    near = scopes.nearest_ancestor(placed, "id", "rel", folder_rows.select("folder")).select(F.concat(F.lit("folder:"), "folder").alias("from_id"), F.col("id").alias("to_id"))
    contain = reduce(
        DataFrame.unionByName,
        [folder_rows.select(F.concat(F.lit("folder:"), "parent").alias("from_id"), fid.alias("to_id")), boundaries.where("not is_root").select(F.concat(F.lit("repo:"), "rel_path").alias("from_id"), F.concat(F.lit("folder:"), "rel_path").alias("to_id")), steps.select("from_id", "to_id"), near, code_edges],
    ).distinct()
    explicit = [
        _edge(link_rows, "links_to", "explicit", subtype=F.col("subtype")),
        _edge(links.wiki_edges(bodies, targets), "links_to", "explicit", subtype=F.lit("wiki_link")),
        _edge(tag_rows, "references", "explicit", subtype=F.lit("inline_tag")),
        _edge(links.canvas_edges(canvases, targets.unionByName(att.select("id", "type", "name"))), "links_to", "explicit", subtype=F.lit("canvas_link")),
    ]
    edges = reduce(DataFrame.unionByName, [_edge(contain, "contains", "structural"), *explicit])
    edges = edges.groupBy("from_id", "to_id", "type").agg(F.min(F.struct("subtype", "confidence", "source", "note")).alias("r")).select("from_id", "to_id", "type", "r.confidence", "r.source", "r.subtype", "r.note")
    edges = cut(edges)
    members = cut(inference.groups(nodes, edges))
    short = inference.truncated(members, cap, budget)
    inferred = inference.inferred_edges(inference.candidate_pairs(members, cap, budget), nodes).select(edges.columns)
    # Cut off, or filters on what Python finds in them would be pushed below the joins, to all texts.
    fest_files = cut(texts.join(art.where("type = 'festival'").select("id", F.concat("rel", F.lit("/fest.yaml")).alias("rel_path")), "rel_path").select("id", "text"))
    intent_files = cut(texts.join(art.where("type = 'intent'").select("id", F.col("rel").alias("rel_path")), "rel_path").select("id", "text"))
    stated = metadata.festival_edges(fest_files, nodes).unionByName(metadata.intent_edges(intent_files, nodes)).withColumn("note", F.lit("")).select(edges.columns)
    # Of equal (from, to, type) the earlier pass counts.
    key = ["from_id", "to_id", "type"]
    ranked = reduce(DataFrame.unionByName, [df.withColumn("_p", F.lit(n)) for n, df in enumerate((edges, inferred, stated))])
    rest = [c for c in edges.columns if c not in key]
    edges = ranked.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("_p", *rest)).alias("r")).select(*key, "r.*").withColumn("created_at", now)
    edges, report = cut(edges), {}

    if events is not None:
        aliases = ledger.workitem_aliases(metadata.work_items(texts.where(p.basename(F.col("rel_path")) == ".workitem")))
        told = cut(ledger.resolved(ledger.prepared(events), nodes, aliases))
        seen = ledger.artifact_status(told).select(F.col("artifact").alias("id"), F.col("status").alias("_s"), F.col("created_at").alias("_c"), F.col("updated_at").alias("_u"))
        before = nodes
        dated = nodes.join(seen, "id", "left").withColumns({"status": F.coalesce("_s", "status"), "created_at": F.least(now, "_c"), "updated_at": F.coalesce("_u", now)}).drop("_s", "_c", "_u")
        nodes = cut(dated.unionByName(ledger.told_nodes(told)))
        told_edges = cut(ledger.told_edges(told, nodes))
        scanned = edges
        edges = cut(ledger.merge_edges(edges, told_edges))
        made = told_edges.where("type = 'produced' and to_id like 'file:%'").groupBy(F.col("to_id").alias("id")).agg(F.min("created_at").alias("created_at")).join(nodes.select("id"), "id", "left_anti")
        name = F.expr("substring(id, 6)")
        nodes = nodes.unionByName(made.select("id", F.lit("file").alias("type"), name.alias("name"), under(name).alias("path"), F.lit("").alias("status"), none.alias("metadata"), "created_at", F.col("created_at").alias("updated_at")))
        nodes = cut(nodes)
        counts = {r["outcome"]: r["n_events"] for r in ledger.report(events).collect()}
        report = {
            "events_read": counts["read"], "events_applied": counts["applied"], "events_skipped": counts["read"] - counts["applied"], "unknown_kinds": counts["unknown"],
            "nodes_added": nodes.join(before.select("id"), "id", "left_anti").count(), "edges_added": edges.join(scanned.select(*key), key, "left_anti").count(),
        }
    else:
        nodes = nodes.withColumns({"created_at": now, "updated_at": now})
    edges, _ = ledger.without_dangling(edges, nodes)
    prints = refresh.fingerprints(texts.withColumnRenamed("text", "content")).join(files.select("rel_path", rel_repo.alias("repo_root"), F.col("git_state").alias("tracked_state"), "mtime_ns"), "rel_path").withColumn("indexed_at", now)
    return Graph(nodes, edges, search_docs(root, nodes, texts), prints, report, short)


def search_docs(root: str, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The documents of the nodes that can be searched: notes by their whole text, artifacts by name, status and type, and their file if they have one."""
    meta = F.col("metadata")
    rel = F.when(F.col("type") == "note", F.col("name")).when(F.col("path").startswith(root + "/"), F.expr(f"substring(path, {len(root) + 2})")).otherwise(F.col("name"))
    base = F.concat_ws("\n", "name", F.when(F.col("status") != "", F.concat(F.lit("status: "), "status")), F.concat(F.lit("type: "), "type"))
    rows = nodes.where(F.col("type").isin(INDEXED_TYPES)).withColumn("rel_path", rel).join(texts, "rel_path", "left")
    body = F.when(F.col("type") == "note", F.col("text")).otherwise(F.concat_ws("\n", base, "text"))
    return rows.select(
        F.col("id").alias("node_id"), p.first_of(meta["title"], F.col("name")).alias("title"), "rel_path", p.parent(F.col("rel_path")).alias("scope"), body.alias("body"), F.lit("").alias("summary"),
        p.split_canonical(meta["aliases"]).alias("aliases"), p.split_canonical(meta["tags"]).alias("tags"),
        p.first_of(meta["git_state"], F.when(F.col("type") == "note", "unknown").otherwise("tracked")).alias("tracked_state"), F.current_timestamp().alias("updated_at"),
    )


def build_workspace(spark: SparkSession, root: str, store: Store, probe=workspace.git_states, mode: str = "rebuild") -> dict[str, int]:
    """Scan a workspace and save its graph; the counts saved."""
    listed = workspace.tree(spark, root)
    entries = cut(workspace.inventory(spark, root, probe=probe, listed=listed))
    bounds = cut(workspace.boundaries(spark, root, listed))
    base = bounds.where("is_root").first()["abs_path"]
    kept = entries.where("not is_dir").select("rel_path")
    # Read once from the many small files; every pass works on the copy.
    texts = cut(workspace.texts(spark, root, "*").join(kept, "rel_path", "left_semi"))
    events, bad = workspace.events(spark, root)
    unread = bad.count()
    graph = build(base, entries, texts, bounds, events)
    docs = cut(graph.docs)
    index = search.build_index(docs)
    meta = {"graph_schema_version": SCHEMA_VERSION, "campaign_root": base, "last_refresh_mode": mode, "last_refresh_at": "now", "unreadable_lines": str(unread), "inference_truncated": str(graph.truncated).lower()}
    rows = spark.createDataFrame(list(meta.items()), "key string, value string").withColumn("value", F.when(F.col("key") == "last_refresh_at", p.format_time(F.current_timestamp())).otherwise(F.col("value")))
    store.save(nodes=graph.nodes, edges=graph.edges, search_docs=docs, indexed_files=graph.files, graph_meta=rows, postings=index.by_term(), sizes=index.sizes)
    store.set_meta(search_available=str(search.available(stored_index(store))).lower())
    return _written(store) | {"ledger": graph.report | {"read_skipped_lines": unread}, "truncated": graph.truncated}


def stored_index(store: Store) -> search.Index:
    """The index of a store, as the last build wrote it."""
    return search.Index(store.read("search_docs"), store.read("postings"), store.read("sizes"), True)


def _written(store: Store) -> dict[str, int]:
    return {t: store.read(t).count() for t in ("nodes", "edges", "search_docs", "indexed_files")}


def refresh_workspace(spark: SparkSession, root: str, store: Store, probe=workspace.git_states) -> dict:
    """Bring a store up to date: nothing but the meta changes if no file does, else everything is built again; ``reindexed`` are then all files."""
    began = time.monotonic()

    def told(mode: str, stale: bool, diff: dict, rest: dict, built: bool) -> dict:
        return {"mode": mode, "stale_before": stale, "stale_after": False, **diff, "reindexed": rest["indexed_files"] if built else 0, **rest, "duration_ms": int(1000 * (time.monotonic() - began))}

    if store.version() != SCHEMA_VERSION or store.read("nodes").isEmpty():
        return told("rebuild", True, {"added": 0, "changed": 0, "deleted": 0}, build_workspace(spark, root, store, probe), True)
    prior = store.read("indexed_files").select("rel_path", "mtime_ns", "content_hash")
    listed = workspace.inventory(spark, root, probe=probe).where("not is_dir").select("rel_path", "mtime_ns")
    # Only files with another time are read and hashed.
    touched = refresh.to_hash(prior, listed).select("rel_path")
    hashes = workspace.texts(spark, root, "*").join(F.broadcast(touched) if touched.count() < 100_000 else touched, "rel_path", "left_semi").select("rel_path", F.sha2("text", 256).alias("_h"))
    now = listed.join(hashes, "rel_path", "left").join(prior.select("rel_path", F.col("content_hash").alias("_o")), "rel_path", "left").select("rel_path", "mtime_ns", F.coalesce("_h", "_o").alias("content_hash"))
    changes = {r["change"]: r["count"] for r in refresh.inventory_diff(prior, now).groupBy("change").count().collect()}
    diff = {k: changes.get(k, 0) for k in ("added", "changed", "deleted")}
    if any(diff.values()):
        return told("refresh", True, diff, build_workspace(spark, root, store, probe, "refresh"), True)
    store.set_meta(last_refresh_mode="refresh", last_refresh_at=spark.range(1).select(p.format_time(F.current_timestamp()).alias("t")).first()["t"])
    return told("refresh", False, diff, _written(store), False)
