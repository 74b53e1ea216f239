"""Ingestion of a ledger of events (see ``model.EVENTS``) into nodes and edges.

Order matters in a ledger; it is that of (ts, id). What comes last, first or earliest is found by ``max_by`` and ``min_by``
over that order, so no step walks the events one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import paths as p

KINDS = ["created", "transitioned", "completed", "decided", "evidence_attached", "reconciled", "repaired"]


def payload(name: str) -> Column:
    """A string of the payload, '' if missing."""
    return F.coalesce(F.get_json_object("payload", f"$.{name}"), F.lit(""))


def prepared(events: DataFrame) -> DataFrame:
    """Events once an id, with ``at``, their place ``seq``, the effective ``kind`` and the ``src`` and ``conf`` of what they assert.

    A reconciled event counts as the kind it reconciles, unless that is reconciled again. Of repeated ids the first counts.
    """
    once = events.withColumn("at", p.parse_time(F.col("ts"))).withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("at", "ts"))).where("_n = 1").drop("_n")
    inner = payload("kind")
    turned = (F.col("kind") == "reconciled") & (inner != "") & (inner != "reconciled")
    source = F.when(turned, F.lit("reconciled")).otherwise(F.coalesce("source", F.lit("")))
    inferred = source.isin("reconciled", "backfill")
    return once.withColumns(
        {
            "seq": F.struct("at", "id"),
            "kind": F.when(turned, inner).otherwise(F.col("kind")),
            "src": F.when(inferred, "inferred").when(source == "explicit", "explicit").otherwise("ledger"),
            "conf": F.when(inferred, F.lit(0.7)).otherwise(F.lit(1.0)),
        }
    )


def report(events: DataFrame) -> DataFrame:
    """outcome, n_events: read, applied and of unknown kind."""
    known = F.col("kind").isin(KINDS)
    counts = prepared(events).agg(F.count(F.lit(1)).alias("read"), F.count_if(known).alias("applied"), F.count_if(~known).alias("unknown"))
    return counts.select(F.explode(F.create_map(*[x for k in ("read", "applied", "unknown") for x in (F.lit(k), F.col(k))])).alias("outcome", "n_events"))


def festival_index(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """ref, festival: which festival each spelling names that may occur in ``refs`` (one column): its id, its name, what follows a dash of its name, any ending of 4 letters or more. Upper case; of several the least id counts within a rank.

    Endings are cut only at the lengths that occur, of which there are no more than letters in the longest name.
    """
    f = nodes.where("type = 'festival'").select("id", F.upper("name").alias("name"))
    (ref,) = refs.columns
    lengths = refs.agg(F.collect_set(F.length(ref)).alias("lengths"))
    n = F.length("name")
    cut_at = f.join(F.broadcast(lengths), F.lit(True)).select("id", "name", F.explode(F.filter("lengths", lambda x: (x > 0) & (x <= n))).alias("l")).withColumn("at", n - F.col("l") + 1)
    endings = cut_at.select("id", F.substr("name", F.col("at")).alias("ref"), F.when((F.col("at") > 1) & (F.substr("name", F.col("at") - 1, F.lit(1)) == "-"), 2).otherwise(3).alias("rank"))
    endings = endings.where((F.col("rank") == 2) | (F.length("ref") >= 4))
    exact = f.select("id", F.upper(F.expr("substring(id, 10)")).alias("ref"), F.lit(0).alias("rank")).union(f.select("id", "name", F.lit(1)))
    return exact.unionByName(endings).groupBy("ref").agg(F.min(F.struct("rank", "id"))["id"].alias("festival"))


def resolved(events: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Events with ``festival`` and ``artifact``: the most specific node their scope names, null if none.

    ``aliases`` (alias, id) are further names of work items.
    """
    ref = F.upper(F.regexp_replace(F.trim("scope.festival"), "^festival:", ""))
    index = festival_index(nodes, events.select(ref.alias("ref")))
    e = events.withColumn("_ref", ref).join(index, F.col("_ref") == F.col("ref"), "left").drop("_ref", "ref")
    s = "scope."
    tries = F.array(
        F.concat_ws("/", "festival", *[F.when(F.col(s + "festival").isNotNull(), F.col(s + c)) for c in ("phase", "sequence", "task")]),
        F.concat("festival", F.lit("/"), s + "phase", F.lit("/"), s + "sequence"),
        F.concat("festival", F.lit("/"), s + "phase"),
        F.col("festival"),
        F.concat(F.lit("intent:"), s + "intent"),
        F.concat(F.lit("design_doc:"), s + "workitem"),
        F.concat(F.lit("explore_doc:"), s + "workitem"),
        F.concat(F.lit("folder:.campaign/quests/"), s + "quest"),
    )
    ids = nodes.select(F.col("id").alias("try")).distinct().withColumn("node", F.col("try"))
    if aliases is not None:
        ids = ids.unionByName(aliases.select(F.concat(F.lit("design_doc:"), "alias").alias("try"), F.col("id").alias("node"))).distinct()
    tried = e.select("id", F.posexplode(tries).alias("rank", "try")).where("try is not null and try != ''")
    best = tried.join(ids, "try").groupBy("id").agg(F.min_by("node", F.struct("rank", "node")).alias("artifact"))
    return e.join(best, "id", "left")


def artifact_status(events: DataFrame) -> DataFrame:
    """artifact, status, created_at, updated_at: of resolved, prepared events the last status an artifact got, and its first and last event.

    A transition gives the last part of ``to`` (else ``status``), a completion ``completed``, a creation ``status``.
    """
    to = F.regexp_extract(F.rtrim(payload("to"), F.lit("/")), "[^/]*$", 0)
    told = F.when(F.col("kind") == "completed", "completed").when((F.col("kind") == "transitioned") & (to != ""), to).when(payload("status") != "", payload("status"))
    touched = events.where(F.col("artifact").isNotNull() & F.col("kind").isin("created", "transitioned", "completed", "reconciled", "repaired")).withColumn("told", told)
    return touched.groupBy("artifact").agg(
        F.max_by("told", F.when(F.col("told").isNotNull(), F.col("seq"))).alias("status"), F.min("at").alias("created_at"), F.max_by("at", "seq").alias("updated_at")
    )


def decisions(events: DataFrame) -> DataFrame:
    """id, name, path, why, at of the decision nodes."""
    path = F.get(F.filter("evidence", lambda x: (x["type"] == "path") & (x["path"] != "")), F.lit(0))["path"]
    return events.where("kind = 'decided'").select(
        F.concat(F.lit("decision:"), "id").alias("id"), p.first_of(payload("title"), F.col("why"), F.col("id")).alias("name"), p.first_of(path, payload("path")).alias("path"), "why", "at"
    )


def because_of(events: DataFrame) -> DataFrame:
    """from_id, to_id, seq, at, conf of the priors decisions name, whether or not these exist."""
    many = F.coalesce(F.from_json(F.get_json_object("payload", "$.priors"), "array<string>"), F.array().cast("array<string>"))
    prior = F.filter(F.concat(F.array(payload("because_of"), payload("prior_decision")), many), lambda x: x != "")
    rows = events.where("kind = 'decided'").select(F.concat(F.lit("decision:"), "id").alias("from_id"), F.explode(prior).alias("x"), "seq", "at", "conf")
    return rows.select("from_id", F.when(F.col("x").startswith("decision:"), F.col("x")).otherwise(F.concat(F.lit("decision:"), "x")).alias("to_id"), "seq", "at", "conf")


def _action(e: DataFrame) -> DataFrame:
    return e.withColumn("act", F.concat(F.lit("action:"), p.first_of(F.col("action"), F.col("id"))))


def actions(events: DataFrame) -> DataFrame:
    """id, name, why, created_at, updated_at, repaired, repair_note of the action nodes; why is the first one stated."""
    e = _action(events)
    made = e.where("kind = 'evidence_attached'").groupBy(F.col("act").alias("id")).agg(
        F.min_by(p.first_of(F.col("why"), F.expr("substring(act, 8)")), "seq").alias("name"), F.min_by(F.when(F.col("why") != "", F.col("why")), F.when(F.col("why") != "", F.col("seq"))).alias("why"), F.min("at").alias("created_at"), F.max("at").alias("seen"), F.min("seq").alias("first")
    )
    fix = e.where("kind = 'repaired' and action != ''").select(F.col("act").alias("id"), "seq", "at", payload("note").alias("note"))
    # Only repairs after the action was made count.
    repairs = fix.join(made.select("id", "first"), "id").where("seq > first").groupBy("id").agg(
        F.max("at").alias("fixed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("note") != "", F.struct("seq", "note")))), lambda x: x["note"]), "; ").alias("repair_note")
    )
    return made.join(repairs, "id", "left").select("id", "name", "why", "created_at", F.greatest("seen", "fixed").alias("updated_at"), F.col("fixed").isNotNull().alias("repaired"), F.coalesce("repair_note", F.lit("")).alias("repair_note"))


def produced(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_id, to_id, subtype, note, confidence, source, created_at: what actions produced; later repairs raise confidence to 1 and mark the note.

    ``events`` are prepared and resolved. Of several rows for the same pair the first counts.
    """
    e = _action(events)
    x = e.where("kind = 'evidence_attached'").select("act", "seq", "at", "src", "conf", "artifact", F.explode("evidence").alias("v"))
    repo = F.array(F.concat(F.lit("repo:"), "v.repo"), F.concat(F.lit("repo:projects/"), "v.repo"), F.concat(F.lit("project:"), "v.repo"), F.col("artifact"))
    ids = nodes.where("type in ('repo', 'project')").select(F.col("id").alias("try")).distinct()
    commits = x.where("v.type = 'commit'").select("act", "seq", "v", F.posexplode(repo).alias("rank", "try")).where("try is not null")
    own = commits.where("rank = 3").select("act", "seq", "v", "rank", "try").unionByName(commits.where("rank < 3").join(ids, "try", "left_semi").select("act", "seq", "v", "rank", "try"))
    best = own.groupBy("act", "seq", "v").agg(F.min_by("try", "rank").alias("repo_id"))
    full = x.join(best, ["act", "seq", "v"], "left")
    kind = F.col("v.type")
    to = F.when(kind == "path", F.concat(F.lit("file:"), "v.path")).when(kind == "commit", F.coalesce("repo_id", F.lit("folder:."))).when(kind == "url", F.coalesce("artifact", F.lit("folder:.")))
    note = F.when(kind == "path", F.col("v.path")).when(kind == "commit", F.concat(p.first_of(F.col("v.repo"), F.lit("repo")), F.lit("@"), F.coalesce("v.sha", F.lit("")))).otherwise(F.coalesce("v.url", F.lit("")))
    rows = full.where(to.isNotNull() & ((kind != "path") | (F.col("v.path") != ""))).select(F.col("act").alias("from_id"), to.alias("to_id"), "seq", F.struct(kind.alias("subtype"), note.alias("note"), F.col("conf").alias("confidence"), F.col("src").alias("source"), F.col("at").alias("created_at")).alias("r"))
    first = rows.groupBy("from_id", "to_id").agg(F.min_by("r", F.struct("seq", "r")).alias("r"), F.min("seq").alias("seq"))
    fixes = e.where("kind = 'repaired' and action != ''").groupBy(F.col("act").alias("from_id")).agg(F.max("seq").alias("fix"))
    late = F.coalesce(F.col("fix") > F.col("seq"), F.lit(False))
    marked = F.when(late & (F.col("r.note") != "") & ~F.col("r.note").contains("repaired"), F.concat("r.note", F.lit(" (repaired)"))).otherwise(F.col("r.note"))
    return first.join(fixes, "from_id", "left").select("from_id", "to_id", "r.subtype", marked.alias("note"), F.when(late, F.lit(1.0)).otherwise(F.col("r.confidence")).alias("confidence"), "r.source", "r.created_at")


def promoted(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_id, to_id, confidence, source, created_at: promotions of an intent, else of the event's artifact, to the festival a path names."""
    to = F.upper(F.regexp_extract(F.rtrim(payload("promoted_to"), F.lit("/")), "[^/]*$", 0))
    rows = events.where(F.col("kind").isin("created", "transitioned")).withColumn("_to", to).where("_to != ''")
    intents = nodes.where("type = 'intent'").select(F.col("id").alias("intent_id")).distinct()
    index = festival_index(nodes, rows.select("_to")).withColumnRenamed("festival", "to_id")
    known = rows.join(intents, F.concat(F.lit("intent:"), "scope.intent") == F.col("intent_id"), "left").join(index, F.col("_to") == F.col("ref"))
    source = F.coalesce("intent_id", "artifact")
    return known.where(source.isNotNull()).groupBy(source.alias("from_id"), "to_id").agg(F.min_by(F.struct("conf", "src", "at"), "seq").alias("r")).select("from_id", "to_id", F.col("r.conf").alias("confidence"), F.col("r.src").alias("source"), F.col("r.at").alias("created_at"))


def transition_note() -> Column:
    """``from->to`` of an event's payload, '' if it has neither."""
    a, b = payload("from"), payload("to")
    return F.when((a == "") & (b == ""), F.lit("")).otherwise(F.concat(a, F.lit("->"), b))


def with_parent(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Resolved events with ``parent``: what contains the artifact, null if nothing does.

    For an intent the folder of intents, else the node that the id names before its last part, else the festival of the
    scope (nothing if that names none), else the root.
    """
    art, ids = F.col("artifact"), nodes.select(F.col("id").alias("_above")).distinct()
    above = F.when(art.startswith("intent:"), F.lit("folder:.campaign/intents")).otherwise(F.regexp_extract(art, "^(.+)/[^/]*$", 1))
    e = events.withColumn("_want", above).join(ids, F.col("_want") == F.col("_above"), "left")
    named = F.coalesce(F.col("scope.festival"), F.lit("")) != ""
    rest = F.when(named & ~art.startswith("intent:"), F.col("festival")).otherwise(F.lit("folder:."))
    return e.withColumn("parent", F.when(art.isNotNull(), F.coalesce("_above", rest))).drop("_want", "_above")


def told_edges(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges (from_id, to_id, type, confidence, source, subtype, note, created_at) that prepared, resolved events tell, of equal ones the first.

    What holds an artifact and what happened to it, decisions and their priors, actions, what these produced, promotions.
    """
    noted = F.when(F.col("kind") == "transitioned", transition_note()).when(F.col("kind") == "completed", "completed").when(F.col("kind").isin("reconciled", "repaired"), payload("note")).otherwise("")
    touched = with_parent(events.where(F.col("artifact").isNotNull() & F.col("kind").isin("created", "transitioned", "completed", "reconciled", "repaired")), nodes)
    none = F.lit("")

    def rows(df: DataFrame, from_id: Column | str, to_id: Column | str, kind: str, source: Column | str = "src", subtype: Column = none, note: Column = none) -> DataFrame:
        first = F.struct(F.col("conf").alias("confidence"), (F.col(source) if isinstance(source, str) else source).alias("source"), subtype.alias("subtype"), note.alias("note"), F.col("at").alias("created_at"))
        told = df.select((F.col(from_id) if isinstance(from_id, str) else from_id).alias("from_id"), (F.col(to_id) if isinstance(to_id, str) else to_id).alias("to_id"), "seq", first.alias("r"))
        return told.groupBy("from_id", "to_id").agg(F.min_by("r", F.struct("seq", "r")).alias("r")).select("from_id", "to_id", F.lit(kind).alias("type"), "r.*")

    acted = _action(events.where("kind = 'evidence_attached' and artifact is not null"))
    decided = events.where("kind = 'decided' and artifact is not null")
    parts = [
        rows(touched.where("parent != artifact"), "parent", "artifact", "contains", subtype=F.col("kind"), note=noted),
        rows(decided, "artifact", F.concat(F.lit("decision:"), "id"), "contains"),
        rows(because_of(events), "from_id", "to_id", "because_of", F.lit("explicit")),
        rows(acted, "artifact", "act", "relates_to"),
        produced(events, nodes).withColumn("type", F.lit("produced")),
        promoted(events, nodes).withColumns({"type": F.lit("promoted_to"), "subtype": none, "note": none}),
    ]
    columns = ["from_id", "to_id", "type", "confidence", "source", "subtype", "note", "created_at"]
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in parts])


def told_nodes(events: DataFrame) -> DataFrame:
    """The nodes (id, type, name, path, status, metadata, created_at, updated_at) of decisions and actions."""
    stated = lambda **m: F.map_filter(F.create_map(*[x for k, c in m.items() for x in (F.lit(k), c)]), lambda k, v: F.coalesce(v, F.lit("")) != "")
    d = decisions(events).select(
        "id", F.lit("decision").alias("type"), "name", "path", F.lit("").alias("status"), stated(why=F.col("why"), event_id=F.expr("substring(id, 10)")).alias("metadata"), F.col("at").alias("created_at"), F.col("at").alias("updated_at")
    )
    meta = stated(action_id=F.expr("substring(id, 8)"), why=F.col("why"), repaired=F.when(F.col("repaired"), "true"), repair_note=F.col("repair_note"))
    a = actions(events).select("id", F.lit("action").alias("type"), "name", F.lit("").alias("path"), F.lit("").alias("status"), meta.alias("metadata"), "created_at", "updated_at")
    return d.unionByName(a)


def merge_edges(scanned: DataFrame, told: DataFrame) -> DataFrame:
    """Edges of the scan and of the ledger as one; both have the columns of an edge and one row a (from_id, to_id, type).

    Where both have it, the ledger fills an empty subtype and note; a structural edge takes source, confidence and time
    of one told by the ledger or explicitly.
    """
    key = ["from_id", "to_id", "type"]
    rest = ["confidence", "source", "subtype", "note", "created_at"]
    a = scanned.select(*key, *[F.col(c).alias(f"a_{c}") for c in rest], F.lit(True).alias("_a"))
    b = told.select(*key, *[F.col(c).alias(f"b_{c}") for c in rest], F.lit(True).alias("_b"))
    taken = F.col("_a").isNull() | (F.col("_b").isNotNull() & (F.col("a_source") == "structural") & F.col("b_source").isin("ledger", "explicit"))
    out = {c: F.when(taken, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")) for c in ("confidence", "source", "created_at")}
    out |= {c: p.first_of(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in ("subtype", "note")}
    return a.join(b, key, "full_outer").select(*key, *[out[c].alias(c) for c in rest])


def without_dangling(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends both exist, and the others."""
    ids = nodes.select(F.col("id").alias("_i")).distinct()
    marked = edges.join(ids, edges["from_id"] == ids["_i"], "left").withColumnRenamed("_i", "_f").join(ids, edges["to_id"] == F.col("_i"), "left")
    good = F.col("_f").isNotNull() & F.col("_i").isNotNull()
    return marked.where(good).drop("_f", "_i"), marked.where(~good).drop("_f", "_i")


def workitem_aliases(items: DataFrame) -> DataFrame:
    """alias, id of work items (slug, ref, item_id, id, seq): each of the three names, the last item counts."""
    names = items.select("id", "seq", F.explode(F.array("slug", "ref", "item_id")).alias("alias")).where("alias != ''")
    return names.groupBy("alias").agg(F.max_by("id", F.struct("seq", "id")).alias("id"))
