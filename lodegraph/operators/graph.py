"""Operators on a property graph of nodes (id, ...) and edges (from_id, to_id, type, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.model import MODE_SOURCES
from lodegraph.session import cut, shuffle_partitions


#: Ids of a layer, or of the paths of a frontier, that are broadcast at most; larger ones are joined by shuffle.
BROADCAST_MOST = 20_000
#: Frontiers of a search that are kept apart before they are put together.
SEEN_PARTS = 8


class GraphError(ValueError):
    """A graph that an operator cannot work on."""


def mode_filter(edges: DataFrame, mode: str) -> DataFrame:
    """Edges that a relation mode shows; hybrid and unknown modes show all."""
    source = MODE_SOURCES.get(mode)
    return edges.where(F.col("source") == source) if source else edges


def induced(edges: DataFrame, keep: DataFrame, column: str = "id") -> DataFrame:
    """Edges both of whose ends are kept."""
    k = keep.select(F.col(column).alias("_k"))
    return edges.join(k, edges["from_id"] == k["_k"], "left_semi").join(k.withColumnRenamed("_k", "_l"), F.col("to_id") == F.col("_l"), "left_semi")


def tracked_slice(nodes: DataFrame, state: str) -> DataFrame:
    """Nodes in a tracked state, and those without any (folders, tags)."""
    own = F.lower(F.trim(F.coalesce(F.col("metadata")["git_state"], F.lit(""))))
    return nodes.where((own == "") | (own == state))


def scope_slice(nodes: DataFrame, scope: str) -> DataFrame:
    """Nodes at or below a folder scope by name or path; all if the scope is empty, an error if no folder or repo anchors it."""
    scope = scope.rstrip("/")
    if not scope:
        return nodes
    if nodes.where(F.col("id").isin(f"folder:{scope}", f"repo:{scope}")).isEmpty():
        raise GraphError(f"no folder or repo {scope!r}")
    return nodes.where(in_scope(F.lit(scope)))


def in_scope(scope: Column) -> Column:
    """Whether name or path of a node is the scope or lies below it."""
    at = [F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "^/+|/+$", "") for c in ("name", "path")]
    below = [(x == scope) | x.startswith(F.concat(scope, F.lit("/"))) for x in at]
    return below[0] | below[1]


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b for each edge in either direction."""
    return edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).union(edges.select("to_id", "from_id"))


def neighbours(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """Nodes joined to one by an edge in either direction, once each; ids without a node are left out."""
    near = edges.where(F.col("from_id") == node_id).select(F.col("to_id").alias("id")).union(edges.where(F.col("to_id") == node_id).select("from_id")).distinct()
    return nodes.join(near, "id", "left_semi")


def visited(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """id, hop of all ids within ``hops`` undirected steps of the ids of ``start`` that is one column ``id``.

    Each hop joins the frontier only; seen ids never return to it, so a hot node is expanded once.
    """
    links = both_ways(edges)
    seen = start.select("id", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        reached = links.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = reached.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        if hop < hops:
            frontier = cut(frontier)
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(nodes: DataFrame, edges: DataFrame, node_id: str, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges within ``hops`` of a node. A missing one gives nothing; edges between visited ids stay even if one of these has no node."""
    start = nodes.where(F.col("id") == node_id).select("id").distinct()
    ids = visited(edges, start, hops)
    return nodes.join(ids.select("id"), "id", "left_semi"), induced(edges, ids)


def simple_digraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (from_id, to_id) whose ends are both nodes."""
    return induced(edges, nodes).select("from_id", "to_id").distinct()


def topological_layers(edges: DataFrame, strict: bool = True) -> DataFrame:
    """id, layer: the length of the longest chain that leads to an id. Ids on or behind a loop are an error, or layer -1 if not ``strict``.

    Layers are peeled: each round places the ids to which no edge from an id that isn't placed leads, and takes their own
    edges off the counts of the rest, so that a round moves the edges of one layer only.
    """
    spark = edges.sparkSession
    links = cut(edges.select("from_id", "to_id").distinct())
    ends = links.select(F.col("from_id").alias("id"), F.lit(0).cast("bigint").alias("one")).union(links.select("to_id", F.lit(1).cast("bigint")))
    state = ends.groupBy("id").agg(F.sum("one").alias("open"))
    state = cut(state.withColumn("layer", F.when(F.col("open") == 0, F.lit(0))))
    layer = 0
    while n := (free := state.where(F.col("layer") == layer).select(F.col("id").alias("from_id"))).count():
        # A counted, small layer goes to the edges, which then need no shuffle.
        free = F.broadcast(free) if n <= BROADCAST_MOST else free
        less = links.join(free, "from_id").groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("less"))
        left = F.col("open") - F.coalesce("less", F.lit(0))
        now = F.when(F.col("layer").isNull() & (left == 0), F.lit(layer + 1)).otherwise(F.col("layer"))
        state = cut(state.join(less, "id", "left").select("id", left.alias("open"), now.alias("layer")).coalesce(shuffle_partitions(spark)))
        layer += 1
    if strict and not state.where("layer is null").isEmpty():
        raise GraphError("the graph has a cycle")
    return state.select("id", F.coalesce("layer", F.lit(-1)).alias("layer"))


def shortest_path(edges: DataFrame, source: str, target: str, most: int | None = None) -> DataFrame:
    """step, id of the shortest directed path, of several the least by ids; no rows if there is none (within ``most`` steps, if given).

    Breadth first, until the target is reached or no new id is: each id keeps the least path that reaches it first.
    """
    spark = edges.sparkSession
    links = cut(edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("next")).distinct())
    frontier = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    seen, step = [frontier.select("id")], 0
    at = F.when(F.col("id") == target, F.col("path"))
    while (now := frontier.agg(F.min(at).alias("path"), F.count(F.lit(1)).alias("n")).head())["path"] is None and now["n"] and step != most:
        # A counted, small frontier goes to the links, which then need no shuffle.
        near = F.broadcast(frontier) if now["n"] * (step + 1) <= BROADCAST_MOST else frontier
        grown = links.join(near, "id").groupBy(F.col("next").alias("id")).agg(F.min(F.concat("path", F.array("next"))).alias("path"))
        frontier = cut(grown.join(reduce(DataFrame.unionByName, seen), "id", "left_anti"))
        # The frontiers themselves are what was seen; they are put together now and then, or plans would grow with the steps.
        seen, step = [*seen, frontier.select("id")], step + 1
        if len(seen) > SEEN_PARTS:
            seen = [cut(reduce(DataFrame.unionByName, seen).coalesce(shuffle_partitions(spark)))]
    path = now["path"] or []
    return spark.createDataFrame([(n, x) for n, x in enumerate(path)], "step int, id string")


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n_nodes"))


def preview(edges: DataFrame, node_id: str, most: int = 50) -> DataFrame:
    """direction, other, type, rank of the first ``most`` edges each way, with the number beyond them."""
    out = edges.where(F.col("from_id") == node_id).select(F.lit("out").alias("direction"), F.col("to_id").alias("other"), "type")
    into = edges.where(F.col("to_id") == node_id).select(F.lit("in").alias("direction"), F.col("from_id").alias("other"), "type")
    totals = out.unionByName(into).groupBy("direction").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("n_more"))
    # A global sort with a limit keeps a hot node's edges from one task.
    firsts = [x.orderBy("other", "type").limit(most) for x in (out, into)]
    ranked = firsts[0].unionByName(firsts[1]).withColumn("rank", F.row_number().over(Window.partitionBy("direction").orderBy("other", "type")))
    return ranked.join(F.broadcast(totals), "direction")


def focus(edges: DataFrame, nodes: DataFrame, node_id: str, mode: str = "hybrid") -> DataFrame:
    """direction, edge_type, source, confidence, id, type, name of what a node's edges of a relation mode lead to, each way; ends without a node are left out."""
    shown = mode_filter(edges, mode)
    sides = [
        shown.where(F.col(own) == node_id).select(F.lit(direction).alias("direction"), F.col(other).alias("id"), F.col("type").alias("edge_type"), "source", "confidence")
        for direction, own, other in (("out", "from_id", "to_id"), ("in", "to_id", "from_id"))
    ]
    return sides[0].unionByName(sides[1]).join(nodes.select("id", "type", "name"), "id").select("direction", "edge_type", "source", "confidence", "id", "type", "name")


def micrograph(nodes: DataFrame, edges: DataFrame, node_id: str, hops: int = 2, mode: str = "hybrid") -> dict | None:
    """A node, what its edges lead to each way, and the size of its neighbourhood; None if there is no such node. For one node's edges, which the driver shows."""
    own = nodes.where(F.col("id") == node_id).select("id", "type", "name", "path", "status").head()
    if own is None:
        return None
    lines = focus(edges, nodes, node_id, mode).orderBy(F.col("direction").desc(), "edge_type", "id").collect()
    near_nodes, near_edges = neighbourhood(nodes, mode_filter(edges, mode), node_id, hops)
    return {
        **own.asDict(), "outgoing": [r.asDict() for r in lines if r["direction"] == "out"], "incoming": [r.asDict() for r in lines if r["direction"] == "in"],
        "hops": hops, "mode": mode, "n_nodes": near_nodes.count(), "n_edges": near_edges.count(),
    }
