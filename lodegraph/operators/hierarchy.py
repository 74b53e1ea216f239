"""Parent-child rows to full hierarchies.

Frontier joins walk down level by level from the roots and extend each path. Ids are dictionary-encoded, so a path is an
array of integers. What lies deeper than ``levels`` is finished by pointer doubling towards the last frontier, in a
logarithmic number of joins; ids that never reach it are caught in loops or hang below one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import cut, shuffle_partitions

LEVELS = 10


def encode(keys: DataFrame, buckets: int | None = None) -> DataFrame:
    """key, code for the distinct values of the one column of ``keys``: dense within hash buckets, the same on every run."""
    (name,) = keys.columns
    buckets = buckets or max(64, 4 * shuffle_partitions(keys.sparkSession))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("key")).cast("bigint")
    return (
        keys.select(F.col(name).alias("key"))
        .distinct()
        .withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        .select("key", (F.call_function("shiftleft", F.col("_b"), F.lit(36)) + rank).alias("code"))
    )


def parent_of(rows: DataFrame) -> DataFrame:
    """child, parent: of a child's rows (child, parent, at) the one with the greatest ``at`` (null is the least), in a tie the smallest parent."""
    age = F.coalesce(-F.unix_micros(F.col("at").cast("timestamp")), F.lit(2**63 - 1))
    return rows.groupBy("child").agg(F.min(F.struct(age.alias("age"), "parent"))["parent"].alias("parent"))


@dataclass
class Hierarchy:
    """``nodes``: code, place, depth, path (codes of the ancestors, root first; null unless in a tree); ``names``: key, code."""

    nodes: DataFrame
    names: DataFrame

    def pairs(self) -> DataFrame:
        """ancestor, node, distance (names) of every ancestor pair: each node with everything beneath it."""
        raw = self.nodes.where("place = 'tree'").select("code", "depth", F.posexplode("path").alias("at", "above"))
        over, under = self.names.select(F.col("key").alias("ancestor"), F.col("code").alias("above")), self.names.select(F.col("key").alias("node"), "code")
        return raw.join(over, "above").join(under, "code").select("ancestor", "node", (F.col("depth") - F.col("at")).cast("int").alias("distance"))

    def paths(self) -> DataFrame:
        """node_id, path: the names of its ancestors from the root down to the id itself, for ids in trees."""
        steps = self.nodes.where("place = 'tree'").select("code", F.posexplode(F.concat(F.col("path"), F.array("code"))).alias("at", "step"))
        named = steps.join(self.names.select(F.col("code").alias("step"), "key"), "step").groupBy("code").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("p"))
        return named.join(self.names, "code").select(F.col("key").alias("node_id"), F.col("p.key").alias("path"))

    def summary(self) -> DataFrame:
        """node_id, place, root_id, depth, n_below of every id; root_id '' and -1 outside trees."""
        below = self.nodes.where("place = 'tree'").select(F.explode("path").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n_below"))
        root = F.coalesce(F.get(F.col("path"), F.lit(0)), F.col("code"))
        placed = self.nodes.select("code", "place", "depth", F.when(F.col("place") == "tree", root).alias("root")).join(below, "code", "left")
        tree = F.col("place") == "tree"
        roots = self.names.select(F.col("key").alias("root_id"), F.col("code").alias("root"))
        return (
            placed.join(self.names, "code")
            .join(roots, "root", "left")
            .select(
                F.col("key").alias("node_id"),
                "place",
                F.coalesce("root_id", F.lit("")).alias("root_id"),
                F.when(tree, F.col("depth")).otherwise(-1).cast("bigint").alias("depth"),
                F.when(tree, F.coalesce("n_below", F.lit(0))).otherwise(-1).cast("bigint").alias("n_below"),
            )
        )


def hierarchy(rows: DataFrame, levels: int | None = LEVELS) -> Hierarchy:
    """The hierarchy of rows (child, parent, at) of strings, one parent a child by :func:`parent_of`.

    Every id of a row whose ids are neither null nor empty takes part, that of rows which don't count included. place is
    ``tree``, ``cycle`` (among its own ancestors) or ``below_cycle``. Repeats change nothing; an empty table gives no
    rows. The frontier and the links are joined by ordinary shuffles, whose hot parents AQE splits; nothing is collected
    but counts.

    ``levels`` frontier joins are made, all that there are if it is None; what lies deeper is finished by doubling. It
    changes the way, not the rows: a frontier join is a job a level, doubling a few jobs for any depth.
    """
    rows = rows.where("child is not null and child != '' and parent is not null and parent != ''").select("child", "parent", "at")
    names = cut(encode(rows.select(F.explode(F.array("child", "parent")).alias("key"))))
    child, parent = names.select(F.col("key").alias("child"), F.col("code").alias("c")), names.select(F.col("key").alias("parent"), F.col("code").alias("p"))
    links = cut(parent_of(rows).join(child, "child").join(parent, "parent").select("c", "p"))
    frontier = cut(names.join(links, names["code"] == links["c"], "left_anti").select("code", F.array().cast("array<bigint>").alias("path")))
    placed, rest, more = [frontier], links, True
    for _ in count() if levels is None else range(levels):
        frontier = cut(rest.join(frontier, rest["p"] == frontier["code"]).select(F.col("c").alias("code"), F.concat("path", F.array("p")).alias("path")))
        if not (more := not frontier.isEmpty()):
            break
        placed.append(frontier)
    trees = reduce(DataFrame.unionByName, placed)
    # What no frontier reached: deeper nodes, loops, and what hangs below loops.
    rest = cut(links.join(trees, links["c"] == trees["code"], "left_anti"))
    loops = None
    if not rest.isEmpty():
        deep, loops = _beyond(rest, frontier if more else None)
        if deep is not None:
            trees = trees.unionByName(deep)
    nodes = trees.select("code", F.lit("tree").alias("place"), F.size("path").alias("depth"), "path")
    if loops is not None:
        nodes = nodes.unionByName(loops.select("code", "place", F.lit(-1).alias("depth"), F.lit(None).cast("array<bigint>").alias("path")))
    return Hierarchy(nodes, names)


def _beyond(rest: DataFrame, frontier: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """(code, path) of the ids of ``rest`` below the frontier, and (code, place) of those that never reach it."""
    anchors = (frontier.select("code") if frontier is not None else rest.select(F.col("c").alias("code")).limit(0)).withColumn("done", F.lit(True))
    hop = rest.join(anchors, rest["p"] == anchors["code"], "left").select(F.col("c").alias("code"), F.col("p").alias("up"), F.coalesce("done", F.lit(False)).alias("done"))
    first, seen = cut(hop), None
    pointers, rounds = first, 0
    while True:
        done, images, open_ = pointers.agg(F.count_if("done"), F.countDistinct(F.when(~F.col("done"), F.col("up"))), F.count_if(~F.col("done"))).first()
        if not open_ or seen == (done, images):
            break
        seen = (done, images)
        pointers, rounds = cut(_double(pointers)), rounds + 1
    loops = deep = None
    if open_:
        stuck = pointers.where(~F.col("done"))
        ring = stuck.select(F.col("up").alias("on")).distinct()
        loops = stuck.join(ring, stuck["code"] == ring["on"], "left").select("code", F.when(F.col("on").isNotNull(), "cycle").otherwise("below_cycle").alias("place"))
    if done:
        # The paths of those that reach the frontier, by the same doubling with the steps kept.
        reach = pointers.where("done").select("code")
        paths = first.join(reach, "code", "left_semi").withColumn("steps", F.array("up"))
        for n in range(rounds):
            paths = _double(paths, "steps")
            if n % 3 == 2:
                paths = cut(paths)
        deep = cut(paths.join(frontier.withColumnRenamed("code", "up"), "up").select("code", F.concat("path", "steps").alias("path")))
    return deep, loops


def _double(pointers: DataFrame, steps: str | None = None) -> DataFrame:
    """Each pointer that is not done goes on to where the pointer of its target leads."""
    a, b = pointers.where(~F.col("done")).alias("a"), pointers.alias("b")
    extra = [F.concat(F.col(f"b.{steps}"), F.col(f"a.{steps}")).alias(steps)] if steps else []
    moved = a.join(b, F.col("a.up") == F.col("b.code")).select(F.col("a.code").alias("code"), F.col("b.up").alias("up"), F.col("b.done").alias("done"), *extra)
    return pointers.where("done").unionByName(moved)
