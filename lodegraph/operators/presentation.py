"""What a browser of the graph shows: anchors, groups, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.model import NODE_TYPES, SCOPE_RANK, UNRANKED


def type_ranks(rows: DataFrame) -> DataFrame:
    """Rows with type_rank, to be ordered by (type_rank, type, their own rank): known types in their order, others last by name."""
    ranks = rows.sparkSession.createDataFrame([(t, n) for n, t in enumerate(NODE_TYPES)], "type string, type_rank int")
    return rows.join(F.broadcast(ranks), "type", "left").withColumn("type_rank", F.coalesce("type_rank", F.lit(UNRANKED)))


def scope_anchors(nodes: DataFrame) -> DataFrame:
    """id, name, rank, depth of the folders a browser starts from, to be ordered by (rank, depth, name).

    Depths compare as text. Known kinds of scope only, at depth 0 or 1, repositories and well-known folders at any depth.
    """
    meta = F.col("metadata")
    ranks = nodes.sparkSession.createDataFrame(list(SCOPE_RANK.items()), "kind string, rank int")
    folders = nodes.where("type = 'folder'").select("id", "name", meta["scope_kind"].alias("kind"), meta["path_depth"].alias("depth")).where("depth != ''")
    wide = F.col("kind").isin("repo_root", "submodule_root", "campaign_bucket")
    return folders.where(F.col("depth").isin("0", "1") | wide).join(F.broadcast(ranks), "kind").select("id", "name", "rank", "depth")


def filter_anchors(nodes: DataFrame, type_: str = "", tracked: str = "", scope: str = "") -> DataFrame:
    """Nodes by type, tracked state (of either metadata key) and path at or below a scope; empty filters pass everything."""
    if type_:
        nodes = nodes.where(F.col("type") == type_)
    if tracked:
        meta = F.col("metadata")
        nodes = nodes.where(F.lower(F.trim(F.coalesce(meta["tracked_state"], meta["git_state"]))) == tracked)
    if scope:
        nodes = nodes.where((F.col("path") == scope) | F.col("path").startswith(scope + "/"))
    return nodes
