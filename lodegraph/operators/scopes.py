"""Folders, repositories and what they hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import paths as p
from lodegraph.model import BUCKETS, CODE_LANGUAGES


def folders(entries: DataFrame, path: str) -> DataFrame:
    """folder, parent of every folder above an entry; '.' above the topmost."""
    above = entries.select(F.explode(p.ancestors(F.col(path))).alias("folder")).distinct()
    return above.select("folder", p.parent(F.col("folder")).alias("parent"))


def folder_kinds(folders: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """folder, kind: of a repository or submodule if ``boundaries`` (rel_path, is_submodule) has it, else a bucket, what lies below one, or the user's own."""
    bucket = F.col("folder").isin(BUCKETS)
    tops = dict.fromkeys(b.split("/")[0] for b in BUCKETS)
    owned = reduce(Column.__or__, [F.col("folder").startswith(f"{t}/") for t in tops])
    kind = F.when(F.col("folder") == ".", "campaign_root").when(bucket, "campaign_bucket").when(owned, "artifact_scope").otherwise("user_scope")
    if boundaries is None:
        return folders.select("folder", kind.alias("kind"))
    known = boundaries.select(F.col("rel_path").alias("folder"), F.when(F.col("is_submodule"), "submodule_root").otherwise("repo_root").alias("repo")).distinct()
    return folders.join(known, "folder", "left").select("folder", F.coalesce("repo", kind).alias("kind"))


def nearest_ancestor(items: DataFrame, key: str, path: str, folders: DataFrame) -> DataFrame:
    """key, folder: the deepest of ``folders`` (folder) above each item, else '.'.

    Ancestors are joined by equality, so no prefix is compared with every folder.
    """
    above = items.select(key, F.explode(p.ancestors(F.col(path))).alias("folder"))
    best = above.join(folders.select("folder").distinct(), "folder").groupBy(key).agg(F.max_by("folder", p.depth(F.col("folder"))).alias("folder"))
    return items.select(key).distinct().join(best, key, "left").select(key, F.coalesce("folder", F.lit(".")).alias("folder"))


def owner_boundary(items: DataFrame, path: str, boundaries: DataFrame) -> DataFrame:
    """Items with ``owner``: the deepest boundary (rel_path) at or above their path, else '.'."""
    at = F.concat(p.ancestors(F.col(path)), F.array(F.col(path)))
    own = items.select(path).distinct().select(path, F.explode(at).alias("_b"))
    best = own.join(boundaries.select(F.col("rel_path").alias("_b")).distinct(), "_b").groupBy(path).agg(F.max_by("_b", p.depth(F.col("_b"))).alias("owner"))
    return items.join(best, path, "left").withColumn("owner", F.coalesce("owner", F.lit(".")))


def ignored_folders(files: DataFrame, path: str, state: str) -> DataFrame:
    """folder of the directories that hold ignored files at any depth, and no tracked or untracked one."""
    below = files.select(F.explode(p.ancestors(F.col(path))).alias("folder"), F.lower(F.trim(state)).alias("s"))
    seen = below.groupBy("folder").agg(F.bool_or(F.col("s").isin("tracked", "untracked")).alias("kept"), F.bool_or(F.col("s") == "ignored").alias("gone"))
    return seen.where(F.col("gone") & ~F.coalesce("kept", F.lit(False))).select("folder")


def code_files(files: DataFrame, path: str) -> DataFrame:
    """Files with ``language`` by extension; others are left out."""
    languages = files.sparkSession.createDataFrame(list(CODE_LANGUAGES.items()), "_ext string, language string")
    return files.withColumn("_ext", p.extension(F.col(path))).join(F.broadcast(languages), "_ext").drop("_ext")


def go_package(text: Column) -> Column:
    """The package a Go source declares in its first 32 lines, comment lines aside; null if none."""
    lines = F.filter(F.slice(F.split(text, "\n"), 1, 32), lambda x: ~F.trim(x).startswith("//"))
    hit = F.element_at(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*package\s+([A-Za-z_][A-Za-z0-9_]*)", 1)), lambda x: x != ""), 1)
    return hit


def code_slices(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name) and containment (from_id, to_id) of code files (rel_path, language, content): files, and packages of Go."""
    rows = files.select("rel_path", p.parent(F.col("rel_path")).alias("dir"), F.when(F.col("language") == "go", go_package(F.col("content"))).alias("pkg"))
    fid, pid, did = F.concat(F.lit("file:"), "rel_path"), F.concat(F.lit("package:"), "dir", F.lit(":"), "pkg"), F.concat(F.lit("folder:"), "dir")
    has = rows.where("pkg is not null")
    nodes = rows.select(fid.alias("id"), F.lit("file").alias("type"), F.col("rel_path").alias("name")).union(has.select(pid, F.lit("package"), "pkg")).distinct()
    edges = rows.select(did.alias("from_id"), fid.alias("to_id")).union(has.select(did, pid)).union(has.select(pid, fid)).distinct()
    return nodes, edges
