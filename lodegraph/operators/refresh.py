"""Keeping a store in step with its inputs: fingerprints, differences, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import paths as p
from lodegraph.model import CODE_LANGUAGES, SCHEMA_VERSION


def fingerprints(files: DataFrame) -> DataFrame:
    """rel_path, node_id, content_hash, parser_kind, scope_id of files (rel_path, content)."""
    ext = p.extension(F.col("rel_path"))
    kind = F.when(ext.isin("md", "markdown", "mdx"), "note").when(ext == "canvas", "canvas").when(ext.isin(list(CODE_LANGUAGES)), "code").otherwise("none")
    prefix = F.when(kind == "note", "note:").when(kind == "code", "file:").when(kind == "canvas", "canvas:")
    return files.select(
        "rel_path",
        F.concat(prefix, "rel_path").alias("node_id"),
        F.sha2(F.coalesce(F.col("content"), F.lit("")), 256).alias("content_hash"),
        kind.alias("parser_kind"),
        F.concat(F.lit("folder:"), p.parent(F.col("rel_path"))).alias("scope_id"),
    )


def inventory_diff(prior: DataFrame, now: DataFrame) -> DataFrame:
    """rel_path, change (added, changed, deleted, same) of two states (rel_path, mtime_ns, content_hash), one row a path.

    Changed needs another time and another hash (or one that couldn't be read): a touched file is the same.
    """
    a = prior.select("rel_path", F.col("mtime_ns").alias("t1"), F.col("content_hash").alias("h1"), F.lit(True).alias("was"))
    b = now.select("rel_path", F.col("mtime_ns").alias("t2"), F.col("content_hash").alias("h2"), F.lit(True).alias("is"))
    other = ~F.col("t1").eqNullSafe(F.col("t2")) & ~F.coalesce(F.col("h1") == F.col("h2"), F.lit(False))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(other, "changed").otherwise("same")
    return a.join(b, "rel_path", "full_outer").select("rel_path", change.alias("change"))


def to_hash(prior: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed files (rel_path, mtime_ns) whose content must be read: new ones and those with another time."""
    return listed.join(prior.select("rel_path", F.col("mtime_ns").alias("_t")), "rel_path", "left").where(~F.col("mtime_ns").eqNullSafe(F.col("_t"))).drop("_t")


def verdict(meta: DataFrame, version: str = SCHEMA_VERSION) -> str:
    """fresh (no version stored), matching or incompatible."""
    row = meta.where("key = 'graph_schema_version'").head()
    return "fresh" if row is None or not row["value"] else "matching" if row["value"] == version else "incompatible"


def decide_mode(meta: DataFrame, nodes: DataFrame, version: str = SCHEMA_VERSION) -> tuple[str, bool]:
    """(mode, stale before): rebuild unless the version matches and there are nodes."""
    good = verdict(meta, version) == "matching" and not nodes.isEmpty()
    return ("refresh", False) if good else ("rebuild", True)


def status(meta: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """key, value: the counts of the tables, the stored facts, and whether the store is stale (nodes, but never refreshed)."""
    counts = [t.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(f"{n}_count").alias("key"), "value") for n, t in tables.items()]
    known = meta.groupBy("key").agg(F.max("value").alias("value"))
    refreshed = known.agg(F.max(F.when(F.col("key") == "last_refresh_at", F.col("value"))).alias("at"))
    has = tables["nodes"].agg((F.count(F.lit(1)) > 0).alias("has"))
    stale = refreshed.join(has, F.lit(True)).select(F.lit("stale").alias("key"), (F.col("has") & (F.coalesce("at", F.lit("")) == "")).cast("string").alias("value"))
    out = stale.unionByName(known)
    for c in counts:
        out = out.unionByName(c)
    return out
