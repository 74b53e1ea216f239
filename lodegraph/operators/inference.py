"""Inferred relations: candidate pairs from shared groups, and the evidence of each pair made into one edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import paths as p
from lodegraph.model import EVIDENCE_WEIGHTS

CANDIDATE_TYPES = ["note", "canvas", "attachment"]
SOURCES = ["same_folder", "shared_ancestor", "shared_tag", "shared_frontmatter", "shared_repo_root"]
GROUP_CAP, PAIR_BUDGET, LEAST_CONFIDENCE, LEAST_TOKENS = 128, 5000, 0.30, 3


def groups(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """source, value, id: the groups each candidate node belongs to; tags come from metadata and from references to tags in ``edges``."""
    meta = F.col("metadata")
    n = nodes.where(F.col("type").isin(CANDIDATE_TYPES) & (F.col("name") != ""))
    above = p.ancestors(F.col("name"))
    tags = n.select("id", F.explode(F.transform(p.split_canonical(meta["tags"]), F.lower)).alias("value"))
    if edges is not None:
        refs = edges.where("type = 'references' and to_id like 'tag:%'").select(F.col("from_id").alias("id"), F.lower(F.expr("substring(to_id, 5)")).alias("value"))
        tags = tags.unionByName(refs.join(n.select("id"), "id", "left_semi"))
    aliases = F.transform(p.split_canonical(meta["aliases"]), lambda a: F.concat(F.lit("alias="), F.lower(a)))
    own = F.array_compact(F.array(*[F.when(meta[k] != "", F.concat(F.lit(f"{k}="), meta[k])) for k in ("type", "status")]))
    parts = {
        "same_folder": n.select("id", p.parent(F.col("name")).alias("value")),
        "shared_ancestor": n.select("id", F.explode(F.slice(above, 1, F.greatest(F.size(above) - 1, F.lit(0)))).alias("value")),
        "shared_tag": tags.where("value != ''").distinct(),
        "shared_frontmatter": n.select("id", F.explode(F.array_distinct(F.concat(own, aliases))).alias("value")),
        "shared_repo_root": n.select("id", meta["repo_root"].alias("value")).where("value != ''"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(s).alias("source"), "value", "id") for s, df in parts.items()])


def candidate_pairs(members: DataFrame, cap: int | None = GROUP_CAP, budget: int | None = None) -> DataFrame:
    """from_id < to_id, source, value of the pairs within groups.

    Bounded generation is part of the operator: a group counts by its first ``cap`` ids, which Spark already limits
    before the shuffle, so that a group with a third of all nodes stays small; ``cap=None`` pairs whole groups. A
    ``budget`` keeps the first pairs by source, value and ids.
    """
    rows = members.distinct()
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy("source", "value").orderBy("id"))
        rows = rows.withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")
    a, b = rows.select("source", "value", F.col("id").alias("from_id")), rows.select("source", "value", F.col("id").alias("to_id"))
    pairs = a.join(b, ["source", "value"]).where("from_id < to_id").select("from_id", "to_id", "source", "value")
    if budget is not None:
        order = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
        pairs = pairs.orderBy(order, "value", "from_id", "to_id").limit(budget)
    return pairs


def truncated(members: DataFrame, cap: int | None = GROUP_CAP, budget: int | None = PAIR_BUDGET) -> bool:
    """Whether a cap cuts a group, or there are more pairs than a budget lets through; told by the sizes of groups alone."""
    sizes = members.distinct().groupBy("source", "value").agg(F.count(F.lit(1)).alias("n"))
    kept = F.least("n", F.lit(cap)) if cap is not None else F.col("n")
    cut_off, pairs = sizes.agg(F.max(F.lit(False) if cap is None else F.col("n") > cap), F.sum(kept * (kept - 1) / 2)).head()
    return bool(cut_off) or (budget is not None and (pairs or 0) > budget)


def memberships(members: DataFrame) -> DataFrame:
    """source, value, id, n_members: every member of every group, however large, a row each; what a cap keeps from :func:`candidate_pairs` is here."""
    rows = members.distinct()
    return rows.join(rows.groupBy("source", "value").agg(F.count(F.lit(1)).alias("n_members")), ["source", "value"])


def capped_groups(members: DataFrame, cap: int = GROUP_CAP) -> DataFrame:
    """source, value, n_members of the groups that a cap cuts."""
    return members.distinct().groupBy("source", "value").agg(F.count(F.lit(1)).alias("n_members")).where(F.col("n_members") > cap)


def _profile(nodes: DataFrame) -> DataFrame:
    base = p.name_tokens(p.stem(F.col("name")))
    title = p.name_tokens(F.coalesce(F.col("metadata")["title"], F.lit("")))
    return nodes.select("id", F.array_union(base, title).alias("tokens"), p.artifact_scope(F.col("name")).alias("owner"))


def added_evidence(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The two kinds of evidence looked up for shortlisted pairs: shared name tokens and a common owning artifact."""
    short = pairs.select("from_id", "to_id").distinct()
    prof = _profile(nodes)
    a = prof.select(F.col("id").alias("from_id"), F.col("tokens").alias("t1"), F.col("owner").alias("o1"))
    b = prof.select(F.col("id").alias("to_id"), F.col("tokens").alias("t2"), F.col("owner").alias("o2"))
    both = short.join(a, "from_id").join(b, "to_id").withColumn("shared", F.array_sort(F.array_intersect("t1", "t2")))
    tokens = F.when(F.size("shared") >= LEAST_TOKENS, F.struct(F.lit("shared_tokens").alias("source"), F.array_join("shared", "+").alias("value")))
    owned = F.when(F.col("o1") == F.col("o2"), F.struct(F.lit("artifact_owned").alias("source"), F.col("o1").alias("value")))
    return both.select("from_id", "to_id", F.explode(F.array_compact(F.array(tokens, owned))).alias("s")).select("from_id", "to_id", "s.source", "s.value")


def inferred_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_id, to_id, type, confidence, source, subtype, note: one edge a pair whose saturated evidence reaches the least confidence.

    Each (source, value) counts once. Weights add up as decimals, so the sum doesn't depend on order. Rows without a
    value are no evidence.
    """
    weights = pairs.sparkSession.createDataFrame(list(EVIDENCE_WEIGHTS.items()), "source string, w string").select("source", F.col("w").cast("decimal(9,3)").alias("weight"))
    clean = pairs.where("value is not null and value != '' and from_id < to_id").select("from_id", "to_id", "source", "value")
    signals = clean.unionByName(added_evidence(clean, nodes)).distinct().join(F.broadcast(weights), "source")
    reason = F.struct((-F.col("weight")).alias("order"), F.col("source").alias("kind"), "value", F.col("weight").cast("double").alias("weight"))
    acc = signals.groupBy("from_id", "to_id").agg(F.sum("weight").cast("double").alias("raw"), F.array_sort(F.collect_list(reason)).alias("r"))
    kinds = F.col("r.kind")
    score = p.round3(p.saturate(F.col("raw")))
    reasons = F.transform("r", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["weight"].alias("weight")))
    return acc.where(p.saturate(F.col("raw")) >= LEAST_CONFIDENCE).select(
        "from_id",
        "to_id",
        F.when(F.array_contains(kinds, "shared_tokens"), "similar_to").otherwise("relates_to").alias("type"),
        p.saturate(F.col("raw")).alias("confidence"),
        F.lit("inferred").alias("source"),
        F.get(kinds, F.lit(0)).alias("subtype"),
        F.to_json(F.struct(reasons.alias("reasons"), score.alias("score"))).alias("note"),
        F.size("r").alias("n_reasons"),
    )
