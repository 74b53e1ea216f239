"""Edges that YAML metadata states: festivals to projects and chains, intents to their sources, chains to their members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.paths import basename
from lodegraph.operators.links import block_of
from lodegraph.session import ship

# Confidence of a chain's dependency by its kind, and of an intent's related project.
DEPENDENCY = {"hard": 1.0, "soft": 0.8}
RELATED = 0.8

FESTIVAL = "metadata struct<chain:string>, project_path string"
INTENT = "gathered_from array<string>, concept string, related_projects array<string>"
CHAIN = "festivals array<string>, edges array<struct<from:string,to:string,type:string>>"
WORKITEM = "id string, ref string"


def parsed(df: DataFrame, text: str, schema: str, frontmatter: bool = False) -> DataFrame:
    """Rows with a struct ``y`` of the given schema from YAML text (or its frontmatter block); null where it isn't a YAML mapping.

    YAML becomes JSON in Python, by Arrow batches; types are then Spark's affair.
    """
    ship(df.sparkSession)

    def run(blocks):
        import json

        import yaml

        def one(block):
            try:
                found = yaml.load(block, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if block else None
                return json.dumps(found, default=str) if isinstance(found, dict) else None
            except Exception:  # any malformed block counts as none
                return None

        return blocks.map(one)

    to_json = F.pandas_udf(run, "string")
    source = block_of(F.col(text)) if frontmatter else F.col(text)
    return df.withColumn("y", F.from_json(to_json(F.coalesce(source, F.lit(""))), schema))


def _edges(df: DataFrame, kind: str, confidence=1.0, subtype: str = "") -> DataFrame:
    c = confidence if not isinstance(confidence, float) else F.lit(confidence)
    return df.select("from_id", "to_id", F.lit(kind).alias("type"), c.alias("confidence"), F.lit("explicit").alias("source"), (F.col(subtype) if subtype else F.lit("")).alias("subtype"))


def _existing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi")


def festival_edges(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of festivals (id, text of their fest.yaml) to the project and the chain they name, if these exist."""
    y = parsed(files, "text", FESTIVAL)
    project = y.where("y.project_path != ''").select(F.col("id").alias("from_id"), F.concat(F.lit("project:"), basename(F.regexp_replace("y.project_path", "/+$", ""))).alias("to_id"))
    chain = y.where("y.metadata.chain != ''").select(F.concat(F.lit("chain:"), "y.metadata.chain").alias("to_id"), F.col("id").alias("from_id"))
    back = _existing(chain, nodes).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return _edges(_existing(project, nodes), "links_to").unionByName(_edges(back, "chain_member"))


def intent_edges(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of intents (id, text) to the intents they were gathered from and to their related projects, if these exist."""
    y = parsed(files, "text", INTENT, frontmatter=True)
    name = F.regexp_replace(basename(F.col("x")), r"\.md$", "")
    gathered = y.select(F.col("id").alias("from_id"), F.explode("y.gathered_from").alias("x")).select("from_id", F.concat(F.lit("intent:"), name).alias("to_id"))
    projects = y.select(F.col("id").alias("from_id"), F.explode("y.related_projects").alias("x")).select("from_id", F.concat(F.lit("project:"), basename(F.col("x"))).alias("to_id"))
    return _edges(_existing(gathered, nodes), "gathered_from").unionByName(_edges(_existing(projects, nodes), "relates_to", RELATED)).distinct()


def chain_edges(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of chains (id, text) to their festivals, and among these the dependencies with the confidence of their kind."""
    y = parsed(files, "text", CHAIN)
    fest = lambda c: F.concat(F.lit("festival:"), c)
    member = y.select(F.col("id").alias("from_id"), F.explode("y.festivals").alias("x")).select("from_id", fest(F.col("x")).alias("to_id"))
    need = y.select(F.explode("y.edges").alias("e")).select(fest(F.col("e.from")).alias("from_id"), fest(F.col("e.to")).alias("to_id"), F.coalesce("e.type", F.lit("hard")).alias("kind"))
    kept = _existing(need, nodes).join(nodes.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi")
    strength = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in DEPENDENCY.items()], F.lit(DEPENDENCY["hard"]))
    return _edges(_existing(member, nodes), "chain_member").unionByName(_edges(kept, "depends_on", strength, "kind"))


def work_items(markers: DataFrame) -> DataFrame:
    """slug, ref, item_id, id, seq of work items from their ``.workitem`` files (rel_path, text) below ``workflow/<kind>/<slug>``."""
    y = parsed(markers, "text", WORKITEM)
    parts = F.split("rel_path", "/")
    kind = F.get(parts, F.lit(1))
    owner = F.when(kind == "design", "design_doc:").when(kind == "explore", "explore_doc:")
    slug = F.get(parts, F.lit(2))
    rows = y.where(F.col("rel_path").startswith("workflow/") & (F.size(parts) >= 4) & owner.isNotNull())
    return rows.select(slug.alias("slug"), F.coalesce("y.ref", F.lit("")).alias("ref"), F.coalesce("y.id", F.lit("")).alias("item_id"), F.concat(owner, slug).alias("id"), F.col("rel_path").alias("seq"))
