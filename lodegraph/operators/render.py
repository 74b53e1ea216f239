"""Drawings and exports of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.paths import dot_escape, plural
from lodegraph.model import DEFAULT_STYLE, STYLES


def styles(spark) -> DataFrame:
    return spark.createDataFrame([(t, *s) for t, s in STYLES.items()], "type string, shape string, color string, fillcolor string")


def _styled(df: DataFrame) -> DataFrame:
    named = df.join(F.broadcast(styles(df.sparkSession)), "type", "left")
    return named.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in zip(("shape", "color", "fillcolor"), DEFAULT_STYLE)})


def legend(nodes: DataFrame) -> DataFrame:
    return _styled(nodes.select("type").distinct()).select("type", "color", "fillcolor")


def summary_line(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """'N nodes, M edges'."""
    counts = nodes.agg(F.count(F.lit(1)).alias("n")).join(edges.agg(F.count(F.lit(1)).alias("m")), F.lit(True))
    return counts.select(F.concat(plural(F.col("n"), "node"), F.lit(", "), plural(F.col("m"), "edge")).alias("line"))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), dot_escape(text), F.lit('"'))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, line of a DOT drawing: nodes (1) by id, then edges (2) by ids and type; write between head and foot of :func:`dot`."""
    n = _styled(nodes).select(
        F.lit(1).alias("part"),
        F.concat(
            F.lit("  "), _quoted(F.col("id")), F.lit(" [label="), _quoted(F.coalesce("name", F.lit(""))), F.lit(", shape="), "shape",
            F.lit(', color="'), "color", F.lit('", fillcolor="'), "fillcolor", F.lit('"];'),
        ).alias("line"),
    )
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), _quoted(F.col("from_id")), F.lit(" -> "), _quoted(F.col("to_id")), F.lit(" [label="), _quoted(F.col("type")), F.lit("];")).alias("line"))
    return n.unionByName(e)


DOT_HEAD = ["digraph workspace {", "  rankdir=LR;", '  node [style=filled, fontname="Helvetica"];', '  edge [fontname="Helvetica", fontsize=10];', ""]


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A DOT drawing as sorted text parts, whose concatenation in name order is the file."""
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, n, x) for n, x in enumerate(DOT_HEAD)] + [(3, 0, "}")], "part int, at int, line string")
    body = dot_lines(nodes, edges).withColumn("at", F.lit(0))
    ends.unionByName(body.select("part", "at", "line")).orderBy("part", "at", "line").select("line").write.mode("overwrite").text(path)


def json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, place, json: nodes by id, then edges by from, to, type; for a JSON export that is the same byte for byte each time."""
    n = nodes.select(F.lit("node").alias("kind"), F.struct(F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c")).alias("place"), F.to_json(F.struct("id", "type", "name", "path", "status")).alias("json"))
    e = edges.select(F.lit("edge").alias("kind"), F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("type").alias("c")).alias("place"), F.to_json(F.struct("from_id", "to_id", "type", "confidence", "source")).alias("json"))
    return n.unionByName(e)


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    json_rows(nodes, edges).orderBy(F.col("kind").desc(), "place").select("json").write.mode("overwrite").text(path)


HTML = """<!doctype html><meta charset="utf-8"><title>{title}</title><h1>{title}</h1><p>{line}</p><ul>{legend}</ul><pre>{body}</pre>"""


def write_html(nodes: DataFrame, edges: DataFrame, path: str, title: str = "workspace", body: str = "") -> None:
    """A page with the counts, a legend of the types that occur and a drawing made elsewhere from the DOT text."""
    from html import escape

    line = summary_line(nodes, edges).first()["line"]
    entries = "".join(f'<li style="color:{r["color"]};background:{r["fillcolor"]}">{escape(r["type"] or "")}</li>' for r in legend(nodes).orderBy("type").collect())
    with open(path, "w", encoding="utf-8") as f:
        f.write(HTML.format(title=escape(title), line=line, legend=entries, body=body[body.find("<svg") :] if "<svg" in body else escape(body)))
