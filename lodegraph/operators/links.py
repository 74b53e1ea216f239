"""References that notes make: links, wiki links, tags, frontmatter, canvases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import paths as p
from lodegraph.session import ship

# Patterns of links, wiki links and tags.
LINK = r"(!?)\[[^\]]*\]\(([^)\s]+)\)"
WIKI = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
TAG = r"(?:^|[\s(,;])#([A-Za-z][A-Za-z0-9_\-/]*)"
EXTERNAL = r"^(http://|https://|mailto:|tel:|ftp://)"
NOTE_EXTENSIONS = ["md", "markdown", "mdx"]
FRONTMATTER = "title string, aliases array<string>, tags array<string>, type string, status string"
CANVAS = "struct<nodes:array<struct<type:string,file:string>>>"


def body_of(text: Column) -> Column:
    """A text without its leading frontmatter block."""
    end = F.locate("\n---", F.substr(text, F.lit(5)))
    return F.when(text.startswith("---\n") & (end > 0), F.substr(text, end + 8)).otherwise(text)


def block_of(text: Column) -> Column:
    """The frontmatter block of a text, null if there is none."""
    end = F.locate("\n---", F.substr(text, F.lit(5)))
    return F.when(text.startswith("---\n") & (end > 0), F.substr(text, F.lit(5), end - 1))


def unescape(target: Column) -> Column:
    """Percent escapes decoded, ``+`` kept; the text as it is where they are broken."""
    return F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)


def markdown_links(notes: DataFrame) -> DataFrame:
    """rel_path, target, embed of each internal link of notes (rel_path, text), targets resolved from the note's folder.

    External links, bare anchors and what climbs above the root are left out.
    """
    found = notes.select("rel_path", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(LINK), F.lit(1)).alias("bang"), F.regexp_extract_all("text", F.lit(LINK), F.lit(2)).alias("to"))).alias("m"))
    plain = found.select("rel_path", (F.col("m.bang") == "!").alias("embed"), F.trim("m.to").alias("raw")).where(~F.col("raw").rlike(EXTERNAL))
    cut = plain.withColumn("raw", F.regexp_extract("raw", "^[^#?]*", 0)).where("raw != ''")
    return cut.select("rel_path", p.resolve(F.col("rel_path"), unescape(F.col("raw"))).alias("target"), "embed").where("target is not null")


def link_edges(notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_id, to_id, subtype of the links: to a note, canvas or attachment that exists, in this order, else to a new attachment unless it is a note's name."""
    links = markdown_links(notes).groupBy("rel_path", "target").agg(F.bool_and("embed").alias("embed"))
    tries = links.select("rel_path", "target", "embed", F.posexplode(F.transform(F.array(*map(F.lit, ("note:", "canvas:", "attachment:"))), lambda k: F.concat(k, F.col("target")))).alias("rank", "id"))
    best = tries.join(nodes.select("id").distinct(), "id").groupBy("rel_path", "target").agg(F.min_by("id", "rank").alias("id"))
    known = links.join(best, ["rel_path", "target"], "left")
    new = F.col("id").isNull()
    kept = known.where(~new | ~p.extension(F.col("target")).isin(NOTE_EXTENSIONS))
    return kept.select(
        F.concat(F.lit("note:"), "rel_path").alias("from_id"),
        F.coalesce("id", F.concat(F.lit("attachment:"), "target")).alias("to_id"),
        F.when(new, "attachment").when(F.col("embed"), "embed").otherwise("markdown_link").alias("subtype"),
    )


def wiki_links(notes: DataFrame) -> DataFrame:
    """rel_path, target of each distinct wiki link."""
    return notes.select("rel_path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WIKI), F.lit(1)), lambda v: F.trim(v)))).alias("target")).where("target != ''")


def basename_index(nodes: DataFrame) -> DataFrame:
    """base, id: of the notes with one lower-cased file name (without extension) the smallest id."""
    notes = nodes.where("type = 'note'").select("id", F.lower(p.stem(F.col("name"))).alias("base"))
    return notes.groupBy("base").agg(F.min("id").alias("id"))


def wiki_edges(notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_id, to_id of the wiki links: to ``note:T``, else ``note:T.md``, else the note with T's file name; others lead nowhere."""
    links = wiki_links(notes)
    ids = nodes.where("type = 'note'").select("id").distinct()
    named = basename_index(nodes).withColumnRenamed("id", "by_name")
    a, b = ids.withColumnRenamed("id", "exact"), ids.withColumnRenamed("id", "with_md")
    known = (
        links.join(a, F.concat(F.lit("note:"), "target") == F.col("exact"), "left")
        .join(b, F.concat(F.lit("note:"), "target", F.lit(".md")) == F.col("with_md"), "left")
        .join(named, F.lower(p.stem(F.col("target"))) == F.col("base"), "left")
    )
    to = F.coalesce("exact", "with_md", "by_name")
    return known.where(to.isNotNull()).select(F.concat(F.lit("note:"), "rel_path").alias("from_id"), to.alias("to_id")).distinct()


def inline_tags(notes: DataFrame) -> DataFrame:
    """rel_path, tag: lower-cased tags of the text after the frontmatter, once a note."""
    found = F.regexp_extract_all(body_of(F.col("text")), F.lit(TAG), F.lit(1))
    return notes.select("rel_path", F.explode(F.array_distinct(F.transform(found, F.lower))).alias("tag"))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def canvas_edges(canvases: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_id, to_id of the file nodes of canvases (rel_path, text) that lead to a note, canvas or attachment; a canvas that isn't valid JSON gives none."""
    parsed = canvases.select("rel_path", F.from_json("text", CANVAS).alias("c"))
    files = parsed.select("rel_path", F.explode("c.nodes").alias("f")).where("f.type = 'file' and f.file != ''").select("rel_path", F.col("f.file").alias("target")).distinct()
    tries = files.select("rel_path", "target", F.posexplode(F.transform(F.array(*map(F.lit, ("note:", "canvas:", "attachment:"))), lambda k: F.concat(k, F.col("target")))).alias("rank", "id"))
    best = tries.join(nodes.select("id").distinct(), "id").groupBy("rel_path", "target").agg(F.min_by("id", "rank").alias("to_id"))
    return best.select(F.concat(F.lit("canvas:"), "rel_path").alias("from_id"), "to_id")


def frontmatter(df: DataFrame, text: str) -> DataFrame:
    """Rows with a struct ``fm`` of title, aliases, tags, type and status; null where the block is missing or isn't YAML.

    YAML has no built-in parser; blocks alone go to Python, as Arrow.
    """
    import pandas as pd

    ship(df.sparkSession)

    def run(blocks):
        import yaml

        def one(block):
            empty = {"ok": False, "title": None, "aliases": None, "tags": None, "type": None, "status": None}
            if block is None:
                return empty
            try:
                found = yaml.load(block, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
            except Exception:  # any malformed block counts as none
                return empty
            if not isinstance(found, dict):
                return empty | {"ok": found is None}
            out = {"ok": True}
            for k in ("title", "type", "status"):
                v = found.get(k)
                out[k] = None if v is None else str(v)
            for k in ("aliases", "tags"):
                v = found.get(k)
                out[k] = [str(x) for x in v if x is not None] if isinstance(v, list) else None
            return out

        return pd.DataFrame([one(b) for b in blocks], columns=["ok", "title", "aliases", "tags", "type", "status"])

    parse = F.pandas_udf(run, "ok boolean, " + FRONTMATTER)
    parsed = df.withColumn("_fm", parse(block_of(F.col(text))))
    return parsed.withColumn("fm", F.when(F.col("_fm.ok"), F.struct(*[f"_fm.{c}" for c in ("title", "aliases", "tags", "type", "status")]))).drop("_fm")


def note_metadata(notes: DataFrame) -> DataFrame:
    """rel_path and metadata of notes (rel_path, text): title (else from the file name), sorted aliases and tags, type and status."""
    fm = frontmatter(notes, "text")
    pairs = {
        "title": F.when(F.col("fm.title") != "", F.col("fm.title")).otherwise(p.title_of(F.col("rel_path"))),
        "aliases": p.join_canonical(F.col("fm.aliases")),
        "tags": p.join_canonical(F.col("fm.tags")),
        "type": F.col("fm.type"),
        "status": F.col("fm.status"),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs.items()]), lambda e: e["v"].isNotNull() & (e["v"] != ""))
    return fm.select("rel_path", F.map_from_entries(entries).alias("metadata"))


def is_note(path: Column) -> Column:
    """Whether a file's path makes it a note: a markdown file that no intent or festival task owns."""
    s = p.segments(path)
    task = path.startswith("festivals/") & (F.size(s) >= 5) & F.coalesce(F.get(s, F.lit(3)).rlike("^[0-9]{3}_"), F.lit(False)) & path.endswith(".md")
    return p.extension(path).isin(NOTE_EXTENSIONS) & ~path.startswith(".campaign/intents/") & ~task
