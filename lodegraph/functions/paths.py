"""Scalar functions on paths, titles and lists, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def extension(path: Column) -> Column:
    """Lower-cased extension of the last segment without its dot, '' if none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def stem(path: Column) -> Column:
    """The last segment without its extension; names that start with their only dot stay whole."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def depth(path: Column) -> Column:
    """Number of segments; '' and '.' have 0."""
    return F.when(path.isin("", "."), F.lit(0)).otherwise(F.size(segments(path)))


def parent(path: Column) -> Column:
    """The folder above; '.' at the top."""
    clean = F.regexp_replace(path, "^/+|/+$", "")
    above = F.regexp_extract(clean, "^(.*)/[^/]*$", 1)
    return F.when(above == "", ".").otherwise(above)


def ancestors(path: Column) -> Column:
    """All folders above from the topmost down: a/b/c.md gives [a, a/b]; [] at the top."""
    clean = F.regexp_replace(F.regexp_replace(path, r"^\./", ""), "^/+|/+$", "")
    parts = segments(clean)
    some = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) > 1, some).otherwise(F.array().cast("array<string>"))


def clean(path: Column) -> Column:
    """A relative path without empty, ``.`` and ``..`` segments; null if it climbs above its root."""
    up = F.lit("..")
    folded = F.aggregate(
        segments(path),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s.isin("", "."), done)
        .when((s == up) & (F.size(done) > 0) & (F.element_at(done, -1) != up), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    return F.when(F.get(folded, F.lit(0)) == up, None).otherwise(F.when(F.size(folded) == 0, ".").otherwise(F.array_join(folded, "/")))


def resolve(base_file: Column, target: Column) -> Column:
    """A link target relative to the file that holds it (from the root if it starts with ``/``), cleaned; null above the root."""
    folder = parent(base_file)
    joined = F.when(target.startswith("/"), F.substr(target, F.lit(2))).when(folder == ".", target).otherwise(F.concat(folder, F.lit("/"), target))
    return clean(joined)


def title_of(path: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(basename(path), r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")))


def join_canonical(values: Column) -> Column:
    """Trimmed, non-empty, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")), ",")


def split_canonical(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def name_tokens(text: Column) -> Column:
    """Distinct lower-cased parts between separators, of three bytes or more."""
    parts = F.split(F.lower(text), r"[ \-_/.,()\[\]:]+")
    return F.array_distinct(F.filter(parts, lambda t: F.octet_length(t) >= 3))


def artifact_scope(path: Column) -> Column:
    """projects/<name> or festivals/<stage>/<name> that owns a path, else null."""
    s = segments(path)
    project = (F.size(s) >= 3) & (s[0] == "projects")
    festival = (F.size(s) >= 4) & (s[0] == "festivals")
    return F.when(project, F.array_join(F.slice(s, 1, 2), "/")).when(festival, F.array_join(F.slice(s, 1, 3), "/"))


def saturate(weight: Column) -> Column:
    return F.when(weight <= 0, F.lit(0.0)).when(weight >= 1, F.lit(1.0)).otherwise(1 - (1 - weight) * (1 - weight))


def round3(x: Column) -> Column:
    """Half up to three places, for x >= 0."""
    return F.floor(x * 1000 + 0.5) / 1000


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def file_safe(node_id: Column) -> Column:
    """An id as part of a file name."""
    return F.translate(node_id, "/:\\", "___")


def dot_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def parse_time(text: Column) -> Column:
    """RFC 3339 to a timestamp, null if it isn't."""
    return F.try_to_timestamp(text)


def format_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
