"""Full-text search: a positional inverted index, BM25 ranking, filters, modes, resolution and related items.

An index is two tables: ``postings`` (term, node_id, col, pos) and ``sizes`` (node_id, len). A search over a stored index
reads only the postings of its terms; one over plain documents counts its phrases in a single pass, without a shuffle.
Statistics are those of the whole index, whatever the filters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import phrases, snippet, tokens
from lodegraph.session import cut, shuffle_partitions, ship

COLUMNS = ["title", "rel_path", "scope", "body", "summary", "aliases", "tags"]
K1, B, FLOOR = 1.2, 0.75, 1e-6
MODES = ("structural", "explicit", "semantic", "hybrid")
SCOPE_SCORE = 0.7


@dataclass(frozen=True)
class Options:
    """A search: ``term``, filters, ``mode`` and ``limit`` (20 if not positive)."""

    term: str
    scope: str = ""
    path_prefix: str = ""
    type: str = ""
    tracked: bool = False
    untracked: bool = False
    mode: str = "hybrid"
    limit: int = 20


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    sizes: DataFrame
    stored: bool = False

    def by_term(self, files: int | None = None) -> DataFrame:
        """The postings laid out to be stored: sorted by term within hash ranges of it, so that a search skips all other row groups."""
        files = files or shuffle_partitions(self.postings.sparkSession)
        return self.postings.repartition(files, "term").sortWithinPartitions("term", "node_id")

    def save(self, path: str, files: int | None = None) -> None:
        """Write the index below a path."""
        self.by_term(files).write.mode("overwrite").parquet(f"{path}/postings")
        self.sizes.write.mode("overwrite").parquet(f"{path}/sizes")


def load_index(docs: DataFrame, path: str) -> Index:
    read = docs.sparkSession.read.parquet
    return Index(docs, read(f"{path}/postings"), read(f"{path}/sizes"), True)


def available(index: Index) -> bool:
    """Whether a search over the index runs, told by one for a word."""
    try:
        index.postings.where("term = 'noop'").limit(1).collect()
        index.sizes.limit(1).collect()
    except Exception:  # whatever the storage throws
        return False
    return True


def parse_mode(text: str) -> str:
    """A mode in any case; what isn't one is hybrid."""
    return text.lower() if text.lower() in MODES else "hybrid"


def _split(docs: DataFrame) -> DataFrame:
    """node_id and the tokens of each column; lists count by their values, nulls as empty."""
    def text(c: str) -> Column:
        plain = F.array_join(c, " ") if docs.schema[c].dataType.typeName() == "array" else F.col(c)
        return tokens(F.coalesce(plain, F.lit("")))

    return docs.select("node_id", F.array(*[text(c) for c in COLUMNS]).alias("t"))


def _len() -> Column:
    return F.aggregate("t", F.lit(0), lambda n, x: n + F.size(x)).alias("len")


def build_index(docs: DataFrame) -> Index:
    """The index of documents with the columns COLUMNS."""
    split = _split(docs)
    sizes = split.select("node_id", _len())
    postings = split.select("node_id", F.posexplode("t").alias("col", "w")).select("node_id", "col", F.posexplode("w").alias("pos", "term"))
    return Index(docs, postings.select("term", "node_id", "col", "pos"), sizes)


def phrase_hits(index: Index, wanted: list[list[str]]) -> DataFrame:
    """phrase, node_id, f: how often each phrase occurs in a document; a phrase never spans columns."""
    some = index.postings.where(F.col("term").isin(sorted({t for p in wanted for t in p})))
    parts = []
    for n, phrase in enumerate(wanted):
        at = some.where(F.col("term") == phrase[0]).select("node_id", "col", "pos")
        for k, term in enumerate(phrase[1:], 1):
            following = some.where(F.col("term") == term).select("node_id", "col", (F.col("pos") - k).alias("pos"))
            at = at.join(following, ["node_id", "col", "pos"])
        parts.append(at.groupBy("node_id").agg(F.count(F.lit(1)).alias("f")).select(F.lit(n).alias("phrase"), "node_id", "f"))
    return reduce(DataFrame.unionByName, parts)


def occurrences(index: Index, wanted: list[list[str]]) -> DataFrame:
    """node_id, len, f (array): how often each phrase occurs in every document of the index."""
    def count(phrase: list[str]) -> Column:
        k, p = len(phrase), F.array(*map(F.lit, phrase))

        def one(w: Column) -> Column:
            if k == 1:
                return F.size(F.filter(w, lambda x: x == phrase[0]))
            starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
            return F.size(F.filter(starts, lambda i: (F.element_at(w, i) == phrase[0]) & (F.slice(w, i, k) == p)))

        return F.aggregate("t", F.lit(0), lambda n, w: n + one(w))

    if not index.stored:
        # Written once, a few bytes a document: a filter pushed below the counts would tokenise every text again.
        return cut(_split(index.docs).select("node_id", _len(), F.array(*[count(p) for p in wanted]).alias("f")))
    hits = phrase_hits(index, wanted).groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("phrase", "f"))).alias("m"))
    f = F.array(*[F.coalesce(F.col("m")[n], F.lit(0)).cast("int") for n in range(len(wanted))])
    return index.sizes.join(hits, "node_id", "left").select("node_id", "len", f.alias("f"))


def bm25(index: Index, wanted: list[list[str]]) -> DataFrame:
    """node_id, score of all documents with a hit. Phrases are added in order, so that sums are the same on every run."""
    occ = occurrences(index, wanted)
    n = [F.count_if(F.col("f")[i] > 0) for i in range(len(wanted))]
    corpus = occ.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"), F.array(*n).alias("n"))
    idf = F.transform("n", lambda k: F.log((F.col("docs") - k + 0.5) / (k + 0.5)))
    corpus = corpus.select("avg_len", F.transform(idf, lambda x: F.when(x <= 0, F.lit(FLOOR)).otherwise(x)).alias("idf"))
    # The other side is one row.
    known = occ.where(F.exists("f", lambda x: x > 0)).join(F.broadcast(corpus), F.lit(True))
    room = K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    score = sum((F.col("idf")[i] * F.col("f")[i] * (K1 + 1) / (F.col("f")[i] + room) for i in range(len(wanted))), F.lit(0.0))
    return known.select("node_id", score.alias("score"))


def _filters(o: Options) -> list[Column]:
    out = []
    if o.scope:
        out.append(F.col("scope") == o.scope)
    if o.path_prefix:
        out.append((F.col("rel_path") == o.path_prefix) | F.lower("rel_path").like(o.path_prefix.lower() + "/%"))
    if o.tracked != o.untracked:
        out.append(F.col("tracked_state") == ("tracked" if o.tracked else "untracked"))
    if o.type:
        out.append(F.col("type") == o.type)
    return out


def reasons(term: str, scope: str) -> Column:
    low = term.lower()
    return F.array_compact(
        F.array(
            F.lit("fts_match"),
            F.when(F.contains(F.lower("rel_path"), F.lit(low)), "exact_path_token"),
            F.when(F.contains(F.lower("title"), F.lit(low)), "title_match"),
            F.when((F.lit(scope) != "") & (F.col("scope") == scope), "same_scope"),
        )
    )


def boost(mode: str) -> Column:
    has = [F.array_contains("reasons", r) for r in ("same_scope", "exact_path_token", "title_match")]
    scoped, named = has[0], has[1] | has[2]
    if mode == "structural":
        return F.when(scoped, 1.5).otherwise(1.0)
    if mode == "explicit":
        return F.when(named, 1.35).otherwise(1.0)
    if mode == "semantic":
        return F.lit(1.0)
    return F.when(scoped, 1.2).otherwise(1.0) * F.when(named, 1.2).otherwise(1.0)


def search(index: Index, nodes: DataFrame, o: Options) -> DataFrame:
    """node_id, type, title, rel_path, scope, score, bm25, reasons of the page, to be ordered by (score desc, bm25 desc, node_id).

    The page is cut by BM25 alone, then scores are boosted and the page re-ordered. A term without tokens gives no rows.
    """
    wanted = phrases(o.term)
    docs = index.docs.select("node_id", "title", "rel_path", "scope", "tracked_state").join(nodes.select(F.col("id").alias("node_id"), "type"), "node_id")
    for c in _filters(o):
        docs = docs.where(c)
    if not wanted:
        return docs.limit(0).select("node_id", "type", "title", "rel_path", "scope", F.lit(0.0).alias("score"), F.lit(0.0).alias("bm25"), F.array(F.lit("")).alias("reasons"))
    found = bm25(index, wanted).withColumnRenamed("score", "bm25").join(docs, "node_id")
    page = found.orderBy(F.col("bm25").desc(), "node_id").limit(o.limit if o.limit > 0 else 20)
    page = page.withColumn("reasons", reasons(o.term, o.scope))
    return page.select("node_id", "type", "title", "rel_path", "scope", (F.col("bm25") * boost(o.mode)).alias("score"), "bm25", "reasons")


def ordered(page: DataFrame) -> DataFrame:
    return page.orderBy(F.col("score").desc(), F.col("bm25").desc(), "node_id")


def with_snippets(page: DataFrame, docs: DataFrame, term: str) -> DataFrame:
    """The page with a snippet of each body; bodies are read for the page's documents only."""
    ship(page.sparkSession)
    wanted = phrases(term)

    def run(bodies):
        return bodies.map(lambda b: snippet(b, wanted))

    cut_out = F.pandas_udf(run, "string")
    return page.join(docs.select("node_id", "body"), "node_id").withColumn("snippet", cut_out("body")).drop("body")


def resolve(index: Index, nodes: DataFrame, text: str, by_name: bool = False) -> DataFrame:
    """node_id, reason of the node that a text names: an id, a document's path, a node's path (as given, then without ``./``), else the top hit, and with ``by_name`` at last a node's name. At most one row."""
    text = text.strip()
    if not text:
        return nodes.limit(0).select(F.col("id").alias("node_id"), F.lit("").alias("reason"))
    bare = text.removeprefix("./")
    tries = [
        nodes.where(F.col("id") == text).select("id", F.lit(0).alias("p"), F.lit("exact_id").alias("reason")),
        index.docs.where(F.col("rel_path") == text).select(F.col("node_id").alias("id"), F.lit(1).alias("p"), F.lit("exact_rel_path").alias("reason")),
        nodes.where(F.col("path") == text).select("id", F.lit(2).alias("p"), F.lit("exact_rel_path").alias("reason")),
        index.docs.where(F.col("rel_path") == bare).select(F.col("node_id").alias("id"), F.lit(3).alias("p"), F.lit("exact_rel_path").alias("reason")),
        ordered(search(index, nodes, Options(text, limit=1))).select(F.col("node_id").alias("id"), F.lit(4).alias("p"), F.lit("top_hit").alias("reason")),
    ]
    if by_name:
        tries.append(nodes.where(F.col("name") == text).select("id", F.lit(5).alias("p"), F.lit("exact_name").alias("reason")))
    return reduce(DataFrame.unionByName, tries).orderBy("p", "id").limit(1).select(F.col("id").alias("node_id"), "reason")


def explicit_items(edges: DataFrame, nodes: DataFrame, docs: DataFrame, node_id: str) -> DataFrame:
    """Neighbours by explicit edges in either direction."""
    explicit = edges.where("source = 'explicit'")
    near = explicit.where(F.col("from_id") == node_id).select(F.col("to_id").alias("id"), "confidence").unionByName(
        explicit.where(F.col("to_id") == node_id).select(F.col("from_id").alias("id"), "confidence")
    )
    paths = docs.select(F.col("node_id").alias("id"), "title", "rel_path")
    known = near.where(F.col("id") != node_id).join(nodes.select("id", "type", "name", "path"), "id").join(paths, "id", "left")
    return known.select(F.lit(0).alias("bucket"), F.col("id").alias("node_id"), "type", F.coalesce("title", "name").alias("title"), F.coalesce("rel_path", "path").alias("rel_path"), F.col("confidence").alias("score"), F.lit("explicit_edge").alias("reason"))


def scope_items(docs: DataFrame, nodes: DataFrame, path: str, node_id: str) -> DataFrame:
    """Documents of the folder the path lies in."""
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    near = docs.where((F.col("scope") == folder) & (F.col("node_id") != node_id))
    return near.join(nodes.select(F.col("id").alias("node_id"), "type"), "node_id").select(F.lit(1).alias("bucket"), "node_id", "type", "title", "rel_path", F.lit(SCOPE_SCORE).alias("score"), F.lit("same_scope").alias("reason"))


def lexical_items(index: Index, nodes: DataFrame, path: str, node_id: str, limit: int) -> DataFrame:
    """Hits of the path's file name without its extension."""
    name = path.rsplit("/", 1)[-1]
    term = name.rsplit(".", 1)[0] if name.rfind(".") > 0 else name
    page = search(index, nodes, Options(term, limit=limit + 1)).where(F.col("node_id") != node_id)
    return page.select(F.lit(2).alias("bucket"), "node_id", "type", "title", "rel_path", "score", F.lit("lexical_match").alias("reason"))


def related(index: Index, nodes: DataFrame, edges: DataFrame, path: str, mode: str = "hybrid", limit: int = 10) -> DataFrame:
    """bucket, node_id, type, title, rel_path, score, reason of the items related to a path, to be ordered by (bucket, score desc, node_id).

    Explicit edges come first, then the same folder, then lexical hits; an item counts in its first bucket. An empty path
    is an error, one that names nothing has no items.
    """
    if not path.strip():
        raise ValueError("a path is needed")
    limit = limit if limit > 0 else 10
    at = resolve(index, nodes, path).head()
    node_id = at["node_id"] if at else None
    parts = []
    if mode in ("hybrid", "explicit", ""):
        parts.append(explicit_items(edges, nodes, index.docs, node_id or ""))
    if mode in ("hybrid", "structural", ""):
        parts.append(scope_items(index.docs, nodes, path, node_id or ""))
    if mode in ("hybrid", "semantic", ""):
        parts.append(lexical_items(index, nodes, path, node_id or "", limit))
    items = reduce(DataFrame.unionByName, parts)
    if node_id is None:
        return items.limit(0)
    item = F.struct("bucket", (-F.col("score")).alias("_s"), "type", "title", "rel_path", "score", "reason")
    best = items.groupBy("node_id").agg(F.min(item).alias("i")).select("i.bucket", "node_id", "i.type", "i.title", "i.rel_path", "i.score", "i.reason")
    return best.orderBy("bucket", F.col("score").desc(), "node_id").limit(limit)
