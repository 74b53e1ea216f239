"""Near-duplicate documents by a chosen-path join.

A document is the set of its shingles. In each of several independent runs all documents start in one bucket; a bucket is
split on sampled shared tokens: a document goes to the child bucket of each of its tokens whose hash with the path so far
is below ``branching / |set|``. Two sets that overlap enough choose a common child more than once on average, others less
than once, so that like ones stay together down the recursion while the rest drift apart. Buckets small enough are
compared by brute force on sketches that travel with the rows, as they stream by in the order of their paths; larger ones
split again. A bucket that a split leaves more than half as large holds documents that are alike and is compared in
blocks, whole. Runs repeat until the chance to have missed a pair is below ``1 - recall`` for any pair at the threshold.
Pairs that the sketches tell are verified on the whole sets, which move only for documents that need them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.similar import in_blocks, slices
from lodegraph.operators.heavy_keys import PART, heavy_hitters
from lodegraph.session import cut, ship, shuffle_partitions

SHINGLE, LEAST_SHINGLES, THRESHOLD, RECALL = 3, 20, 0.6, 0.99
BRANCHING = 3.0  #: children a document takes on average at each split
BUCKET = 4096  #: largest bucket compared by brute force at once: some 4 us a row, about what another split of it costs
DEPTH = 12  #: splits at most; what is still large then is compared in blocks
CODES_MOST = 250_000  #: documents whose codes, or buckets whose paths (8 bytes each), are broadcast at most; more are joined by shuffle
HOT_LEAST = 250_000  #: rows of a bucket from which it isn't moved into one part
SKETCH_WORDS, DEVIATIONS = 4, 4.5  #: 64-bit words of a sketch, and what it may be off by
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def runs_for(threshold: float, recall: float, branching: float = BRANCHING) -> int:
    """Runs until any pair at the threshold is met with probability ``recall``.

    A pair takes at least ``threshold * branching`` common children on average, about Poisson; the chance q that it still
    shares a bucket after any number of splits solves q = 1 - exp(-mean q).
    """
    mean, q = threshold * branching, 1.0
    for _ in range(500):
        q = 1 - math.exp(-mean * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(docs: DataFrame, text: Column, shingle: int = SHINGLE, least: int = LEAST_SHINGLES, words: int = SKETCH_WORDS) -> DataFrame:
    """node_id, tokens, h1, h2, n, s0.. of the documents (node_id, columns of ``text``) with at least ``least`` shingles.

    tokens are the sorted distinct hashes of ``shingle`` successive words (runs of letters and digits, lower-cased), h1 and
    h2 a 128-bit hash of them, s0.. a one-bit minwise sketch: equal bits are 1/2 + J/2 of all on average.
    """
    ship(docs.sparkSession)
    factors = (_mix(np.arange(1, 64 * words + 1, dtype=np.uint64) * _GOLDEN) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shifts = np.arange(64, dtype=np.uint64)
    names = ["node_id", "tokens", "h1", "h2", "n", *[f"s{k}" for k in range(words)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            lists = batch.column(1)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            coded = lists.flatten().dictionary_encode()
            by_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            word = by_word[coded.indices.to_numpy()]
            hashed = np.zeros(max(len(word) - shingle + 1, 0), np.uint64)
            for i in range(shingle):
                hashed = _mix(hashed * _GOLDEN + word[i : len(word) - shingle + 1 + i])
            sets, kept = [], []
            for i in range(len(lists)):
                if at[i + 1] - at[i] >= shingle - 1 + least:
                    one = np.unique(hashed[at[i] : at[i + 1] - shingle + 1])
                    if len(one) >= least:
                        sets.append(one)
                        kept.append(i)
            sketch = np.zeros((len(sets), words), np.uint64)
            digests = np.zeros((len(sets), 2), np.uint64)
            for i, one in enumerate(sets):
                whole = xxhash.xxh3_128_intdigest(one.tobytes())
                digests[i] = whole >> 64, whole & (2**64 - 1)
                short, smallest = (one >> np.uint64(32)).astype(np.uint32), np.full(64 * words, np.iinfo(np.uint32).max)
                for part in range(0, len(short), 1024):
                    np.minimum(smallest, (short[part : part + 1024, None] * factors).min(0), out=smallest)
                bits = (_mix(smallest.astype(np.uint64) + np.uint64(1)) & np.uint64(1)).reshape(words, 64)
                sketch[i] = (bits << shifts).sum(1, dtype=np.uint64)
            ends = np.cumsum([0, *map(len, sets)])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64)))
            longs = [digests[:, 0], digests[:, 1]], [sketch[:, k] for k in range(words)]
            signed = [[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in part] for part in longs]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), tokens, *signed[0], pa.array(np.diff(ends), pa.int32()), *signed[1]], names=names)

    found = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))
    schema = "node_id string, tokens array<bigint>, h1 bigint, h2 bigint, n int, " + ", ".join(f"s{k} bigint" for k in range(words))
    return docs.select("node_id", found.alias("words")).mapInArrow(run, schema)


def _split(rows: DataFrame, starts: list[int] | None, branching: float, large: list[tuple[np.ndarray, np.ndarray]] = ()) -> DataFrame:
    """path, code, n, sketch, parent (size of the bucket above) of the rows in child buckets.

    ``rows`` has code, tokens, n, sketch. With ``starts``, the first paths of the runs, each row is split from there on, and
    once more below each of ``large``: by level, the sorted paths and the sizes of the buckets that go on. Without, rows have
    the path to split and the parent.
    """
    ship(rows.sparkSession)
    sketch = _sketch(rows)
    along = ["n", *sketch]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tokens"):
            lists, code = batch.column("tokens"), batch.column("code")
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sizes = np.diff(at)
            values = lists.flatten().to_numpy().view(np.uint64)
            limits = (np.minimum(branching / np.maximum(sizes, 1), 0.999999) * 2.0**64).astype(np.uint64)

            def below(of: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Places in ``of`` and paths of the children of rows ``of`` in buckets ``path``."""
                each = np.repeat(np.arange(len(of)), sizes[of])
                token = np.arange(len(each)) - np.repeat(np.cumsum(sizes[of]) - sizes[of], sizes[of]) + np.repeat(at[of], sizes[of])
                taken = np.flatnonzero(_mix(values[token] + _mix(path + _GOLDEN)[each]) < limits[of][each])
                each, token = each[taken], token[taken]
                return each, _mix(_mix(values[token] ^ _M2) + path[each] * _GOLDEN)

            every = np.arange(len(batch))
            for start in [None] if starts is None else starts:
                path = batch.column("path").to_numpy().view(np.uint64) if start is None else np.full(len(batch), start, np.uint64)
                of, path = below(every, path)
                parent = batch.column("parent").take(pa.array(of)) if start is None else pa.nulls(len(of), pa.int64())
                for paths, above in large:
                    place = np.minimum(np.searchsorted(paths, path), len(paths) - 1)
                    on = np.flatnonzero(paths[place] == path)
                    from_, path = below(of[on], path[on])
                    of, parent = of[on][from_], pa.array(above[place[on]][from_])
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), code.take(pa.array(of)), parent, *[batch.column(x).take(pa.array(of)) for x in along]], names=["path", "code", "parent", *along])

    given = [] if starts else ["path", "parent"]
    schema = "path bigint, code bigint, parent bigint, n int, " + ", ".join(f"{x} bigint" for x in sketch)
    return rows.select("code", "tokens", *along, *given).mapInArrow(run, schema)


def _sketch(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0] == "s" and c[1:].isdigit()]


def _most(bits: int, threshold: float) -> int:
    """Bits of a sketch that may differ: those expected at the threshold and DEVIATIONS standard deviations more, which one pair in 300,000 at the threshold exceeds."""
    differ = (1 - threshold) / 2
    return int(bits * differ + DEVIATIONS * math.sqrt(bits * differ * (1 - differ)))


def _near(sizes: np.ndarray, words: np.ndarray, threshold: float, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows ``x``, ``y`` that may be alike by sketch and size."""
    near = np.bitwise_count(words[x] ^ words[y]).sum(1, dtype=np.int64) <= _most(64 * words.shape[1], threshold)
    near &= np.minimum(sizes[x], sizes[y]) >= np.maximum(sizes[x], sizes[y]) * threshold
    return x[near], y[near]


def near_pairs(sizes: np.ndarray, words: np.ndarray, threshold: float, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a row of ``left`` and one of ``right`` that may be alike."""
    front = min(2, words.shape[1])  # half of the sketch leaves few pairs to the rest
    most, found, columns = _most(64 * front, threshold), [], [np.ascontiguousarray(words[:, k]) for k in range(front)]
    for begin in range(0, len(left), 256):
        some = left[begin : begin + 256]
        apart = sum(np.bitwise_count(c[some, None] ^ c[None, right]) for c in columns)
        x, y = np.nonzero(apart <= most)
        found.append(_near(sizes, words, threshold, some[x], right[y]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def bucket_pairs(path: np.ndarray, code: np.ndarray, n: np.ndarray, words: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes (smaller first) of the pairs that may be alike within each run of equal ``path``; codes ascend within a run, repeats are no pair."""
    if len(path) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(path)))
    last = np.repeat(starts + sizes, sizes)  # the end of each row's run
    few = np.repeat(sizes <= 32, sizes)
    xs, ys = [], []
    # Short runs all together, by the distance of the two rows.
    at = np.flatnonzero(few)
    for away in range(1, 32):
        at = at[at + away < last[at]]
        if not len(at):
            break
        x, y = _near(n, words, threshold, at, at + away)
        xs.append(x)
        ys.append(y)
    for begin, size in zip(starts[sizes > 32], sizes[sizes > 32]):
        own = np.arange(begin, begin + size)
        x, y = near_pairs(n, words, threshold, own, own)
        xs.append(x[x < y])
        ys.append(y[x < y])
    a, b = (code[np.concatenate(c)] if c else np.zeros(0, np.int64) for c in (xs, ys))
    return a[a != b], b[a != b]


def _meet(rows: DataFrame, threshold: float, bucket: int, most: int | None = None) -> DataFrame:
    """a, b of the pairs that may be alike in buckets of at most ``bucket`` rows; path, a, parent of the rows of larger ones.

    Rows stream by in the order of their paths, at most ``bucket`` are held. The rows of paths that a sketch over all
    tells to be a good part of a partition aren't moved: they are in larger buckets anyway. No bucket has over ``most`` rows.
    """
    ship(rows.sparkSession)
    parts = shuffle_partitions(rows.sparkSession)
    hot = cut(heavy_hitters(rows, "path", 1 / (PART * parts), least=max(bucket + 1, HOT_LEAST))) if most is None or most >= HOT_LEAST else None
    sketch = _sketch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "a", "b", "parent"]
        held: dict[str, np.ndarray] | None = None  # the rows of the last path, as long as they are few
        large = None  # the path whose rows are too many

        def beyond(rows: dict[str, np.ndarray], begin: int, end: int) -> pa.RecordBatch:
            parent = pa.array(rows["parent"][begin:end]) if rows["parent"] is not None else pa.nulls(end - begin, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(rows["path"][begin:end]), pa.array(rows["code"][begin:end]), pa.nulls(end - begin, pa.int64()), parent], names=names)

        def met(rows: dict[str, np.ndarray], end: int) -> pa.RecordBatch:
            a, b = bucket_pairs(*(rows[x][:end] for x in ("path", "code", "n", "words")), threshold)
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(a), pa.array(b), none], names=names)

        for batch in batches:
            rows = {x: batch.column(x).to_numpy() for x in ("path", "code", "n")}
            rows["words"] = np.stack([batch.column(x).to_numpy().view(np.uint64) for x in sketch], 1)
            # All rows of a level have a parent, or none has.
            rows["parent"] = batch.column("parent").to_numpy() if len(batch) and batch.column("parent").null_count == 0 else None
            if held is not None:
                rows = {x: np.concatenate([held[x], v]) if v is not None else None for x, v in rows.items()}
                held = None
            path = rows["path"]
            starts = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1]) if len(path) else np.zeros(0, int)
            ends = np.append(starts[1:], len(path))
            done, first = len(path), 0
            if len(starts):
                # The last path may go on in the next batch; rows of large ones leave at once.
                if path[-1] != large and ends[-1] - starts[-1] <= bucket:
                    done = int(starts[-1])
                    held = {x: v[done:] if v is not None else None for x, v in rows.items()}
                    ends, starts = ends[:-1], starts[:-1]
                for begin, end in zip(starts, ends):
                    if end - begin > bucket or path[begin] == large:
                        if begin > first:
                            yield met({x: v[first:] if v is not None else None for x, v in rows.items()}, begin - first)
                        yield beyond(rows, begin, end)
                        large, first = path[begin], end
                if done > first:
                    yield met({x: v[first:] if v is not None else None for x, v in rows.items()}, done - first)
        if held is not None:
            yield met(held, len(held["path"]))

    any_hot = hot is not None and not hot.isEmpty()
    on = F.xxhash64(rows["path"]) == hot["heavy"] if any_hot else None
    cold = (rows.join(F.broadcast(hot), on, "left_anti") if any_hot else rows).repartition(parts, "path").sortWithinPartitions("path", "code")
    moved = cold.mapInArrow(run, "path bigint, a bigint, b bigint, parent bigint")
    if not any_hot:
        return moved
    return moved.unionByName(rows.join(F.broadcast(hot), on, "left_semi").select("path", F.col("code").alias("a"), F.lit(None).cast("bigint").alias("b"), "parent"))


def _block_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs that may be alike in buckets (path, code, n, sketch, size) of any size, block against block."""
    ship(rows.sparkSession)
    sketch = _sketch(rows)

    def compare(table: pa.Table) -> pa.Table:
        code, first = table["code"].to_numpy(), table["mine"].to_numpy() == table["p"][0].as_py()
        two = table["p"][0].as_py() != table["q"][0].as_py()
        left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if two else (np.arange(len(code)),) * 2
        x, y = near_pairs(table["n"].to_numpy(), np.stack([table[s].to_numpy().view(np.uint64) for s in sketch], 1), threshold, left, right)
        x, y = code[x], code[y]
        keep = (x != y) if two else x < y
        return pa.table({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep]})

    laid = in_blocks(rows.select("path", "code", "n", *sketch, "size"), "path", F.col("size"), "code", 1024).repartition(4 * shuffle_partitions(rows.sparkSession), "path", "p", "q")
    return laid.groupBy("path", "p", "q").applyInArrow(compare, "a bigint, b bigint")


def _picked(reps: DataFrame, codes: DataFrame) -> DataFrame:
    """The rows of ``reps`` whose code is one of ``codes``; few codes go to them by broadcast, more by shuffle."""
    codes = cut(codes.select("code").distinct())
    return reps.join(F.broadcast(codes) if codes.count() <= CODES_MOST else codes, "code", "left_semi")


def classes_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (code, node_id) and representatives (code, tokens, n, sketch) of the classes of equal sets.

    Equality is told by the sets' 128-bit hashes and sizes.
    """
    # Rows of a checkpointed table keep their place, so the number given to them is the same each time.
    keyed, same = cut(sets).withColumn("code", F.monotonically_increasing_id()), ["h1", "h2", "n"]
    firsts = keyed.groupBy(*same).agg(F.min("code").alias("first"))
    members = cut(keyed.select("node_id", "code", *same).join(firsts, same).select(F.col("first").alias("code"), "node_id", F.col("code").alias("own")))
    copies = members.where("own != code").select(F.col("own").alias("code"))
    copies = F.broadcast(copies) if copies.count() <= CODES_MOST else copies
    return members.select("code", "node_id"), keyed.drop("h1", "h2", "node_id").join(copies, "code", "left_anti")


def alike(reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, branching: float = BRANCHING, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """a, b (codes, a < b) of all pairs of representatives found whose Jaccard similarity is at least ``threshold``.

    Each pair is verified on whole sets. A pair at the threshold is missed with a chance below ``1 - recall``, a closer
    one far more rarely. No bucket is cut and no partner dropped: buckets above ``bucket`` split again, until they are
    smaller or, after ``depth`` splits or one that doesn't halve them, are compared in blocks.
    """
    starts = [int(x) for x in _mix(np.arange(1, runs_for(threshold, recall, branching) + 1, dtype=np.uint64) * _GOLDEN)]
    slim = reps.select("code", "n", *_sketch(reps))
    rows, candidates, most = _split(reps, starts, branching), [], reps.select("code").count()
    known: list[tuple[np.ndarray, np.ndarray]] | None = []  # paths that go on by level, while they are few
    for level in range(depth):
        met = cut(_meet(rows, threshold, bucket, most))
        candidates.append(met.where("b is not null").select("a", "b"))
        large = met.where("b is null").select("path", F.col("a").alias("code"), "parent")
        sizes = cut(large.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.max("parent").alias("was")))
        stays = F.coalesce(F.col("size") > F.col("was") / 2, F.lit(False)) if level < depth - 1 else F.lit(True)
        n_go, n_stay, most = sizes.agg(F.count_if(~stays), F.count_if(stays), F.max(F.when(~stays, F.col("size")))).head()
        if n_stay:
            dense = large.drop("parent").join(sizes.where(stays), "path")
            candidates.append(_block_pairs(dense.join(slim, "code"), threshold))
        if not n_go:
            break
        on = sizes.where(~stays).select("path", "size")
        if known is not None and n_go <= CODES_MOST:
            # Few paths go to the sets, which then move nowhere: each splits again from the start down to them.
            few = on.toPandas()
            paths = few["path"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(paths)
            known.append((paths[order], few["size"].to_numpy(np.int64)[order]))
            rows = _split(reps, starts, branching, known)
        else:
            known = None
            going = large.drop("parent").join(on, "path").select("path", "code", F.col("size").alias("parent"))
            rows = _split(going.join(_picked(reps, going), "code"), None, branching)
    pairs = cut(reduce(DataFrame.unionByName, candidates).distinct())
    sets = _picked(reps.select("code", "tokens"), pairs.select(F.explode(F.array("a", "b")).alias("code")))
    left, right = (sets.select(F.col("code").alias(c), F.col("tokens").alias(t)) for c, t in (("a", "t1"), ("b", "t2")))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("t1", "t2"))
    return both.where(shared >= F.lit(threshold) * (F.size("t1") + F.size("t2") - shared)).select("a", "b")


def near_duplicates(docs: DataFrame, key: str, text: Column, threshold: float = THRESHOLD, recall: float = RECALL, least: int = LEAST_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a, b) and members (code, node_id) of documents with at least ``least`` distinct shingles.

    ``docs`` has one row a document, ``text`` is a column of it; null texts and documents with fewer shingles take no
    part, documents with equal sets form one class, an empty table gives no rows, other columns are ignored. Whole texts
    count, of any length.
    """
    members, reps = classes_of(shingle_sets(docs.withColumnRenamed(key, "node_id"), text, least=least))
    return cut(alike(reps, threshold, recall)), members
