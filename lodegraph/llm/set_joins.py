"""All similar pairs between set-valued records by an extended-prefix join.

Values are dictionary-encoded as integers that order them from the rarest to the commonest. A pair at the threshold shares
at least alpha values, so its prefixes of n - alpha + l values share at least l. A key is first a single value of the short
prefix (l = 1). Keys that few records have are joined at once. A key that many have is extended, adaptively and only there:
the records take the longer prefix and the next key is the combination with one more shared value (l = 2, 3, ...). That
pays only while the longer keys tell records apart: they are counted first, and where they would not halve the candidates
(a cluster of records alike in most values), the key's records are compared in blocks instead, all of them. So each level
halves the work left, and neither keys nor levels grow without bound. The first l shared values of a pair belong to exactly
one key at every level, so each pair is a candidate exactly once. Of two records that both have the same frequent values
before a key, the first shared ones are not that key: they are told by a hash of these values and passed over there.
Candidates carry their sets and are verified where they meet: those of small keys in the join itself, those of large ones
block against block, by matrix products.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.similar import in_blocks
from lodegraph.session import cut, ship, shuffle_partitions

THRESHOLD, LEAST_VALUES = 0.6, 4
SMALL = 64  #: a key of at most so many records is joined at its level
BLOCK = 1024  #: records of a block where a larger key is compared
KEY_COST = 8  #: candidates that a longer key of one record costs as much as
_CLASS = 53  #: bits of a value's number below its class of frequency
_EPS = 1e-9


def normal_values(tags: Column) -> Column:
    """The distinct values: trimmed of spaces, without one leading ``#``, lower-cased, ``_`` and inner spaces as ``-``; nulls and empties dropped. Null gives an empty list."""
    clean = F.transform(tags, lambda v: F.translate(F.lower(F.regexp_replace(F.trim(v), "^#", "")), "_ ", "--"))
    return F.array_distinct(F.filter(F.coalesce(clean, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "")))


def _least_overlap(n: Column, m: Column, threshold: float) -> Column:
    return F.ceil((n + m) * F.lit(threshold / (1 + threshold)) - _EPS)


def classes_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (code, node_id) and sets (code, values) of the classes of equal sets of (node_id, values, side...)."""
    keyed = sets.withColumn("values", F.array_sort("values"))
    coded = cut(keyed.groupBy("values").agg(F.min("node_id").alias("first")).withColumn("code", F.monotonically_increasing_id()))
    return keyed.join(coded.select("code", "values"), "values").select("code", "node_id"), coded.select("code", "values")


def ordered(sets: DataFrame) -> DataFrame:
    """code, n, v: each set's values as integers, from the rarest to the commonest among all sets.

    A value's integer is its class of frequency (sixteen to each doubling) above a number of its own, dense within hash
    buckets, so that integers are as distinct as the values.
    """
    each = sets.select("code", F.explode("values").alias("value"))
    often = each.groupBy("value").agg(F.count(F.lit(1)).alias("often"))
    buckets = max(64, 4 * shuffle_partitions(sets.sparkSession))
    number = F.row_number().over(Window.partitionBy("_b").orderBy("value")).cast("bigint")
    shift = lambda c, bits: F.call_function("shiftleft", c, F.lit(bits))
    known = often.withColumn("_b", F.pmod(F.xxhash64("value"), F.lit(buckets))).select(
        "value", shift(_frequency_class(F.col("often")), _CLASS).bitwiseOR(shift(F.col("_b"), 36)).bitwiseOR(number).alias("v")
    )
    return each.join(known, "value").groupBy("code").agg(F.array_sort(F.collect_list("v")).alias("v")).select("code", F.size("v").alias("n"), "v")


def _frequency_class(often: Column) -> Column:
    return F.floor(F.log2(often) * 16).cast("bigint")


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """a, b (codes, a < b) of all pairs of distinct sets (code, values) whose Jaccard similarity is at least ``threshold``.

    Exact, but for the chance of 2**-64 a pair that two lists of frequent values have one hash.
    """
    alpha = F.ceil(F.col("n") * F.lit(threshold) - _EPS).cast("int")
    rows = cut(ordered(sets).withColumn("alpha", alpha))
    frequent = F.lit((math.floor(16 * math.log2(small)) + 1) << _CLASS)
    first = rows.select("code", "n", "alpha", "v", F.posexplode(F.slice("v", 1, F.col("n") - F.col("alpha") + 1)).alias("last", "value"))
    keys = first.select("code", "n", "alpha", "v", "last", F.array("value").alias("key"))
    parts, level = [], 1
    while True:
        before = F.filter(F.array_except(F.slice("v", 1, F.col("last")), F.col("key")), lambda x: x >= frequent)
        keys = keys.withColumn("g", F.when(F.size(before) > 0, F.xxhash64(before)).otherwise(F.lit(0).cast("bigint")))
        # Where all records of a key have the same frequent values before it, no pair's first shared ones are the key.
        counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("g").alias("_l"), F.max("g").alias("_m"))
        counted = counted.where("size > 1 and (_l != _m or _l = 0)").select("key", "size")
        keys = cut(keys.join(counted, "key"))
        parts.append(_pairs(keys.where(F.col("size") <= small), level, threshold))
        large = keys.where(F.col("size") > small)
        if large.isEmpty():
            break
        # What each large key would fall into, counted before anything is made of it.
        pairs = F.col("c") * (F.col("c") - 1) / 2
        children = _longer(large, level).groupBy("base", "value").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size"))
        cost = children.groupBy("base", "size").agg(F.sum(F.when(F.col("c") > 1, pairs + KEY_COST * F.col("c"))).alias("cost"))
        pays = F.coalesce("cost", F.lit(0.0)) < F.col("size") * (F.col("size") - 1) / 4
        chosen = cut(cost.where(pays).select(F.col("base").alias("key")))
        parts.append(_block_pairs(large.join(chosen, "key", "left_anti"), level, threshold, False))
        extended = large.join(chosen, "key", "left_semi")
        # Pairs that share exactly these values have no further one to extend by; they are compared here.
        parts.append(_block_pairs(extended.where(F.col("alpha") <= level), level, threshold, True))
        keys = _longer(extended, level).select("code", "n", "alpha", "v", "last", F.concat("base", F.array("value")).alias("key"))
        level += 1
    return reduce(DataFrame.unionByName, parts)


def _longer(rows: DataFrame, level: int) -> DataFrame:
    """Each record of a key (base) with each further value of its prefix for ``level`` + 1, at place ``last``."""
    end = F.least(F.col("n"), F.col("n") - F.col("alpha") + level + 1)
    more = F.slice("v", F.col("last") + 2, F.greatest(end - F.col("last") - 1, F.lit(0)))
    longer = rows.select("code", "n", "alpha", "v", "size", F.col("key").alias("base"), F.col("last").alias("from"), F.posexplode(more).alias("step", "value"))
    return longer.withColumn("last", F.col("from") + 1 + F.col("step"))


def _pairs(rows: DataFrame, level: int, threshold: float) -> DataFrame:
    """Verified pairs of small keys whose first ``level`` shared values are the key they meet in."""
    x, y = rows.alias("x"), rows.alias("y")
    n1, n2 = F.col("x.n"), F.col("y.n")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.code") < F.col("y.code"))
    near = ((F.col("x.g") != F.col("y.g")) | (F.col("x.g") == 0)) & (F.least(n1, n2) >= F.greatest(n1, n2) * F.lit(threshold) - _EPS)
    both = x.join(y, met & near).select(
        F.col("x.code").alias("a"), F.col("y.code").alias("b"), F.col("x.key").alias("key"), _least_overlap(n1, n2, threshold).alias("need"), F.array_intersect("x.v", "y.v").alias("shared")
    )
    return both.where((F.size("shared") >= F.col("need")) & (F.slice("shared", 1, level) == F.col("key"))).select("a", "b")


def _block_pairs(rows: DataFrame, level: int, threshold: float, complete: bool) -> DataFrame:
    """The same of large keys, block against block; ``complete``: of pairs that share no more than the key."""
    ship(rows.sparkSession)

    def compare(table: pa.Table) -> pa.Table:
        a, b = overlaps(table, level, threshold, complete)
        return pa.table({"a": a, "b": b})

    # A fixed number of parts: by their bytes these would be put together, by their work they must not be.
    laid = in_blocks(rows.select("key", "code", "v", "size"), "key", F.col("size"), "code", BLOCK).repartition(4 * shuffle_partitions(rows.sparkSession), "key", "p", "q")
    return laid.groupBy("key", "p", "q").applyInArrow(compare, "a bigint, b bigint")


def overlaps(table: pa.Table, level: int, threshold: float, complete: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the similar pairs of one or two blocks (code, v, mine, p, q, key), see :func:`_block_pairs`."""
    code, lists = table["code"].to_numpy(), table["v"].combine_chunks()
    last = table["key"][0].as_py()[-1]
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(code)), sizes)
    values, column, often = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    known = np.flatnonzero(often > 1)  # the others are shared by no pair
    place = np.full(len(values), -1)
    place[known] = np.arange(len(known))
    column = place[column]
    two = table["p"][0].as_py() != table["q"][0].as_py()
    first = table["mine"].to_numpy() == table["p"][0].as_py()
    left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if two else (np.arange(len(code)),) * 2
    shared, front = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(known), 1024):
        end = min(begin + 1024, len(known))
        held = np.zeros((len(code), end - begin), np.float32)
        inside = (column >= begin) & (column < end)
        held[row[inside], column[inside] - begin] = 1
        cut_at = int(np.searchsorted(values[known[begin:end]], last, "right"))  # values up to the key's last one
        if cut_at:
            front += held[left, :cut_at] @ held[right, :cut_at].T
        if cut_at < end - begin:
            shared += held[left, cut_at:] @ held[right, cut_at:].T
    shared += front
    need = np.ceil((sizes[left][:, None] + sizes[right][None, :]) * (threshold / (1 + threshold)) - _EPS)
    good = (front == level) & (shared >= need)
    if complete:
        good &= shared == level
    if not two:
        good &= np.triu(np.ones_like(good), 1)
    x, y = np.nonzero(good)
    a, b = code[left[x]], code[right[y]]
    return np.minimum(a, b), np.maximum(a, b)


def set_similarity_join(df: DataFrame, key: str, values: Column, threshold: float = THRESHOLD, least: int = LEAST_VALUES) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a, b) of equal sets, and members (code, node_id).

    ``values`` is an array of clean, distinct values a row; rows with fewer than ``least`` take no part. A null key is no
    record; extra columns are ignored; an empty table gives no rows.
    """
    sets = df.where(df[key].isNotNull()).select(df[key].alias("node_id"), values.alias("values"))
    members, classes = classes_of(cut(sets.where(F.size("values") >= least)))
    return similar_sets(classes, threshold), members


def set_similarity_between(left: DataFrame, right: DataFrame, key: str, values: str, threshold: float = THRESHOLD, least: int = LEAST_VALUES) -> DataFrame:
    """left_key, right_key of all similar pairs between two tables, each with ``key`` and an array ``values`` of clean, distinct values."""
    sides = [df.where(df[key].isNotNull() & (F.size(values) >= least)).select(F.lit(s).alias("side"), df[key].alias("node_id"), df[values].alias("values")) for s, df in enumerate((left, right))]
    both = cut(sides[0].unionByName(sides[1]).withColumn("node_id", F.struct("side", "node_id")))
    members, classes = classes_of(both)
    pairs = similar_sets(classes, threshold)
    every = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(classes.select(F.col("code").alias("a"), F.col("code").alias("b")))
    ls = members.where("node_id.side = 0").select(F.col("code").alias("a"), F.col("node_id.node_id").alias("left_key"))
    rs = members.where("node_id.side = 1").select(F.col("code").alias("b"), F.col("node_id.node_id").alias("right_key"))
    return every.join(ls, "a").join(rs, "b").select("left_key", "right_key")
