"""What the operators on pairs of documents share: current rows, classes of equal sets, pairs of rows in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
AT_ONCE = 1_000_000  #: elements of lists worked on at once; only bounds memory


def slices(batches: Iterator[pa.RecordBatch], column: int | str, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose lists in ``column`` have about ``most`` elements together, at least one row each."""
    for batch in batches:
        ends, begin = batch.column(column).offsets.to_numpy(), 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def newest(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """The newest row of each key by ``version`` (null is the oldest); of equals the greatest in ``columns``. Null keys are left aside."""
    picked = F.max(F.struct(df[version].alias("_version"), *[df[c].alias(c) for c in columns]))
    return df.where(df[key].isNotNull()).groupBy(df[key].alias("node_id")).agg(picked.alias("r")).select("node_id", *[f"r.{c}" for c in columns])


def in_blocks(rows: DataFrame, key: str, size: Column, unique: str, block: int = BLOCK) -> DataFrame:
    """Rows of oversize buckets laid out for a pairing in parallel.

    A bucket of ``size`` rows falls into parts of about ``block``; a row goes to every pair of parts that has its own. Two
    rows of a bucket meet in exactly one of the new buckets (columns p, q beside ``key``), see :func:`meet_once`.
    """
    parts = F.ceil(size / block).cast("int")
    mine = F.pmod(F.xxhash64(unique), parts).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    return (
        rows.withColumns({"parts": parts, "mine": mine})
        .withColumn("other", F.explode(others))
        .withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other")})
        .drop("other", "parts")
    )


def meet_once(a: str, b: str) -> Column:
    """Of two aliased sides of blocks: whether this block is the one the two rows meet in."""
    x, y = F.col(f"{a}.mine"), F.col(f"{b}.mine")
    return (F.least(x, y) == F.col(f"{a}.p")) & (F.greatest(x, y) == F.col(f"{a}.q"))


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """node_a < node_b of pairs of classes (a, b) and of the members (code, node_id) of one class."""
    left, right = (members.select(F.col("code").alias(c), F.col("node_id").alias(n)) for c, n in (("a", "n1"), ("b", "n2")))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select(F.least("n1", "n2").alias("node_a"), F.greatest("n1", "n2").alias("node_b"))
    counts = members.groupBy("code").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = in_blocks(members.join(counts, "code"), "code", F.col("size"), "node_id")
    x, y = shared.alias("x"), shared.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("code", "p", "q")]
    within = x.join(y, same[0] & same[1] & same[2] & (F.col("x.node_id") < F.col("y.node_id")) & meet_once("x", "y"))
    return across.unionByName(within.select(F.col("x.node_id").alias("node_a"), F.col("y.node_id").alias("node_b")))


def links_of(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row a document: node_id, class_id (the smallest node_id of its class of equal sets), n_copies, n_links.

    ``n_links`` counts the documents of other classes it is alike enough to; copies are never expanded into pairs.
    """
    classes = members.groupBy("code").agg(F.min("node_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    both = pairs.select(F.col("a").alias("code"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("code"), F.col("a").alias("o")))
    degree = both.join(classes.select(F.col("code").alias("o"), "n_copies"), "o").groupBy("code").agg(F.sum("n_copies").alias("n_links"))
    return members.join(classes, "code").join(degree, "code", "left").select("node_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
