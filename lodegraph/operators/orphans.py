"""References to records that do not exist.

The keys of all references and parents are dictionary-encoded as (bucket, position): the bucket is a hash range of the
keys, the position a dense rank within it. References become sparse bitmaps per source, bucket and period, parents become
bitmaps per bucket and month of arrival. A bitmap is kept as its non-empty 64-bit words, so it is compressed, aggregates
map-side with ``bit_or``. A second bitmap marks references that are earlier than the parent's arrival. ``reference AND NOT
parent`` over whole words leaves the bits of orphans, which alone are decoded back to keys: each word travels with the part
of the dictionary that its own bits stand for, at most 64 entries, so that the dictionary is made and moved once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import shuffle_partitions

WORD = 64
NEVER_LATE = 2**31 - 1  #: month of references without a time
FIRST_MONTH = -(2**31) + 1  #: month of parents without a time of arrival


@dataclass(frozen=True)
class Reference:
    """A column of ``df`` that names parents; ``at`` is the time of the referring row."""

    table: str
    field: str
    df: DataFrame
    ref: str
    at: str


def _month(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (position % WORD).cast("int"))


def is_removed(status: Column, metadata: Column) -> Column:
    """Whether a node row marks its node as removed."""
    named = F.lower(F.trim(status)).isin("deleted", "removed")
    return F.coalesce(named, F.lit(False)) | F.coalesce(F.map_contains_key(metadata, "deleted_at"), F.lit(False))


def parents_of_nodes(nodes: DataFrame) -> DataFrame:
    """key, dead, born of each node id: the state of its newest row, and the first arrival.

    Of rows that tie for the newest, one that marks a removal counts. Rows without an id are left aside.
    """
    dead = is_removed(nodes["status"], nodes["metadata"])
    return (
        nodes.where(nodes["id"].isNotNull() & (nodes["id"] != ""))
        .select(nodes["id"].alias("key"), nodes["updated_at"].alias("_v"), dead.alias("_dead"), nodes["created_at"].alias("_born"))
        .groupBy("key")
        .agg(F.max(F.struct("_v", "_dead"))["_dead"].alias("dead"), F.min("_born").alias("born"))
    )


def orphan_references(references: list[Reference], parents: DataFrame, buckets: int | None = None) -> DataFrame:
    """table_name, field_name, ref_id, period, kind of each distinct reference that leads nowhere.

    ``parents`` has key (unique), dead, born. kind is ``missing`` if no parent has the key, ``deleted`` if it is dead,
    ``late`` if a reference of that period is earlier than born. period is the month of the referring row, or ``unknown``.
    Null and empty references are no references; empty tables give no rows; repeats give one row; other columns of the
    inputs are ignored. A parent with null born is never late.

    References are aggregated by (source, key, month) before they are shuffled by bucket, so a key that holds a third of
    all rows travels as one row per source, month and map task.
    """
    spark = parents.sparkSession
    buckets = buckets or max(64, 4 * shuffle_partitions(spark))
    month = F.coalesce(_month(F.col("at")), F.lit(NEVER_LATE))
    refs = reduce(
        DataFrame.unionByName,
        [
            r.df.where(r.df[r.ref].isNotNull() & (r.df[r.ref] != "")).select(
                F.lit(n).alias("src"), r.df[r.ref].alias("key"), r.df[r.at].cast("timestamp").alias("at")
            )
            for n, r in enumerate(references)
        ],
    )
    refs = refs.groupBy("src", "key", month.alias("month")).agg(F.min("at").alias("at"))
    sides = refs.withColumns({"dead": F.lit(None).cast("boolean"), "born": F.lit(None).cast("timestamp")}).unionByName(
        parents.select(
            F.lit(-1).alias("src"),
            "key",
            F.coalesce(_month(F.col("born")), F.lit(FIRST_MONTH)).alias("month"),
            F.lit(None).cast("timestamp").alias("at"),
            "dead",
            F.col("born").cast("timestamp").alias("born"),
        )
    )
    # The dictionary: one shuffle and one sort by (bucket, key) give position and arrival to every row.
    by_bucket = Window.partitionBy("bucket").orderBy("key")
    by_key = Window.partitionBy("bucket", "key")
    coded = (
        sides.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
        .withColumn("pos", F.dense_rank().over(by_bucket) - 1)
        .withColumn("born", F.max("born").over(by_key))
    )
    # Bitmaps: the non-empty words of each (source, bucket, month); bucket is already the partitioning. A (source, key,
    # month) is one row, so a word's list of keys has no more entries than the word has bits.
    bit, zero = _bit(F.col("pos")), F.lit(0).cast("bigint")
    is_parent = F.col("src") < 0
    words = (
        coded.withColumn("word", F.floor(F.col("pos") / WORD).cast("int"))
        .groupBy("bucket", "word", "src", "month")
        .agg(
            F.bit_or(bit).alias("bits"),
            F.bit_or(F.when(F.col("dead"), zero).otherwise(bit)).alias("live"),
            F.bit_or(F.when(F.col("at") < F.col("born"), bit).otherwise(zero)).alias("early"),
            F.collect_list(F.when(~is_parent, F.struct((F.col("pos") % WORD).cast("int").alias("bit"), "key"))).alias("keys"),
        )
    )
    at_word = Window.partitionBy("bucket", "word")
    before = at_word.orderBy("month").rangeBetween(Window.unboundedPreceding, -1)
    words = words.withColumns(
        {
            "any": F.coalesce(F.bit_or(F.when(is_parent, F.col("bits"))).over(at_word), zero),
            "alive": F.coalesce(F.bit_or(F.when(is_parent, F.col("live"))).over(at_word), zero),
            "settled": F.coalesce(F.bit_or(F.when(is_parent, F.col("live"))).over(before), zero),
        }
    )
    left = F.col("bits").bitwiseAND(F.bitwise_not("settled"))
    # Of living parents only the references before their arrival are orphans.
    left = left.bitwiseAND(F.bitwise_not("alive").bitwiseOR(F.col("early")))
    # Decoding: only surviving bits become rows again.
    def has(bits: str) -> Column:
        return F.getbit(F.col(bits), F.col("o.bit")) == 1

    found = (
        words.where(~is_parent)
        .withColumn("left", left)
        .where("left != 0")
        .withColumn("o", F.explode(F.filter("keys", lambda k: F.getbit(F.col("left"), k["bit"]) == 1)))
        .select("src", "month", "o.key", F.when(~has("any"), "missing").when(~has("alive"), "deleted").otherwise("late").alias("kind"))
    )
    names = F.array(*[F.struct(F.lit(r.table).alias("t"), F.lit(r.field).alias("f")) for r in references])[F.col("src")]
    year, number = F.floor(F.col("month") / 12), F.col("month") % 12 + 1
    period = F.when(F.col("month") == NEVER_LATE, "unknown").otherwise(F.format_string("%04d-%02d", year, number))
    return found.select(names["t"].alias("table_name"), names["f"].alias("field_name"), F.col("key").alias("ref_id"), period.alias("period"), "kind")
