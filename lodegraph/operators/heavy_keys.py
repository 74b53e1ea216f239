"""Per-key figures when a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut, shuffle_partitions

#: Keys on the heavy list at most: what is broadcast are their 64-bit hashes, so never more than 800 kB.
HEAVY_MOST = 100_000
#: A key is heavy from this part of an even share of a partition on.
PART = 4


def heavy_hitters(df: DataFrame, key: str, share: float, most: int = HEAVY_MOST, least: int = 2) -> DataFrame:
    """Hashes (column ``heavy``) of the keys that a frequent-items sketch over all rows puts at ``share`` of them and ``least`` rows or more, at most ``most``.

    One pass, a sketch of fixed size per task, merged; it holds hashes, whatever the keys' lengths. Nulls are ignored; an
    empty table gives no rows.
    """
    wanted = int(min(most, max(16, 2 / share)))
    items = int(min(1_000_000, max(1024, 16 * wanted)))
    sketch = df.where(df[key].isNotNull()).agg(
        F.call_function("approx_top_k", F.xxhash64(df[key]), F.lit(wanted), F.lit(items)).alias("top"), F.count(F.lit(1)).alias("n")
    )
    return (
        sketch.select("n", F.explode("top").alias("t"))
        .where(F.col("t.count") >= F.greatest(F.lit(float(least)), F.col("n") * share))
        .select(F.col("t.item").alias("heavy"))
    )


def per_key_figures(df: DataFrame, key: str, count_distinct: str, distinct_on: list[str], share: float | None = None) -> DataFrame:
    """key_value, n_rows, n_from of every key: its rows distinct in ``distinct_on``, and its distinct ``count_distinct``.

    Heavy keys are those with ``share`` of all rows or more by a sketch over all rows; by default a quarter of an even
    share of a shuffle partition, so that no other key can unbalance one, however large the data. Their rows get the list by
    broadcast join. They are aggregated map-side by the whole distinct row before they move, spread by that whole row, then
    by (key, ``count_distinct``), then by key: repeats never move, and neither a hot key nor a hot pair lies in one part
    before it is a few rows. The other keys take one ordinary shuffle by key, within which repeats are dropped and figures
    made. Both are united. Results are exact whatever the sketch says; it only decides which way a key takes.

    Rows with a null or empty key are left aside; a null ``count_distinct`` counts among the rows but not among the
    distinct values. Repeats count once; an empty table gives no rows; other columns are ignored.
    """
    columns = list(dict.fromkeys([key, count_distinct, *distinct_on]))
    rows = df.where(df[key].isNotNull() & (df[key] != "")).select(*[df[c] for c in columns])
    share = share or 1 / (PART * shuffle_partitions(df.sparkSession))
    # Written once, at most HEAVY_MOST rows, so that the two ways don't run the sketch again.
    heavy = F.broadcast(cut(heavy_hitters(rows, key, share)))
    on = F.xxhash64(rows[key]) == heavy["heavy"]
    hot, light = rows.join(heavy, on, "left_semi"), rows.join(heavy, on, "left_anti")
    united = hot_figures(hot, key, count_distinct, columns).unionByName(_light_figures(light, key, count_distinct, columns))
    return united.select(F.col(key).alias("key_value"), F.col("n_rows").cast("bigint").alias("n_rows"), F.col("n_from").cast("bigint").alias("n_from"))


def hot_figures(rows: DataFrame, key: str, count_distinct: str, columns: list[str]) -> DataFrame:
    """key, n_rows, n_from over the distinct ``columns``, in three aggregations that each combine map-side."""
    per_value = rows.dropDuplicates(columns).groupBy(key, count_distinct).agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy(key).agg(F.sum("n").alias("n_rows"), F.count(count_distinct).alias("n_from"))


def _light_figures(rows: DataFrame, key: str, count_distinct: str, columns: list[str]) -> DataFrame:
    """The same after one exchange by key, for keys none of which fills a good part of a partition."""
    per_value = rows.repartition(key).dropDuplicates(columns).groupBy(key, count_distinct).agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy(key).agg(F.sum("n").alias("n_rows"), F.count(count_distinct).alias("n_from"))


def heavy_share_of(figures: DataFrame, share: float) -> DataFrame:
    """The keys whose n_rows is at least ``share`` of all n_rows. The figures, a row a key, are written and read twice."""
    figures = cut(figures)
    total = figures.agg(F.sum("n_rows").alias("_total"))
    return figures.join(F.broadcast(total), F.col("n_rows") * F.lit(1.0) >= F.lit(share) * F.col("_total")).drop("_total")
