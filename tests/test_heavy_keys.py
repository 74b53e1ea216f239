import random
from collections import defaultdict

from pyspark.sql import functions as F

from lodegraph.operators.heavy_keys import heavy_hitters, heavy_share_of, hot_figures, per_key_figures

SCHEMA = "k string, f string, t string, key string, n bigint, salt int, n_rows int, n_from int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)


def brute(rows):
    seen, froms = defaultdict(set), defaultdict(set)
    for k, f, t in rows:
        if k:
            seen[k].add((f, t))
            if f is not None:
                froms[k].add(f)
    return {k: (len(v), len(froms[k])) for k, v in seen.items()}


def run(spark, rows, **kw):
    out = per_key_figures(frame(spark, rows), "k", "f", ["f", "k", "t"], **kw)
    return {r["key_value"]: (r["n_rows"], r["n_from"]) for r in out.collect()}


def test_skewed(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(300)}", f"f{rnd.randrange(60)}", rnd.choice("ab")) for _ in range(6000)]
    rows += [(None, "f", "a"), ("", "f", "a"), ("nf", None, "a"), ("nf", None, "a"), ("nt", "f", None), ("hot", None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, share=1e-9) == brute(rows)
    assert run(spark, rows, share=2.0) == brute(rows)


def test_sketch_and_share(spark):
    rows = [("a", str(i), "x") for i in range(900)] + [(f"k{i}", "f", "x") for i in range(100)]
    df = frame(spark, rows)
    assert heavy_hitters(df, "k", 0.1).collect() == df.where("k = 'a'").select(F.xxhash64("k")).distinct().collect()
    assert heavy_hitters(df.limit(0), "k", 0.1).count() == 0
    figures = per_key_figures(df, "k", "f", ["k", "f", "t"])
    assert [r["key_value"] for r in heavy_share_of(figures, 0.01).collect()] == ["a"]
    assert heavy_share_of(figures, 0.0005).count() == 101


def test_empty_and_only_nulls(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, "f", "a")]) == {}
    assert run(spark, [("x" * 50_000, "y" * 50_000, None)] * 3) == {"x" * 50_000: (1, 1)}


def test_one_pair_that_holds_half_of_the_rows(spark):
    """Rows of a hot key combine map-side by the whole row, then by the pair: no exchange carries its repeats, none puts it into one part."""
    rows = spark.range(0, 200_000, 1, 8).select(
        F.lit("hot").alias("k"), F.when(F.col("id") % 2 == 0, "one").otherwise(F.concat(F.lit("f"), F.col("id") % 5000)).alias("f"), F.concat(F.lit("t"), F.col("id") % 3).alias("t")
    )
    out = hot_figures(rows, "k", "f", ["k", "f", "t"])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("partial") >= 2
    executed = out._jdf.queryExecution().executedPlan().toString()
    steps = [x.strip(" +-:*()0123456789") for x in executed.splitlines()]
    for at, step in enumerate(steps):
        if step.startswith("Exchange"):
            assert steps[at + 1].startswith("HashAggregate"), executed
    moved = rows.groupBy(F.spark_partition_id(), "k", "f", "t").count()
    assert out.collect()[0][1:] == (rows.distinct().count(), rows.select("f").distinct().count())
    spread = rows.dropDuplicates(["k", "f", "t"]).repartition(8, "k", "f", "t").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert moved.count() < 200_000 and spread.max() < 2 * spread.mean()


def test_default_threshold_follows_the_partitions(spark):
    rnd = random.Random(4)
    rows = [(f"h{rnd.randrange(3)}" if rnd.random() < 0.6 else f"k{rnd.randrange(500)}", rnd.choice(["one", None, f"f{rnd.randrange(9)}"]), "x") for _ in range(5000)]
    for parts in ("2", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert run(spark, rows) == brute(rows)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
