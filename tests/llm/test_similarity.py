import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodegraph.llm import near_duplicates as nd
from lodegraph.llm import set_joins, similar
from lodegraph.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def jaccard_pairs(sets, threshold):
    keys = sorted(sets)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared >= threshold * (len(sets[a]) + len(sets[b]) - shared):
                out.add((a, b))
    return out


def texts(seed, groups, each, words=60, common=()):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(3000)]
    out = {}
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(words)]
        for k in range(each):
            w = list(base)
            for _ in range(rnd.randrange(0, 6)):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randrange(0, 2)] = [rnd.choice(vocabulary)]
            if common and rnd.random() < 0.8:
                w[10:10] = common
            out[f"n{g:03}-{k}"] = " ".join(w)
    return out


def shingle_sets(docs):
    out = {}
    for k, t in docs.items():
        w = re.findall(r"[^\W_]+", (t or "").lower())
        s = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        if len(s) >= 20:
            out[k] = s
    return out


def found(spark, docs, **kw):
    df = spark.createDataFrame([(k, t, "c", [1], 7, "x") for k, t in docs.items()], "id string, body string, code string, tokens array<int>, n int, path string")
    pairs, members = nd.near_duplicates(df, "id", F.col("body"), **kw)
    return {tuple(r) for r in similar.expand(pairs, members).collect()}, pairs, members


def test_near_duplicates_against_brute_force(spark):
    docs = texts(1, 40, 5, common=[f"standard{i}" for i in range(25)])
    docs |= {"copy1": docs["n000-0"], "copy2": docs["n000-0"].upper() + " !!", "null": None, "empty": "", "short": "a b c " * 9, "long": " ".join(f"x{i}" for i in range(20_000))}
    want = jaccard_pairs(shingle_sets(docs), 0.6)
    got, pairs, members = found(spark, docs)
    assert got <= want and len(got) >= 0.99 * len(want) and ("copy1", "copy2") in got
    links = {r["node_id"]: r for r in similar.links_of(pairs, members).collect()}
    assert links["copy2"]["class_id"] == links["copy1"]["class_id"] and links["copy1"]["n_copies"] >= 2 and "short" not in links
    assert sum(r["n_links"] for r in links.values()) == 2 * len([p for p in got if links[p[0]]["class_id"] != links[p[1]]["class_id"]])


@pytest.mark.parametrize("depth,codes", [(2, 0), (4, 10**6), (12, 0)])
def test_one_large_group(spark, monkeypatch, depth, codes):
    """A group of near copies that no split takes apart is compared in blocks, whole; whichever way sets are found again."""
    monkeypatch.setattr(nd, "CODES_MOST", codes)
    docs = texts(2, 1, 120) | texts(3, 60, 1)
    docs = {f"{k}-{n}": t for n, (k, t) in enumerate(docs.items())}
    want = jaccard_pairs(shingle_sets(docs), 0.6)
    df = spark.createDataFrame(list(docs.items()), "id string, body string")
    sets = nd.shingle_sets(df.withColumnRenamed("id", "node_id"), F.col("body"))
    members, reps = nd.classes_of(sets)
    pairs = nd.alike(reps, bucket=16, depth=depth)
    got = {tuple(r) for r in similar.expand(pairs, members).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_slices():
    import pyarrow as pa

    lists = pa.array([[1] * n for n in (0, 5, 2, 0, 9, 1, 1, 1)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), lists], names=["k", "v"]).slice(1)
    got = list(similar.slices([batch, batch.slice(0, 0)], "v", 4))
    assert [b.column(0).to_pylist() for b in got] == [[1], [2, 3], [4], [5, 6, 7]]


@pytest.mark.parametrize("batch,hot", [("3", 250_000), ("10000", 250_000), ("7", 1)])
@pytest.mark.parametrize("bucket", [2, 7, 100])
def test_buckets_across_batches(spark, monkeypatch, batch, hot, bucket):
    """Paths that lie across batches, and those with more rows than a bucket holds, moved or not, are told alike whatever the batch size."""
    monkeypatch.setattr(nd, "HOT_LEAST", hot)
    rnd = random.Random(bucket)
    rows = [(rnd.choice([1, 1, 1, 2, 3, 4 + k % 20]), k, None, 30, *[rnd.getrandbits(62) if rnd.random() < 0.5 else 7 for _ in range(2)]) for k in range(120)]
    df = spark.createDataFrame(rows, "path bigint, code bigint, parent bigint, n int, s0 bigint, s1 bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = nd._meet(df, 0.6, bucket).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    most = nd._most(128, 0.6)
    want = {(x[1], y[1]) for g in by.values() if len(g) <= bucket for x in g for y in g if x[1] < y[1] and sum((p ^ q).bit_count() for p, q in zip(x[4:], y[4:])) <= most}
    assert {(r["a"], r["b"]) for r in out if r["b"] is not None} == want
    assert sorted((r["path"], r["a"]) for r in out if r["b"] is None) == sorted((r[0], r[1]) for g in by.values() if len(g) > bucket for r in g)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, body string")
    pairs, members = nd.near_duplicates(df, "id", F.col("body"))
    assert similar.expand(pairs, members).count() == 0 and similar.links_of(pairs, members).count() == 0
    assert nd.runs_for(0.6, 0.99) <= 16 and nd.runs_for(0.9, 0.99) < nd.runs_for(0.6, 0.99)


def test_many_copies(spark):
    docs = {f"c{i}": "one two three four five six seven eight nine ten " + " ".join(f"t{j}" for j in range(30)) for i in range(300)}
    got, _, members = found(spark, docs)
    assert len(got) == 300 * 299 // 2 and members.select("code").distinct().count() == 1


def test_newest(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", "old", t), ("a", "new", t + timedelta(1)), ("a", "null", None), ("b", "x", None), (None, "y", t), ("c", "p", t), ("c", "q", t)]
    df = spark.createDataFrame(rows, "node_id string, v string, updated_at timestamp")
    assert {r["node_id"]: r["v"] for r in similar.newest(df, "node_id", "updated_at", ["v"]).collect()} == {"a": "new", "b": "x", "c": "q"}


def random_sets(seed, n, hot=4):
    rnd = random.Random(seed)
    out = {}
    for i in range(n):
        s = {f"hot{j}" for j in range(hot) if rnd.random() < 0.6} | {f"v{int(rnd.expovariate(0.05))}" for _ in range(rnd.randrange(0, 7))}
        out[f"s{i:04}"] = s
    return out


@pytest.mark.parametrize("small,threshold", [(1, 0.6), (5, 0.6), (64, 0.6), (4, 0.5), (4, 0.85), (3, 1.0)])
def test_set_join_against_brute_force(spark, small, threshold):
    sets = {k: v for k, v in random_sets(small, 300).items() if len(v) >= 4}
    df = spark.createDataFrame([(k, sorted(v), "x", 3) for k, v in sets.items()], "node_id string, values array<string>, key string, level int")
    members, classes = set_joins.classes_of(df)
    raw = set_joins.similar_sets(classes, threshold, small).collect()
    assert len(raw) == len({tuple(r) for r in raw})
    pairs = spark.createDataFrame([tuple(r) for r in raw], "a bigint, b bigint")
    got = [tuple(r) for r in similar.expand(pairs, members).collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_pairs(sets, threshold)


@pytest.mark.parametrize("n,common", [(150, 17), (400, 20)])
def test_set_join_of_a_cluster(spark, n, common):
    """Many distinct sets that share all values but one are compared once, not in every combination of what they share."""
    sets = {f"s{i}": {f"c{j}" for j in range(common)} | {f"own{i}"} for i in range(n)} | {f"t{i}": {f"c{j}" for j in range(3)} | {f"o{i}-{j}" for j in range(common)} for i in range(80)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "node_id string, values array<string>")
    members, classes = set_joins.classes_of(df)
    levels = []
    longer, set_joins._longer = set_joins._longer, lambda rows, level: levels.append(level) or longer(rows, level)
    try:
        raw = [tuple(r) for r in set_joins.similar_sets(classes).collect()]
    finally:
        set_joins._longer = longer
    assert len(raw) == len(set(raw)) == n * (n - 1) // 2 and max(levels) <= 4


def test_set_join_of_a_large_cluster(spark):
    own = F.array(F.concat(F.lit("own"), "id"))
    df = spark.range(4000).select(F.concat(F.lit("s"), "id").alias("node_id"), F.concat(F.array(*[F.lit(f"c{j}") for j in range(20)]), own).alias("values"))
    assert set_joins.similar_sets(set_joins.classes_of(df)[1]).count() == 4000 * 3999 // 2


def test_set_join_of_dirty_values(spark):
    rows = [
        ("a", [" #To_Do ", "x y", None, "", "  ", "B", "b", "c"]), ("b", ["to-do", "X-Y", "b", "C"]), ("c", None), ("d", []), (None, ["to-do", "x-y", "b", "c"]), ("e", ["to-do", "x-y", "b"]), ("f", ["##to-do", "x-y", "b", "c", "z" * 9999]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, tags array<string>, node_id string")
    pairs, members = set_joins.set_similarity_join(df, "id", set_joins.normal_values(F.col("tags")))
    assert {tuple(r) for r in similar.expand(pairs, members).collect()} == {("a", "b")}
    assert {r["node_id"]: r["n_copies"] for r in similar.links_of(pairs, members).collect()} == {"a": 2, "b": 2, "f": 1}
    empty = set_joins.set_similarity_join(df.limit(0), "id", set_joins.normal_values(F.col("tags")))
    assert similar.expand(*empty).count() == 0


def test_between_two_tables(spark):
    left, right = random_sets(7, 120), random_sets(8, 120)
    left = {k: v for k, v in left.items() if len(v) >= 4}
    right = {k: v for k, v in right.items() if len(v) >= 4} | {"same": next(iter(left.values()))}
    frame = lambda s: spark.createDataFrame([(k, sorted(v)) for k, v in s.items()], "id string, vals array<string>")
    got = {tuple(r) for r in set_joins.set_similarity_between(frame(left), frame(right), "id", "vals").collect()}
    want = {(a, b) for a, x in left.items() for b, y in right.items() if len(x & y) >= 0.6 * len(x | y)}
    assert got == want
