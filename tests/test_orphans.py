from datetime import datetime

from lodegraph.operators.orphans import Reference, orphan_references, parents_of_nodes

NODES = "id string, status string, metadata map<string,string>, created_at timestamp, updated_at timestamp, key string, bits bigint"
REFS = "r string, at timestamp, key string, bucket string, pos int"


def t(day, month=1, hour=0):
    return datetime(2024, month, day, hour)


def run(spark, nodes, refs, buckets=None):
    n, r = spark.createDataFrame(nodes, NODES), spark.createDataFrame(refs, REFS)
    out = orphan_references([Reference("t", "r", r, "r", "at")], parents_of_nodes(n), buckets)
    return sorted(tuple(x)[2:] for x in out.collect())


def test_kinds(spark):
    nodes = [
        ("a", "active", None, t(5), t(5), "x", 1),
        ("d", " Deleted ", {}, t(1), t(9), "x", 1),
        ("back", "deleted", None, t(1), t(2), None, None),
        ("back", "active", None, t(3), t(4), None, None),
        ("meta", None, {"deleted_at": "x"}, t(1), t(1), None, None),
        ("almost", "undeleted", {"other": "deleted"}, t(1), t(1), None, None),
        ("tie", "active", None, t(1), t(2), None, None),
        ("tie", "removed", None, t(1), t(2), None, None),
        ("unborn", "active", None, None, t(1), None, None),
        (None, "active", None, t(1), t(1), None, None),
        ("", "active", None, t(1), t(1), None, None),
    ]
    refs = [(k, t(6), "k", "b", 1) for k in ("a", "d", "back", "meta", "almost", "tie", "unborn", "none", "", None)]
    refs += [("a", t(4), None, None, None), ("a", None, None, None, None), ("a", t(20, 12), None, None, None), ("none", None, None, None, None), ("none", t(6), "z", "z", 2)]
    assert run(spark, nodes, refs) == [
        ("a", "2024-01", "late"),
        ("d", "2024-01", "deleted"),
        ("meta", "2024-01", "deleted"),
        ("none", "2024-01", "missing"),
        ("none", "unknown", "missing"),
        ("tie", "2024-01", "deleted"),
    ]


def test_late_by_the_earliest_row_and_across_months(spark):
    nodes = [("a", "", None, t(15, 3, 12), t(15, 3), None, None), ("a", "", None, t(1, 5), t(1, 5), None, None)]
    refs = [("a", t(15, 3, 11), "", "", 0), ("a", t(15, 3, 13), "", "", 0), ("a", t(20, 2), "", "", 0), ("a", t(1, 4), "", "", 0)]
    assert run(spark, nodes, refs) == [("a", "2024-02", "late"), ("a", "2024-03", "late")]
    assert run(spark, nodes, refs[1:2]) == []


def test_many_keys_a_bucket(spark):
    nodes = [(f"k{i}", "", None, t(1), t(1), None, None) for i in range(0, 500, 2)]
    refs = [(f"k{i}", t(2), "", "", 0) for i in range(500)] * 2
    want = sorted((f"k{i}", "2024-01", "missing") for i in range(1, 500, 2))
    assert run(spark, nodes, refs, 1) == want == run(spark, nodes, refs, 7)


def test_empty_and_long(spark):
    assert run(spark, [], []) == []
    assert run(spark, [("a", None, None, None, None, None, None)], []) == []
    long = "x" * 100_000
    assert run(spark, [], [(long, t(1), "", "", 0)]) == [(long, "2024-01", "missing")]
