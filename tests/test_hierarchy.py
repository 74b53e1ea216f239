import random
from datetime import datetime

import pytest

from lodegraph.operators.hierarchy import hierarchy

ROWS = "child string, parent string, at timestamp, code string, path string"


def brute(rows):
    best = {}
    rows = [r for r in rows if r[0] and r[1]]
    for c, p, at in rows:
        k = (-(at.timestamp() if at else float("-inf")), p)
        if c not in best or k < best[c]:
            best[c] = k
    parent = {c: k[1] for c, k in best.items()}
    ids = {x for r in rows for x in r[:2]}
    below, out = dict.fromkeys(ids, 0), {}
    for i in ids:
        chain, at, seen = [], i, {i}
        while at in parent:
            at = parent[at]
            chain.append(at)
            if at in seen:
                break
            seen.add(at)
        if at in parent and len(set(chain)) < len(chain) or (chain and chain[-1] == i):
            out[i] = ("cycle" if i in chain else "below_cycle", "", -1)
        else:
            out[i] = ("tree", chain[-1] if chain else i, len(chain))
            for a in chain:
                below[a] += 1
    return {i: (*v, below[i] if v[0] == "tree" else -1) for i, v in out.items()}


def run(spark, rows, **kw):
    h = hierarchy(spark.createDataFrame([(*r, "c", "p") for r in rows], ROWS), **kw)
    return h, {r["node_id"]: (r["place"], r["root_id"], r["depth"], r["n_below"]) for r in h.summary().collect()}


T = datetime(2024, 1, 1)


@pytest.mark.parametrize("levels", [0, 2, 10, None])
def test_deep_chains_and_loops(spark, levels):
    rows = [(f"n{i + 1}", f"n{i}", T) for i in range(23)]
    rows += [("x", "y", T), ("y", "z", T), ("z", "x", T), ("self", "self", None), ("u", "x", T), ("v", "u", T), ("w", "self", T)]
    rows += [("n3", "other", None), ("n5", "a", datetime(2023, 1, 1)), ("", "q", T), (None, "q", T), ("q", None, T), ("q", "", T)] + rows[:3]
    assert run(spark, rows, levels=levels)[1] == brute(rows)


def test_random_forests(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(400):
        a, b = rnd.randrange(150), rnd.randrange(150)
        rows.append((f"k{max(a, b) if rnd.random() < 0.97 else a}", f"k{min(a, b)}", rnd.choice([None, T, datetime(2024, 1, rnd.randrange(1, 5))])))
    h, got = run(spark, rows, levels=3)
    assert got == brute(rows)
    pairs = h.pairs().collect()
    assert len(pairs) == sum(v[3] for v in got.values() if v[0] == "tree")
    assert all(got[p["node"]][2] - got[p["ancestor"]][2] == p["distance"] for p in pairs)
    for r in h.paths().collect():
        assert r["path"][0] == got[r["node_id"]][1] and r["path"][-1] == r["node_id"] and len(r["path"]) == got[r["node_id"]][2] + 1


def test_empty(spark):
    h, got = run(spark, [])
    assert got == {} and h.pairs().count() == 0 and h.paths().count() == 0


def test_only_loops_and_wide_tree(spark):
    assert run(spark, [("a", "b", T), ("b", "a", T)])[1] == {"a": ("cycle", "", -1, -1), "b": ("cycle", "", -1, -1)}
    rows = [(f"c{i}", "hub" * 1000, T) for i in range(300)]
    assert run(spark, rows)[1] == brute(rows)
