"""Small fixtures for operators that SQL cannot check well."""

import json
import random
import sqlite3

import pytest

from lodegraph.functions import paths as p
from lodegraph.functions.text import phrases, snippet
from lodegraph.model import TABLES
from lodegraph.operators import graph, inference, ledger, links, refresh, scopes, search
from pyspark.sql import functions as F

DOCS = [
    ("note:Work/JobSearch/plan.md", "Job Search Plan", "Work/JobSearch/plan.md", "Work/JobSearch", "Roadmap for my job search and planning.", None, ["plan"], ["planning"], "tracked", None),
    ("note:Work/JobSearch/kickoff.md", "Kickoff", "Work/JobSearch/kickoff.md", "Work/JobSearch", "First-week job search checklist.", "", [], None, "tracked", None),
    ("note:Business/ShinySwap/notes.md", "Shiny Notes", "Business/ShinySwap/notes.md", "Business/ShinySwap", "Nothing to do with job search.", "", None, [], "untracked", None),
    ("note:Café.md", "Café au lait", "Café.md", ".", "week first, first week; résumé " * 30, "", [], [], "tracked", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, TABLES["search_docs"]).cache()


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(d[0], "note", d[2], "/r/" + d[2], "", None, None, None) for d in DOCS], TABLES["nodes"]).cache()


@pytest.mark.parametrize("term", ["job search", "first-week", "week-first", "cafe", "planning roadmap job", "resume Shiny the", "nothing-here", "a-b", "first-week-first job"])
def test_bm25_as_sqlite(docs, term):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, rel_path, scope, body, summary, aliases, tags)")
    for d in DOCS:
        db.execute("insert into f(rowid, title, rel_path, scope, body, summary, aliases, tags) values (?,?,?,?,?,?,?,?)", (DOCS.index(d) + 1, *d[1:5], d[5] or "", json.dumps(d[6] or []), json.dumps(d[7] or [])))
    match = " OR ".join(f'"{w}"' for w in term.split())
    want = {DOCS[r - 1][0]: s for r, s in db.execute("select rowid, -bm25(f) from f where f match ?", (match,))}
    got = {r["node_id"]: r["score"] for r in search.bm25(search.build_index(docs), phrases(term)).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_stored_index(docs, tmp_path):
    search.build_index(docs).save(str(tmp_path), 2)
    stored = search.load_index(docs, str(tmp_path))
    for term in ("job search", "first-week resume", "week-first", "none"):
        a, b = ({r["node_id"]: r["score"] for r in search.bm25(i, phrases(term)).collect()} for i in (stored, search.build_index(docs)))
        assert a == b


def test_search_filters_and_modes(docs, nodes):
    index = search.build_index(docs)
    run = lambda **o: [r for r in search.ordered(search.search(index, nodes, search.Options(**o))).collect()]
    assert len(run(term="job search", limit=10)) == 3
    assert {r["scope"] for r in run(term="search", scope="Work/JobSearch")} == {"Work/JobSearch"}
    assert len(run(term="search", path_prefix="work")) == 2
    assert [r["node_id"] for r in run(term="search", untracked=True)] == ["note:Business/ShinySwap/notes.md"]
    assert len(run(term="search", tracked=True, untracked=True)) == 3
    assert run(term="search", type="file") == [] and run(term="  ") == [] and run(term="—") == []
    assert len(run(term="job", limit=1)) == 1 and len(run(term="job", limit=0)) == 3
    top = run(term="plan", mode="explicit")[0]
    assert top["score"] == pytest.approx(top["bm25"] * 1.35) and top["reasons"] == ["fts_match", "exact_path_token", "title_match"]
    assert search.parse_mode("SEMANTIC") == "semantic" and search.parse_mode("x") == "hybrid"


def test_snippet_as_sqlite():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(body)")
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()
    for at in (0, 3, 8, 15, 22, 23):
        text = ", ".join([*words[:at], "hit", *words[at:]])
        db.execute("delete from f")
        db.execute("insert into f values (?)", (text,))
        (want,) = db.execute("select snippet(f, 0, '…', '…', '…', 12) from f where f match 'hit'").fetchone()
        assert snippet(text, [["hit"]]) == want
    for text in ("One two. Three four five hit six seven eight nine ten eleven twelve thirteen fourteen fifteen.", "a b c d e f g h i j k l m. n o hit p q r s t u v w x y z", "a b: c hit"):
        db.execute("delete from f")
        db.execute("insert into f values (?)", (text,))
        (want,) = db.execute("select snippet(f, 0, '…', '…', '…', 12) from f where f match 'hit'").fetchone()
        assert snippet(text, [["hit"]]) == want
    assert snippet("", [["a"]]) == "" and snippet(None, [["a"]]) == "" and snippet("…", []) == "…"


def test_resolve_and_related(spark, docs, nodes):
    index = search.build_index(docs)
    one = lambda t: [tuple(r) for r in search.resolve(index, nodes, t).collect()]
    plan, kick = DOCS[0][0], DOCS[1][0]
    assert one(plan) == [(plan, "exact_id")] and one(DOCS[0][2]) == [(plan, "exact_rel_path")] and one("./" + DOCS[0][2]) == [(plan, "exact_rel_path")]
    assert one("/r/" + DOCS[1][2]) == [(kick, "exact_rel_path")]
    assert one("planning") == [(plan, "top_hit")] and one("zzz") == [] and one(" ") == []
    edges = spark.createDataFrame([(plan, kick, "links_to", 1.0, "explicit", "", "", None)], TABLES["edges"])
    items = search.related(index, nodes, edges, DOCS[0][2]).collect()
    assert (items[0]["node_id"], items[0]["reason"], items[0]["score"]) == (kick, "explicit_edge", 1.0)
    assert all(r["node_id"] != plan for r in items)
    assert [r["node_id"] for r in search.related(index, nodes, edges, DOCS[0][2], "structural").collect()] == [kick]
    assert search.related(index, nodes, edges, "no/such-thing-at-all.xyz").count() == 0
    with pytest.raises(ValueError):
        search.related(index, nodes, edges, " ")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_paths(spark):
    f = lambda g, *a: value(spark, g(*map(F.lit, a)))
    assert f(p.ancestors, "a/b/c.md") == ["a", "a/b"] and f(p.ancestors, "a") == [] and f(p.ancestors, "") == []
    assert f(p.parent, "a/b") == "a" and f(p.parent, "a") == "." and f(p.parent, "") == "."
    assert f(p.resolve, "a/b/c.md", "../d.png") == "a/d.png" and f(p.resolve, "c.md", "../d") is None and f(p.resolve, "a/c.md", "/x/./y//z") == "x/y/z"
    assert f(p.stem, "a/.env") == ".env" and f(p.stem, "a/b.tar.gz") == "b.tar" and f(p.extension, "a.b/c") == "" and f(p.extension, "x.MD") == "md"
    assert f(p.title_of, "a/my_note.md") == "my note" and f(p.depth, ".") == 0 and f(p.depth, "a/b") == 2
    assert value(spark, p.join_canonical(F.array(*map(F.lit, (" b", "", "a1 ", "a0"))))) == "a0,a1,b"
    assert [value(spark, p.saturate(F.lit(x))) for x in (-1.0, 0.0, 0.35, 2.0)] == [0.0, 0.0, pytest.approx(0.5775), 1.0]
    assert f(p.artifact_scope, "projects/a/n.md") == "projects/a" and f(p.artifact_scope, "projects/a") is None and f(p.artifact_scope, "festivals/x/y/z") == "festivals/x/y"
    assert f(p.name_tokens, "Ab job-search_[Job] é é") == ["job", "search"]


def test_links(spark):
    text = "See [alpha](alpha.md#x) [s](https://e.com) [a](#h) ![l](../Assets/logo.png) [up](../../x.png) [g](ghost.md) [e](JobSearch/Action%20Plan+.md) [[alpha#i|p]] [[Nope]] #Research, (#job-search) x#no\n# Heading"
    notes = spark.createDataFrame([("Work/beta.md", text), ("e.md", ""), ("fm.md", "---\ntags: [research]\n---\nbody #planning")], "rel_path string, text string")
    known = spark.createDataFrame([("note:Work/alpha.md", "note", "Work/alpha.md"), ("note:Work/JobSearch/Action Plan+.md", "note", "Work/JobSearch/Action Plan+.md"), ("note:A/alpha.md", "note", "A/alpha.md")], "id string, type string, name string")
    got = {(r["to_id"], r["subtype"]) for r in links.link_edges(notes, known).collect()}
    assert got == {("note:Work/alpha.md", "markdown_link"), ("attachment:Assets/logo.png", "attachment"), ("note:Work/JobSearch/Action Plan+.md", "markdown_link")}
    assert [r["to_id"] for r in links.wiki_edges(notes, known).collect()] == ["note:A/alpha.md"]
    assert {(r["rel_path"], r["tag"]) for r in links.inline_tags(notes).collect()} == {("Work/beta.md", "h"), ("Work/beta.md", "research"), ("Work/beta.md", "job-search"), ("fm.md", "planning")}
    c = spark.createDataFrame([("p.canvas", '{"nodes":[{"type":"file","file":"Work/alpha.md"},{"type":"file","file":"no"},{"type":"text"}]}'), ("bad.canvas", "{")], "rel_path string, text string")
    assert [tuple(r) for r in links.canvas_edges(c, known).collect()] == [("canvas:p.canvas", "note:Work/alpha.md")]
    assert c.where(links.is_json(F.col("text"))).count() == 1


def test_frontmatter(spark):
    rows = [
        ("a/my_file.md", "---\ntitle: My Note\naliases: [my-alt, another]\ntags: [research, jobs]\ntype: reference\nstatus: active\n---\nx"),
        ("b.md", "---\ntitle: [unterminated\n---\nx"), ("c_d.md", "---\n---\n# body"), ("e.md", "no"), ("f.md", ""), ("g.md", "---\n- list\n---\n"), ("h.md", "---\ntags: one\n---\n"),
    ]
    meta = {r["rel_path"]: r["metadata"] for r in links.note_metadata(spark.createDataFrame(rows, "rel_path string, text string")).collect()}
    assert meta["a/my_file.md"] == {"title": "My Note", "aliases": "another,my-alt", "tags": "jobs,research", "type": "reference", "status": "active"}
    assert meta["b.md"] == {"title": "b"} and meta["c_d.md"] == {"title": "c d"} and meta["g.md"] == {"title": "g"} and meta["h.md"] == {"title": "h"}


def test_graph(spark):
    e = lambda *x: spark.createDataFrame([(a, b, "t", "explicit") for a, b in x], "from_id string, to_id string, type string, source string")
    n = spark.createDataFrame([(x,) for x in "ABCD"], "id string")
    chain = e(("A", "B"), ("B", "C"), ("C", "D"), ("D", "ghost"))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    ns, es = graph.neighbourhood(n, chain, "B", 1)
    assert ids(ns) == ["A", "B", "C"] and es.count() == 2
    assert graph.neighbourhood(n, chain, "Z", 1)[0].count() == 0 and ids(graph.neighbourhood(n, chain, "B", 0)[0]) == ["B"]
    assert graph.neighbourhood(n, chain, "D", 1)[1].count() == 2
    assert ids(graph.neighbours(chain, n, "D")) == ["C"]
    assert [r["id"] for r in graph.shortest_path(chain, "A", "D").orderBy("step").collect()] == list("ABCD")
    assert graph.shortest_path(chain, "D", "A").count() == 0
    assert {r["id"]: r["layer"] for r in graph.topological_layers(chain).collect()} == {"A": 0, "B": 1, "C": 2, "D": 3, "ghost": 4}
    loop = e(("A", "B"), ("B", "A"), ("X", "A"))
    with pytest.raises(graph.GraphError):
        graph.topological_layers(loop)
    assert {r["id"]: r["layer"] for r in graph.topological_layers(loop, strict=False).collect()} == {"X": 0, "A": -1, "B": -1}
    assert graph.topological_layers(e()).count() == 0 and graph.simple_digraph(n, chain).count() == 3


def test_shortest_path_of_any_length(spark):
    steps = [(f"c{i:02}", f"c{i + 1:02}") for i in range(67)] + [("c66", "b"), ("b", "c68"), ("c67", "c68"), ("c40", "c02"), ("x", "c00")]
    chain = spark.createDataFrame(steps, "from_id string, to_id string")
    path = lambda *a: [r["id"] for r in graph.shortest_path(chain, *a).orderBy("step").collect()]
    assert path("c00", "c68") == [f"c{i:02}" for i in range(67)] + ["b", "c68"]
    assert path("c64", "c68", 4) == ["c64", "c65", "c66", "b", "c68"] and path("c64", "c68", 3) == []
    assert path("c68", "c00") == [] and path("b", "b") == ["b"]


def test_layers_of_all_edges(spark, tmp_path):
    from lodegraph.plans import registry

    rnd = random.Random(4)
    # Chains among a0.., a loop with ids before and behind it, an edge to itself, repeats, ids of any kind.
    pairs = [(f"note:a{i}", f"tag:a{j}" if j % 5 == 0 else f"note:a{j}") for i, j in ((rnd.randrange(0, 30), rnd.randrange(0, 60)) for _ in range(90)) if i < j]
    pairs += [("p", "l1"), ("l1", "l2"), ("l2", "l1"), ("l2", "q"), ("q", "r"), ("s", "s"), ("r2", "r3"), *pairs[:5]]
    rows = [(a, b, rnd.choice(["links_to", " Contains "]), 1.0, "explicit", "", "", None) for a, b in pairs] + [(None, "z", "t", 1.0, "explicit", "", "", None), ("z", "", "t", 1.0, "explicit", "", "", None)]
    spark.createDataFrame(rows, "from_id string, to_id string, type string, confidence double, source string, subtype string, note string, created_at timestamp").write.parquet(f"{tmp_path}/edges.parquet")
    into = {x: {a for a, b in pairs if b == x} for pair in pairs for x in pair}
    want, layer = {}, 0
    while free := [x for x in into if x not in want and into[x] <= want.keys()]:
        want |= dict.fromkeys(free, layer)
        layer += 1
    got = [tuple(r) for r in registry.queries()["topo_layers_all"](spark, str(tmp_path)).select("id", "layer").collect()]
    assert len(got) == len(into) and dict(got) == {x: want.get(x, -1) for x in into}
    assert {x for x, n in got if n == -1} == {"l1", "l2", "q", "r", "s"} and layer > 2


def test_whole_groups_by_membership(spark):
    rows = [("shared_tag", "big", f"n{i:03}") for i in range(300)] * 2 + [("shared_tag", "small", "n001"), ("same_folder", "big", "n002")]
    members = spark.createDataFrame(rows, "source string, value string, id string")
    got = sorted(tuple(r) for r in inference.memberships(members).select("source", "value", "id", "n_members").collect())
    assert got == sorted((*x, 300 if x[:2] == ("shared_tag", "big") else 1) for x in set(rows))
    assert inference.candidate_pairs(members).count() == 128 * 127 // 2 < inference.candidate_pairs(members, None).count() == 300 * 299 // 2


def test_scopes(spark):
    f = spark.createDataFrame([("bin/x", "ignored"), ("bin/y", "ignored"), ("src/a", "tracked"), ("src/b", "ignored"), ("e/f/g", "Ignored ")], "p string, s string")
    assert sorted(r["folder"] for r in scopes.ignored_folders(f, "p", "s").collect()) == ["bin", "e", "e/f"]
    code = spark.createDataFrame([("r/cmd/main.go", "// package no\n  package main\n", "go"), ("r/u.py", "package x", "python")], "rel_path string, content string, language string")
    n, e = scopes.code_slices(code)
    assert sorted(r["id"] for r in n.collect()) == ["file:r/cmd/main.go", "file:r/u.py", "package:r/cmd:main"] and e.count() == 4


def test_inference(spark):
    row = lambda name, meta=None: ("note:" + name, "note", name, "", "", meta or {}, None, None)
    n = spark.createDataFrame([row("Work/job-search-status-alpha.md"), row("Work/job-search-status-beta.md"), row("Other/c.md"), row("projects/alpha/notes/plan.md"), row("projects/alpha/notes/recap.md"), row("A/one.md", {"repo_root": "."}), row("B/two.md", {"repo_root": "."})], TABLES["nodes"])
    pairs = inference.candidate_pairs(inference.groups(n))
    edges = {(r["from_id"][5:], r["to_id"][5:]): r for r in inference.inferred_edges(pairs, n).collect()}
    assert set(edges) == {("Work/job-search-status-alpha.md", "Work/job-search-status-beta.md"), ("projects/alpha/notes/plan.md", "projects/alpha/notes/recap.md")}
    a, b = edges.values()
    similar, owned = (a, b) if a["type"] == "similar_to" else (b, a)
    assert similar["confidence"] == pytest.approx(1 - 0.45**2) and owned["type"] == "relates_to" and "artifact_owned" in owned["note"]
    many = spark.createDataFrame([("s", "v", f"n{i:03}") for i in range(300)] * 2, "source string, value string, id string")
    assert inference.candidate_pairs(many, cap=4).count() == 6 and inference.candidate_pairs(many, cap=None).count() == 300 * 299 // 2
    assert inference.candidate_pairs(many, cap=4, budget=5).count() == 5 and inference.capped_groups(many).first()["n_members"] == 300


def test_diff_and_status(spark):
    s = "rel_path string, mtime_ns bigint, content_hash string"
    prior = spark.createDataFrame([("same", 1, "h"), ("touched", 1, "h"), ("edited", 1, "h"), ("gone", 1, "h"), ("unread", 1, "h")], s)
    now = spark.createDataFrame([("same", 1, "h"), ("touched", 2, "h"), ("edited", 2, "i"), ("new", 1, "h"), ("unread", 2, None)], s)
    got = {r["rel_path"]: r["change"] for r in refresh.inventory_diff(prior, now).collect()}
    assert got == {"same": "same", "touched": "same", "edited": "changed", "gone": "deleted", "new": "added", "unread": "changed"}
    assert sorted(r["rel_path"] for r in refresh.to_hash(prior, now).collect()) == ["edited", "new", "touched", "unread"]
    meta = lambda *x: spark.createDataFrame(list(x), TABLES["graph_meta"])
    assert refresh.verdict(meta()) == "fresh" and refresh.verdict(meta(("graph_schema_version", "old"))) == "incompatible"
    assert refresh.decide_mode(meta(("graph_schema_version", refresh.SCHEMA_VERSION)), prior) == ("refresh", False)


def test_ledger(spark):
    def event(i, ts, kind, scope=None, payload=None, evidence=None, source="command", action=None, why=None):
        names = "campaign festival phase sequence task intent workitem quest".split()
        return (1, i, f"2026-07-12T{ts}:00Z", kind, action, tuple((scope or {}).get(n) for n in names), None, why, json.dumps(payload or {}), evidence, source)

    path = lambda x: ("path", None, None, x, None)
    from lodegraph.model import EVENTS

    ev = spark.createDataFrame(
        [
            event("dec-001", "10:00", "decided", {"festival": "DF0001"}, {"title": "D8", "because_of": "dec-000", "priors": ["decision:x"]}, source="explicit", why="w"),
            event("ev-001", "11:00", "evidence_attached", {"intent": "demo"}, None, [("commit", "root", "abc", None, None), path("docs/n.md"), ("url", None, None, None, "u")], action="act-1"),
            event("tr-001", "12:00", "transitioned", {"intent": "demo"}, {"to": "dungeon/completed/", "promoted_to": "festivals/active/demo-fest-DF0001", "target": "festival"}),
            event("fix", "12:30", "repaired", {"intent": "demo"}, {"note": "n1"}, action="act-1"),
            event("rec", "12:40", "reconciled", {"festival": "demo-fest-DF0001"}, {"kind": "completed"}),
            event("self", "12:45", "reconciled", {"festival": "nope"}, {"kind": "reconciled"}),
            event("unk", "13:00", "future"),
            event("unk", "13:00", "future"),
        ],
        EVENTS,
    )
    n = spark.createDataFrame([("festival:demo-fest-DF0001", "festival", "demo-fest-DF0001"), ("intent:demo", "intent", "demo"), ("folder:.", "folder", ".")], "id string, type string, name string")
    told = ledger.resolved(ledger.prepared(ev), n).cache()
    assert {r[0]: r[1] for r in ledger.report(ev).collect()} == {"read": 7, "applied": 6, "unknown": 1}
    assert {r["id"]: r["artifact"] for r in told.collect()}["dec-001"] == "festival:demo-fest-DF0001"
    assert {r["artifact"]: r["status"] for r in ledger.artifact_status(told).collect()} == {"intent:demo": "completed", "festival:demo-fest-DF0001": "completed"}
    assert [(r["id"], r["name"]) for r in ledger.decisions(told).collect()] == [("decision:dec-001", "D8")]
    assert sorted(r["to_id"] for r in ledger.because_of(told).collect()) == ["decision:dec-000", "decision:x"]
    made = {r["subtype"]: r for r in ledger.produced(told, n).collect()}
    assert set(made) == {"commit", "path"} and made["path"]["note"] == "docs/n.md (repaired)" and made["commit"]["note"] == "root@abc (repaired)"
    a = ledger.actions(told).first()
    assert a["id"] == "action:act-1" and a["repaired"] and a["repair_note"] == "n1"
    assert [(r["from_id"], r["to_id"], r["source"]) for r in ledger.promoted(told, n).collect()] == [("intent:demo", "festival:demo-fest-DF0001", "ledger")]
    items = spark.createDataFrame([("slug", "WI-1", "i1", "design_doc:a", 1), ("slug", "", None, "design_doc:b", 2)], "slug string, ref string, item_id string, id string, seq int")
    assert {r["alias"]: r["id"] for r in ledger.workitem_aliases(items).collect()} == {"slug": "design_doc:b", "WI-1": "design_doc:a", "i1": "design_doc:a"}
