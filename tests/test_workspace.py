"""Reading, building, storing and refreshing a workspace of files; the ledger as a stream."""

import json
import os

import pytest

from lodegraph.model import SCHEMA_VERSION, TABLES
from lodegraph.operators import graph, search
from lodegraph.plans import build
from lodegraph.sources import workspace
from lodegraph.sources.store import Store
from lodegraph.streaming import ledger_stream


@pytest.fixture()
def root(tmp_path):
    files = {
        "projects/alpha/README.md": "hello",
        "Work/alpha.md": "---\ntitle: A\ntags: [x]\n---\n[b](beta%20x.md) #Plan",
        "Work/beta x.md": "body",
        "Work/m.canvas": '{"nodes":[{"type":"file","file":"Work/alpha.md"}]}',
        "Work/bad.canvas": "{",
        "bin/x": "ignored",
        "projects/tool/main.go": "package main\n",
        "projects/tool/.git/HEAD": "x",
        ".gitmodules": '[submodule "t"]\n\tpath = projects/tool\n',
        ".campaign/intents/inbox/idea.md": "idea",
        "festivals/active/demo-DF1/fest.yaml": "project_path: projects/alpha\n",
        "workflow/design/plan/.workitem": "id: WI-1\n",
        "festivals/active/demo-DF1/001_B/01_s/01_t.md": "task",
        "festivals/active/demo-DF1/001_B/01_s/SEQUENCE_GOAL.md": "goal",
        ".campaign/events/2026-07/a.jsonl": json.dumps({"v": 1, "id": "d1", "ts": "2026-07-12T10:00:00Z", "kind": "decided", "scope": {"festival": "DF1"}, "source": "explicit"}) + "\njunk\n" + json.dumps({"v": 1, "id": "d2", "ts": "2026-07-12T11:00:00Z", "kind": "completed", "scope": {"workitem": "WI-1"}}) + "\n",
    }
    for k, v in files.items():
        path = tmp_path / "ws" / k
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(v)
    return str(tmp_path / "ws")


def probe(repo):
    return {} if repo.endswith("tool") else {"Work/alpha.md": "tracked", "Work/beta x.md": "untracked", "bin/x": "ignored"}


def test_inventory(spark, root):
    rows = {r["rel_path"]: r for r in workspace.inventory(spark, root, probe=probe).collect()}
    assert rows["Work/alpha.md"]["git_state"] == "tracked" and rows["projects/tool/main.go"]["git_state"] == "unknown"
    assert "bin/x" not in rows and "bin" not in rows and "projects/tool/.git/HEAD" not in rows
    assert rows["projects/tool/main.go"]["repo_root"].endswith("tool") and rows["projects/tool/main.go"]["rel_to_repo"] == "main.go"
    every = workspace.inventory(spark, root, with_ignored=True, probe=probe)
    assert every.where("is_ignored").count() == 2
    bounds = {r["rel_path"]: r["is_submodule"] for r in workspace.boundaries(spark, root).collect()}
    assert bounds == {".": False, "projects/tool": True}
    assert workspace.find_root(os.path.join(root, "Work")) == root


def test_tree_in_rounds(spark, root, tmp_path):
    """The same rows whatever a task lists at once; repositories within repositories, links and git's own folders by the rules."""
    for path in ("projects/tool/vendor/inner/.git/HEAD", "projects/tool/vendor/inner/x.py", "deep/a/b/c/d.md", "link.md"):
        (tmp_path / "ws" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "ws" / path).write_text("x")
    os.symlink(tmp_path / "ws" / "Work", tmp_path / "ws" / "loop")
    os.symlink(tmp_path / "none", tmp_path / "ws" / "broken")
    want = set()
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if n != ".git"]
        want |= {os.path.join(folder, n) for n in names + files if os.path.exists(os.path.join(folder, n))}
    for at_once in (1, 3, 10_000):
        rows = {r["path"]: r for r in workspace.tree(spark, root, at_once).collect()}
        assert set(rows) == want and {k for k, r in rows.items() if r["repo"]} == {f"{root}/projects/tool"}
        assert rows[f"{root}/projects/tool/vendor/inner/x.py"]["owner"] == f"{root}/projects/tool" and rows[f"{root}/loop"]["is_dir"]
    own = {r["rel_path"] for r in workspace.inventory(spark, root, probe=probe, skip=("deep/a",)).collect()}
    assert "projects/tool" not in own and "projects/tool/vendor/inner/x.py" in own and "deep" in own and not any(x.startswith("deep/") for x in own)


def test_build_refresh_and_store(spark, root, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = build.refresh_workspace(spark, root, store, probe)
    assert first["mode"] == "rebuild" and first["stale_before"]
    ids = {r["id"]: r for r in store.read("nodes").collect()}
    for x in ("project:alpha", "project:tool", "festival:demo-DF1", "festival:demo-DF1/001_B/01_s/01_t.md", "intent:idea", "note:Work/alpha.md", "canvas:Work/m.canvas", "tag:plan", "file:projects/tool/main.go", "package:projects/tool:main", "repo:projects/tool", "decision:d1"):
        assert x in ids, x
    assert "canvas:Work/bad.canvas" not in ids and not any("SEQUENCE_GOAL" in i and "note" not in i for i in ids)
    edges = {(r["from_id"], r["to_id"], r["type"]) for r in store.read("edges").collect()}
    assert ("note:Work/alpha.md", "note:Work/beta x.md", "links_to") in edges and ("festival:demo-DF1", "decision:d1", "contains") in edges
    assert ("festival:demo-DF1", "project:alpha", "links_to") in edges and ids["design_doc:plan"]["status"] == "completed"
    assert all(a in ids and b in ids for a, b, _ in edges)
    told = {(r["from_id"], r["to_id"], r["type"]): r for r in store.read("edges").collect()}
    done = told["folder:workflow/design", "design_doc:plan", "contains"], told["folder:.", "design_doc:plan", "contains"]
    assert [r["subtype"] for r in done] == ["", "completed"] and done[1]["note"] == "completed" and done[1]["created_at"].isoformat() == "2026-07-12T11:00:00"
    assert ids["decision:d1"]["metadata"] == {"event_id": "d1"} and ids["decision:d1"]["created_at"].isoformat() == "2026-07-12T10:00:00"
    assert ids["design_doc:plan"]["updated_at"].isoformat() == "2026-07-12T11:00:00"
    assert first["ledger"] == {"events_read": 2, "events_applied": 2, "events_skipped": 0, "unknown_kinds": 0, "nodes_added": 1, "edges_added": 2, "read_skipped_lines": 1}
    assert store.meta()["unreadable_lines"] == "1" and store.version() == SCHEMA_VERSION
    assert store.meta()["search_available"] == "true" and first["reindexed"] == first["indexed_files"] and not first["truncated"]
    index, nodes = build.stored_index(store), store.read("nodes")
    found = [r["node_id"] for r in search.ordered(search.search(index, nodes, search.Options("body"))).collect()]
    plain = [r["node_id"] for r in search.ordered(search.search(search.build_index(store.read("search_docs")), nodes, search.Options("body"))).collect()]
    assert found == plain == ["note:Work/beta x.md"]
    seen = graph.micrograph(nodes, store.read("edges"), "note:Work/alpha.md", 1)
    assert [(x["edge_type"], x["id"]) for x in seen["outgoing"] if x["source"] == "explicit"] == [("links_to", "note:Work/beta x.md"), ("references", "tag:plan")] and seen["n_nodes"] > 3
    assert graph.micrograph(nodes, store.read("edges"), "note:none") is None
    again = build.refresh_workspace(spark, root, store, probe)
    assert again["reindexed"] == 0
    assert (again["added"], again["changed"], again["deleted"], again["stale_before"]) == (0, 0, 0, False)
    os.remove(os.path.join(root, "Work", "beta x.md"))
    open(os.path.join(root, "Work", "new.md"), "w").write("n")
    third = build.refresh_workspace(spark, root, store, probe)
    assert (third["added"], third["deleted"], third["mode"]) == (1, 1, "refresh")


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame([(i, "note", n, "", "", None, None, None) for i, n in x], TABLES["nodes"])
    assert s.read("nodes").count() == 0 and s.version() is None
    s.upsert("nodes", rows(("a", "1"), ("b", "1")), ["id"])
    s.upsert("nodes", rows(("a", "2")), ["id"])
    s.insert_new("nodes", rows(("b", "9"), ("c", "3"), ("c", "3")), ["id"])
    assert {r["id"]: r["name"] for r in s.read("nodes").collect()} == {"a": "2", "b": "1", "c": "3"}
    s.delete("nodes", "id", ["a", "none"])
    s.set_meta(k="v")
    s.set_meta(k="w", l="x")
    assert s.meta() == {"k": "w", "l": "x"} and s.read("nodes").count() == 2
    with pytest.raises(ValueError):
        s.upsert("nodes", rows(("", "1")), ["id"])
    s.delete_all()
    assert s.read("nodes").count() == 0
    pointer = tmp_path / "s" / "_CURRENT"
    (tmp_path / "s" / "._CURRENT.crc").unlink(missing_ok=True)
    pointer.write_text(pointer.read_text().replace(SCHEMA_VERSION, "other"))
    assert s.read("nodes").count() == 0


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda i, h, k: json.dumps({"v": 1, "id": i, "ts": f"2026-07-12T{h:02}:10:00Z", "kind": k})
    (src / "a.jsonl").write_text("\n".join([line("1", 1, "created"), line("1", 1, "created"), "junk", line("2", 2, "decided")]))
    events = ledger_stream.once_each(ledger_stream.read_events(spark, str(src)))
    seen = []
    ledger_stream.into(events, str(tmp_path / "cp"), lambda df, n: seen.extend(r["id"] for r in df.collect())).awaitTermination()
    (src / "b.jsonl").write_text("\n".join([line("2", 2, "decided"), line("3", 3, "created")]))
    ledger_stream.into(events, str(tmp_path / "cp"), lambda df, n: seen.extend(r["id"] for r in df.collect())).awaitTermination()
    assert sorted(seen) == ["1", "2", "3"]
    q = ledger_stream.activity(ledger_stream.read_events(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("act").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n_events) from act").first()[0] == 5


def test_decisions_after_other_text(spark, tmp_path):
    from datetime import datetime

    from lodegraph.plans import registry

    event = lambda id_, kind="decided", why="": '{"v": 1, "id": "%s", "kind": "%s", "why": "%s"}' % (id_, kind, why)
    texts = [
        event("a", why="first") + "\n" + event("b", "created") + "\n\n" + event("c"),
        "# Change log\n\nWhat came of it:\n" + event("d", why="late") + "\r\n  " + event("e") + "\nMore.\n" + event("f", "created"),
        '{"id": 1}\n{"id": null, "v": 1, "kind": "decided"}\n{"v": 1, "kind": "decided"}\n{broken "kind": "decided"}\nthe {"v": 1} in a sentence\n' + event("a", why="first"),
        "no events", "", None,
    ]
    rows = [(f"n{i}.md", x, datetime(2024, 1, 1 + i)) for i, x in enumerate(texts)] + [(None, event("g"), None)]
    spark.createDataFrame(rows, "rel_path string, text string, updated_at timestamp_ntz").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["id"], r["name"]) for r in registry.queries()["ledger_decisions"](spark, str(tmp_path)).collect())
    assert got == [("decision:a", "first"), ("decision:c", "c"), ("decision:d", "late"), ("decision:e", "e")]


def test_commands(spark, root, tmp_path, capsys, monkeypatch):
    from lodegraph.__main__ import main

    monkeypatch.chdir(tmp_path)
    where = ["--root", root, "--store", str(tmp_path / "st")]

    def run(*args):
        code = main([args[0], *where, *args[1:]])
        return code, capsys.readouterr()

    code, out = run("build")
    assert code == 0 and json.loads(out.out)["ledger"]["events_applied"] == 2
    code, out = run("status")
    told = json.loads(out.out)
    assert told["search_available"] is True and told["stale"] == "false" and int(told["nodes_count"]) > 10
    assert [r["node_id"] for r in json.loads(run("query", "body")[1].out)["results"]] == ["note:Work/beta x.md"]
    assert "note:Work/beta x.md" in {r["node_id"] for r in json.loads(run("related", "--path", "Work/alpha.md")[1].out)["items"]}
    code, out = run("context", "Work/alpha.md", "--hops", "1")
    assert code == 0 and "→ Work/beta x.md [links_to] (note)" in out.out and "Neighborhood: " in out.out
    code, out = run("context", "Work/alpha.md", "--json", "--mode", "explicit")
    assert {x["source"] for x in json.loads(out.out)["outgoing"]} == {"explicit"}
    code, out = run("context", "zzz nothing")
    assert code == 1 and "no node" in out.err
    code, out = run("render", "--node", "note:Work/alpha.md", "--format", "html")
    assert code == 0 and (tmp_path / out.out.strip()).exists() and "/" not in out.out.strip()
