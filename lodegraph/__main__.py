"""python -m lodegraph COMMAND: version, build, refresh, status, query, related, context, render."""

from __future__ import annotations

import argparse
import json
import os
import sys
import webbrowser

from lodegraph import __version__


def _session():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("lodegraph").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _lines(seen: dict) -> list[str]:
    """A node's surroundings as text."""
    out = [f"=== {seen['name']} ===", f"Type:   {seen['type']}", f"Path:   {seen['path']}", *([f"Status: {seen['status']}"] if seen["status"] else [])]
    for title, arrow in (("outgoing", "→"), ("incoming", "←")):
        if seen[title]:
            out += ["", title.capitalize() + ":", *(f"  {arrow} {x['name']} [{x['edge_type']}] ({x['type']})" for x in seen[title])]
    return [*out, "", f"Neighborhood: {seen['n_nodes']} nodes, {seen['n_edges']} edges ({seen['hops']} hops)"]


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="lodegraph")
    sub = a.add_subparsers(dest="command", required=True)
    for name in ("version", "build", "refresh", "status", "query", "related", "context", "render"):
        c = sub.add_parser(name)
        c.add_argument("--root", default="")
        c.add_argument("--store", default="")
        c.add_argument("--json", action="store_true")
        if name == "query":
            c.add_argument("term")
            for x in ("--scope", "--path-prefix", "--type"):
                c.add_argument(x, default="")
            c.add_argument("--tracked", action="store_true")
            c.add_argument("--untracked", action="store_true")
        if name == "related":
            c.add_argument("--path", required=True)
        if name in ("query", "related", "context", "render"):
            c.add_argument("--mode", default="hybrid")
        if name in ("query", "related"):
            c.add_argument("--limit", type=int, default=20 if name == "query" else 10)
        if name == "context":
            c.add_argument("node")
        if name in ("context", "render"):
            c.add_argument("--hops", type=int, default=2)
        if name == "render":
            c.add_argument("--node", default="")
            c.add_argument("--scope", default="")
            c.add_argument("--format", choices=["dot", "json", "html"], default="dot")
            c.add_argument("--output", default="", help="a file; by default one named after the node or the scope")
            c.add_argument("--open", action="store_true", help="show the file in the browser")
    o = a.parse_args(argv)
    if o.command == "version":
        print(__version__)
        return 0
    if o.command == "query" and o.tracked and o.untracked:
        a.error("--tracked and --untracked exclude each other")

    from lodegraph.operators import graph, render, search
    from lodegraph.plans import build
    from lodegraph.sources.store import Store
    from lodegraph.sources.workspace import find_root

    root = o.root or find_root()
    # Kept outside the scanned tree, so that a refresh doesn't see its own store.
    store = Store(spark := _session(), o.store or os.path.realpath(root).rstrip("/") + ".lodegraph")
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str, indent=2))
    if o.command == "build":
        if not os.path.isdir(os.path.join(root, "projects")):
            print("no projects folder", file=sys.stderr)
            return 1
        show(build.build_workspace(spark, root, store))
        return 0
    if o.command == "refresh":
        show({"schema_version": "graph-refresh/v1alpha1", "campaign_root": root} | build.refresh_workspace(spark, root, store))
        return 0
    nodes, edges = store.read("nodes"), store.read("edges")
    if o.command == "status":
        from lodegraph.operators.refresh import status

        tables = {t: store.read(t) for t in ("nodes", "edges", "search_docs", "indexed_files")}
        probed = {"search_available": search.available(build.stored_index(store))}
        show({"schema_version": "graph-status/v1alpha1"} | {r["key"]: r["value"] for r in status(store.read("graph_meta"), tables).collect()} | probed)
    elif o.command == "query":
        docs = store.read("search_docs")
        page = search.search(build.stored_index(store), nodes, search.Options(o.term, o.scope, o.path_prefix, o.type, o.tracked, o.untracked, search.parse_mode(o.mode), o.limit))
        rows = search.ordered(search.with_snippets(page, docs, o.term)).collect()
        show({"schema_version": "graph-query/v1alpha1", "campaign_root": root, "query": o.term, "mode": search.parse_mode(o.mode), "limit": o.limit, "results": [r.asDict() for r in rows]})
    elif o.command == "related":
        items = search.related(build.stored_index(store), nodes, edges, o.path, o.mode, o.limit)
        show({"schema_version": "graph-related/v1alpha1", "campaign_root": root, "query_path": o.path, "mode": o.mode, "items": [r.asDict() for r in items.collect()]})
    else:
        if getattr(o, "node", ""):
            at = search.resolve(build.stored_index(store), nodes, o.node, by_name=True).head()
            o.node = at["node_id"] if at else o.node
        if o.command == "context":
            seen = graph.micrograph(nodes, edges, o.node, o.hops, o.mode)
            if seen is None:
                print(f"no node {o.node!r}", file=sys.stderr)
                return 1
            show({"schema_version": "graph-context/v1alpha1", **seen}) if o.json else print("\n".join(_lines(seen)))
            return 0
        if o.node:
            nodes, edges = graph.neighbourhood(nodes, edges, o.node, o.hops)
        elif o.scope:
            nodes = graph.scope_slice(nodes, o.scope)
            edges = graph.induced(edges, nodes)
        edges = graph.mode_filter(edges, o.mode)
        target = o.output or f"{(o.node or o.scope or 'graph').translate(str.maketrans('/:', '__', chr(92)))}.{o.format}"
        {"dot": render.write_dot, "json": render.write_json, "html": render.write_html}[o.format](nodes, edges, target)
        print(target)
        if o.open:
            webbrowser.open(f"file://{os.path.realpath(target)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
