from lodegraph.operators import metadata as m


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, text string")


def edges(df):
    return sorted((r["from_id"], r["to_id"], r["type"], r["confidence"], r["subtype"]) for r in df.collect())


def test_festivals_and_chains(spark):
    nodes = spark.createDataFrame([(x,) for x in ("festival:a", "festival:b", "project:p", "chain:c")], "id string")
    files = frame(spark, ("festival:a", "metadata:\n  chain: c\nproject_path: projects/p/\n"), ("festival:b", "project_path: projects/none"), ("festival:c", "[bad"), ("festival:d", None), ("festival:e", ""))
    assert edges(m.festival_edges(files, nodes)) == [("chain:c", "festival:a", "chain_member", 1.0, ""), ("festival:a", "project:p", "links_to", 1.0, "")]
    chain = frame(spark, ("chain:c", "festivals: [a, b, zzz]\nedges:\n- {from: a, to: b, type: hard}\n- {from: b, to: a, type: soft}\n- {from: a, to: none}\n"))
    assert edges(m.chain_edges(chain, nodes)) == [
        ("chain:c", "festival:a", "chain_member", 1.0, ""), ("chain:c", "festival:b", "chain_member", 1.0, ""), ("festival:a", "festival:b", "depends_on", 1.0, "hard"), ("festival:b", "festival:a", "depends_on", 0.8, "soft"),
    ]


def test_intents_and_work_items(spark):
    nodes = spark.createDataFrame([(x,) for x in ("intent:x", "project:source-proj")], "id string")
    files = frame(spark, ("intent:y", "---\ngathered_from: [x.md, missing]\nrelated_projects: [source-proj]\n---\nbody"), ("intent:z", "no frontmatter"), ("intent:w", "---\ngathered_from: one\n---\n"))
    assert edges(m.intent_edges(files, nodes)) == [("intent:y", "intent:x", "gathered_from", 1.0, ""), ("intent:y", "project:source-proj", "relates_to", 0.8, "")]
    marks = spark.createDataFrame([("workflow/design/slug/.workitem", "id: WI-1\nref: R1"), ("workflow/other/s/.workitem", "id: x"), ("elsewhere/.workitem", "id: x")], "rel_path string, text string")
    assert [tuple(r)[:4] for r in m.work_items(marks).collect()] == [("slug", "R1", "WI-1", "design_doc:slug")]
