import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from skeinlake.functions import core
from skeinlake.model import schemas as s
from skeinlake.operators import audit, graph, ingest, sensors, sync
from skeinlake.sources import files
from skeinlake.streaming import inbox as stream

NOTE = """---
id: "work:{slug}"
parent: "work:root"
related: {related}
title: "{title}"
description: "about {slug}"
type: "note"
domain: "work"
exposure: "{exposure}"
status: "active"
created: 2026-01-02
updated: 2026-01-03
tags: ["one"]
---

# {title}

Body of {slug}.

## Sources

- [record](work/assets/{slug}.md)
"""


@pytest.fixture(scope="module")
def instance(tmp_path_factory):
    root = tmp_path_factory.mktemp("instance")
    for d in ("work/assets", "work/inbox/trip", "work/inbox/archive", "work/notes"):
        (root / d).mkdir(parents=True)
    edge = '[{predicate: "GOVERNS", target: "work:beta", rationale: "It does."}]'
    (root / "work/notes/alpha.md").write_text(NOTE.format(slug="alpha", title="Alpha Plan", exposure="public", related=edge))
    (root / "work/notes/beta.md").write_text(NOTE.format(slug="beta", title="Beta Plan", exposure="private", related="[]"))
    (root / "work/notes/bad.md").write_text("---\n: [\n---\nno front matter")
    (root / "work/assets/alpha.md").write_text("record")
    (root / "work/inbox/archive/alpha.txt").write_text("raw")
    (root / "work/inbox/trip/a.txt").write_text("hello")
    (root / "work/inbox/trip/b.xyz").write_bytes(b"??")
    (root / "work/inbox/page.html").write_text("<title>T</title><p>x &amp; y</p>")
    (root / "work/inbox/debrief-1.md").write_text("pending")
    return str(root)


@pytest.fixture(scope="module")
def nodes(spark, instance):
    return files.read_notes(spark, instance).cache()


@pytest.fixture(scope="module")
def captures(spark, instance):
    return files.read_captures(spark, instance).cache()


def found(df):
    return {(r.rule, r.subject) for r in df.collect()}


def test_notes(nodes):
    rows = {r.path: r for r in nodes.collect()}
    a = rows["work/notes/alpha.md"]
    assert (a.id, a.parent, a.created, a.tags, a.source_links, a.malformed) == ("work:alpha", "work:root", date(2026, 1, 2), ["one"], ["work/assets/alpha.md"], False)
    assert a.related[0].predicate == "GOVERNS" and rows["work/notes/bad.md"].malformed and len(rows) == 3


def test_captures_routes_and_batches(spark, captures):
    rows = {r.capture: r for r in captures.collect()}
    assert set(rows) == {"work/inbox/trip/a.txt", "work/inbox/trip/b.xyz", "work/inbox/page.html"}
    assert (rows["work/inbox/trip/a.txt"].batch, rows["work/inbox/page.html"].batch, rows["work/inbox/page.html"].domain) == ("trip", None, "work")
    routes = spark.createDataFrame([("txt", None, "reader", 1), ("html", "linux", "page", 1), ("html", None, "plain", 2)], s.ROUTES)
    tools = {r.capture: r.tool for r in ingest.routed(captures, routes, "linux").collect()}
    assert tools == {"work/inbox/trip/a.txt": "reader", "work/inbox/trip/b.xyz": None, "work/inbox/page.html": "page"}
    assert [r.capture for r in ingest.unrecognised(captures, routes).collect()] == ["work/inbox/trip/b.xyz"]
    plan = json.loads(ingest.plan(captures, routes, "linux").first().plan)
    assert plan["captures"] == 3 and plan["unrecognised"] == ["work/inbox/trip/b.xyz"] and len(plan["handoffs"]) == 2
    assert plan == json.loads(ingest.plan(captures.repartition(5), routes, "linux").first().plan)
    assert ingest.select(captures, "trip").count() == 2
    done = ingest.routed(captures, routes, "linux")
    assert [r.unit for r in ingest.debrief_records(done, F.col("tool").isNotNull()).collect()] == ["work/inbox/page.html"]
    assert ingest.restored(done.where("batch is not null"), F.col("tool").isNotNull()).count() == 2
    records = spark.createDataFrame([("r1", "work", "pending", "x"), ("r2", "work", "archived", "y")], s.DEBRIEFS)
    assert {(r.kind, r["items"]) for r in ingest.inbox(captures, records).collect()} == {("file", 1), ("batch", 2), ("debrief", 1)}
    assert {r.state for r in ingest.closed(records, records.where("record_id = 'r1'")).collect()} == {"archived"}


def test_sensors(spark):
    rows = [("a", "txt", b""), ("b", "html", b"<p>x &amp; y</p>"), ("c", "json", b"{"), ("d", "mp4", b"1")]
    got = {r.capture: (r.status, r.text) for r in sensors.extract(spark.createDataFrame(rows, "capture string, detected_type string, content binary")).collect()}
    assert got["a"] == ("done", "") and got["b"] == ("done", "x & y") and got["c"][0] == "failed" and got["d"] == ("unsupported", None)


def test_retrieval(nodes):
    one = graph.retrieve(nodes, "alpha plan").collect()
    assert [(r.id, r.match, r.decisive) for r in one] == [("work:alpha", "title", True)]
    tie = graph.retrieve(nodes, "plan").collect()
    assert {r.id for r in tie} == {"work:alpha", "work:beta"} and not any(r.decisive for r in tie)
    assert graph.retrieve(nodes, "nothing such").count() == 0
    assert {(r.id, r.direction) for r in graph.one_hop(graph.edges(nodes), nodes.where("id = 'work:beta'")).collect()} == {("work:beta", "in")}


def test_ancestors_end_at_cycles(spark):
    n = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "id string, parent string")
    assert sorted((r.id, r.ancestor) for r in graph.ancestors(n).collect()) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b"), ("d", "c")]


def test_trace_and_deep(spark, nodes):
    assets = spark.createDataFrame([("work/assets/alpha.md", "work/inbox/archive/alpha.txt")], "path string, archive_path string")
    archives = spark.createDataFrame([("work/inbox/archive/alpha.txt",)], "path string")
    assert {r.id: r.state for r in graph.trace(nodes.where("id is not null"), assets, archives).collect()} == {"work:alpha": "whole", "work:beta": "no record"}
    assert {(r.kind, r.other) for r in graph.deep(nodes, assets, archives, "work:alpha").collect()} == {("edge", "work:beta"), ("evidence", "work/assets/alpha.md")}


def test_gates(spark):
    charters = spark.createDataFrame([("new", f"... {s.CHARTER_PLACEHOLDER}", None, None, None), ("old", "text", ["old:family-a", "old:family-b", "x:family-c"], ["p"] * 4, None)], s.CHARTERS)
    proposals = spark.createDataFrame([("n1", "new"), ("n2", "old"), ("n3", "old")], "id string, domain string")
    assert [r.id for r in graph.mintable(proposals, charters, proposals.where("id <> 'n3'")).collect()] == ["n2"]
    assert found(audit.charter_shape(charters)) == {("charter-placeholder", "new"), ("charter-namespace", "old"), ("charter-principles", "old")}
    e = spark.createDataFrame([("a", "GOVERNS", "b", "why"), ("a", "LIKES", "b", "why"), ("a", "GOVERNS", "c", " ")], s.EDGES)
    assert graph.woven(e, e).count() == 1


def test_audit(spark, nodes):
    frontier = [
        ("ok", "single", "frontier-model", "m", "r", "i1", "all", "low", "h1", None, []),
        ("lost", "single", "frontier-model", "m", "r", "i9", "all", "low", "h1", None, []),
        ("other", "batch", "frontier-model", "m", "r", "i1", "all", "low", None, "inv2", []),
        ("hash", "single", "frontier-model", "m", "r", "i1", "all", "low", "h7", None, []),
        ("bare", "single", "model", None, "r", "i1", "all", "low", None, None, [("GOVERNS", "x", "y")]),
        ("two", "batch", "frontier-model", "m", "r", "i1", "all", "low", "h1", "inv1", []),
    ]
    f = spark.createDataFrame(frontier, s.FRONTIER)
    intakes = spark.createDataFrame([("i1", "batch", "r", ["h1"], None, "inv1", "work")], s.INTAKES)
    inventory = spark.createDataFrame([("inv1", "h1")], "inventory_path string, sha256 string")
    assets = spark.createDataFrame([("work/assets/alpha.md", "gone.txt")], "path string, archive_path string")
    archives = spark.createDataFrame([], "path string")
    got = found(audit.audit(nodes, assets, archives, f, intakes, inventory))
    assert got == {
        ("unresolved-intake", "lost"), ("inventory-mismatch", "other"), ("hash-not-in-inventory", "hash"), ("incomplete-contract", "bare"), ("no-source-pointer", "bare"), ("two-source-pointers", "two"),
        ("edges-on-frontier", "bare"), ("broken-lineage", "work:alpha"), ("broken-lineage", "work:beta"), ("exposure-boundary", "work:alpha"), ("unknown-exposure", None), ("id-shape", "work/notes/bad.md"), ("malformed-note", "work/notes/bad.md"),
    }
    bad = spark.createDataFrame([("work:alpha", "LIKES", "work:none", "")], s.EDGES)
    assert found(audit.unknown_predicate(bad)) | found(audit.dangling_edge(bad, nodes)) == {("unknown-predicate", "work:alpha"), ("dangling-edge", "work:alpha")}


def test_publish_and_upgrade(spark, tmp_path):
    p = lambda *x: spark.createDataFrame([(v,) for v in x], "path string")
    plan = {r.path: r.action for r in sync.overlay(p("code.py", "config.json", "note.md"), p("code.py", "config.json", "new.py"), p("config.json")).collect()}
    assert plan == {"code.py": "replace", "config.json": "keep", "note.md": "keep", "new.py": "add"}
    domains = sync.with_domain(spark.createDataFrame([], s.DOMAINS), "personal:private")
    again = sync.with_domain(domains, "personal:public", "Other")
    assert [tuple(r) for r in again.collect()] == [("personal", "private", "Personal")]
    with pytest.raises(ValueError):
        sync.with_domain(domains, "x:secret")
    notes = spark.createDataFrame([("personal", "a.md", "obsidian://open?vault=x")], "domain string, path string, text string")
    pages = sync.compiled(notes, domains)
    none = spark.createDataFrame([], s.VIOLATION)
    assert sync.publish(none, pages, []) == []
    with pytest.raises(ValueError):
        sync.publish(none, pages, [], only_vaults=True)
    with pytest.raises(ValueError):
        sync.publish(spark.createDataFrame([("r", "s", "")], s.VIOLATION), pages, [str(tmp_path)])
    assert sync.publish(none, pages, [str(tmp_path)]) == ["Personal"]
    assert (tmp_path / "Personal/a.md").read_text() == "obsidian://open?vault=Personal"
    tools = spark.createDataFrame([("speech", "no-such-tool", "get it")], "job string, tool string, hint string")
    assert sync.doctor(tools, files.read_tools(spark, ["no-such-tool"])).first().state == "missing"
    texts = spark.createDataFrame([("a", "x \ty\r\n\n\n\n\n z  ")], "path string, text string")
    once = sync.formatted(texts)
    assert sync.lint(once).count() == 0 and sync.formatted(once).first().text == once.first().text


def test_parts_and_stream(spark, instance, tmp_path):
    row = spark.range(1).select(core.domain_spec(F.lit("a:public")).alias("d"), core.exposure_level(F.lit("restricted")).alias("e"), core.tier(F.lit("w/inbox/archive/x")).alias("t")).first()
    assert (row.d.name, row.e, row.t) == ("a", 1, 3)
    (tmp_path / "inventory.jsonl").write_text('{"relative_path": "a", "bytes": 3}\nnot json\n')
    assert [r.relative_path for r in files.read_inventory(spark, [str(tmp_path / "inventory.jsonl")]).collect() if r._corrupt_record] == [None]
    assert files.read_config(None) == {"vaults": [], "mirrors": []}
    q = stream.counted(stream.arriving(spark, f"{instance}/work/inbox/trip")).writeStream.outputMode("complete").format("memory").queryName("arrivals").start()
    try:
        q.processAllAvailable()
        assert {r.detected_type for r in spark.sql("select * from arrivals").collect()} == {"txt", "xyz"}
    finally:
        q.stop()


def test_entry_runs_without_the_corpus_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert "ingest_plan_by_type" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
