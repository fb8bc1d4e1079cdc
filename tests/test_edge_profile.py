from collections import Counter

from skeinlake.model import analogs
from skeinlake.operators import graph
from skeinlake.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_ends_of_edges_are_counted_apart_in_parts_that_grow_with_the_rows(spark, monkeypatch):
    want: dict = {}
    for r in analogs.edges(spark, SMALL).collect():
        n, src, dst = want.setdefault(r.predicate, [Counter(), set(), set()])
        n["edges"] += 1
        src.add(r.src)
        dst.add(r.dst)
    for rows in (graph.PART_ROWS, 1000):
        monkeypatch.setattr(graph, "PART_ROWS", rows)
        df = catalogue.queries()["edge_predicate_profile"](spark, SMALL)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan  # each edge twice, in one map
        lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
        assert any("RepartitionByExpression" in x and x.rstrip().endswith(str(graph.parts_for(lines))) for x in plan.splitlines())
        assert {r.predicate: (r.edges, r.sources, r.targets) for r in df.collect()} == {k: (n["edges"], len(a), len(b)) for k, (n, a, b) in want.items()}


def test_missing_ends_are_edges_but_no_names(spark):
    rows = [("a", "P", "x"), ("a", "P", "x"), (None, "P", "y"), ("b", "P", None), (None, "Q", None)]
    got = {tuple(r) for r in graph.profile(spark.createDataFrame(rows, "src string, predicate string, dst string"), len(rows)).select("predicate", "edges", "sources", "targets").collect()}
    assert got == {("P", 4, 2, 2), ("Q", 1, 0, 0)}
