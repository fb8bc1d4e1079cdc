from skeinlake.operators import graph


def test_notes_without_a_sound_edge_say_so(spark):
    notes = spark.createDataFrame([("a:1",), ("a:2",), ("a:3",), ("a:3",)], "id string")
    edges = [("a:1", "IMPLEMENTS", "a:2", "why"), ("a:1", "IMPLEMENTS", "a:3", " "), ("a:2", "LIKES", "a:1", "no such predicate"), ("b:9", "IMPLEMENTS", "a:1", "not a note")]
    put = spark.createDataFrame(edges, "src string, predicate string, dst string, rationale string")
    got = {(r.src, r.dst, r.outcome) for r in graph.proposed(notes, put).collect()}
    assert got == {("a:1", "a:2", "proposed"), ("a:2", None, "none warranted"), ("a:3", None, "none warranted")}
    assert graph.proposed(notes, put.limit(0)).where("outcome = 'none warranted'").count() == 3
    assert graph.proposed(notes.limit(0), put).count() == 0
    assert graph.woven(put, put).count() == 2
