"""The catalogue's queries over whole tables, by brute force on fixtures."""

import random
from collections import Counter

from skeinlake.operators import phrases
from skeinlake.plans import catalogue


def _tables(spark, at, **tables):
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_phrases_are_whole_items(spark, tmp_path):
    head = "the same first forty characters of a text "
    texts = [head + "one", head + "two and more", "x " + head.upper() + "ONE", "y " + head + "one", head]
    items = [(5, head + "one"), (150, head + "two"), (250, "and"), (260, head + "three")]
    at = _tables(spark, tmp_path, documents=("doc_id bigint, text string", list(enumerate(texts))), benchmark=("item_id bigint, text string", items))
    got = {tuple(r) for r in catalogue.queries()["topic_containment_whole"](spark, at).collect()}
    assert got == {(i, k) for i, p in items for k, t in enumerate(texts) if p in t}
    want = set()
    for i, p in items:
        place = {k: 0 if t.lower().startswith(p) else 1 for k, t in enumerate(texts) if p in t.lower()}
        best = [k for k, x in place.items() if x == min(place.values())]
        want |= {(i, k, place[k], len(best), len(best) == 1) for k in best}
    assert {tuple(r) for r in catalogue.queries()["retrieve_ties_whole"](spark, at).collect()} == want


def test_overlay_and_evidence_of_whole_tables(spark, tmp_path):
    at = _tables(
        spark, tmp_path, documents=("doc_id bigint", [(1,), (2,), (5,)]), labels=("doc_id bigint", [(1,), (2,), (7,), (7,), (11,)]), pages=("page_id bigint", [(2,), (11,)]),
        orders=("o_orderkey bigint, o_custkey bigint", [(1, 3), (2, 4)]), lineitem=("l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint", [(1, 1, 1, 1)]),
        part=("p_partkey bigint, p_name string", [(1, "p")]), supplier=("s_suppkey bigint, s_name string", [(1, "s")]),
    )
    q = catalogue.queries()
    assert {tuple(r) for r in q["overlay_merge_whole"](spark, at).collect()} == {(1, "replace"), (2, "keep"), (5, "keep"), (7, "add")}
    assert {tuple(r) for r in q["evidence_trace_whole"](spark, at).collect()} == {(1, 1, "p", "s"), (2, None, None, None)}


def test_phrases_by_anchors_equal_plain_search(spark, monkeypatch):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("ab  .") for _ in range(rng.randint(0, n)))
    texts = [(k, make(30)) for k in range(60)] + [(0, "a b a b"), (0, "a b a b"), (None, "a  b"), (7, None)]
    items = [(k, make(7)) for k in range(40)] + [(1, ""), (2, None), (3, "a b a"), (3, "a b a"), (4, " a "), (5, "zz zz zz")]
    want = Counter((k, i, t.startswith(p)) for k, t in texts for i, p in items if t is not None and p is not None and p in t)
    for block, few in ((8_000_000, 100_000), (20, 1)):
        monkeypatch.setattr(phrases, "BLOCK_CHARS", block)
        monkeypatch.setattr(phrases, "FEW_WORDS", few)
        got = phrases.containing(spark.createDataFrame(texts, "doc bigint, t string"), spark.createDataFrame(items, "item bigint, phrase string"))
        assert Counter(tuple(r) for r in got.select("doc", "item", "first").collect()) == want
    none = phrases.containing(spark.createDataFrame(texts, "doc bigint, t string"), spark.createDataFrame([], "item bigint, phrase string"))
    assert none.count() == 0
