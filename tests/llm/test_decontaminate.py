import hashlib
import re

import numpy as np
import pytest

from skeinlake.llm import decontaminate as d

from .helpers import docs, noise


def brute(rows, items, window=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    wins = [(i, {tuple(w[p : p + min(window, len(w))]) for p in range(len(w) - min(window, len(w)) + 1)} if (w := word.findall(low(t))) else set()) for i, t in items]
    out = []
    for i, t in rows:
        w = word.findall(low(t))
        hit, owners = set(), []
        for item, ws in wins:
            found = False
            for x in ws:
                for p in range(len(w) - len(x) + 1):
                    if tuple(w[p : p + len(x)]) == x:
                        hit.update(range(p, p + len(x)))
                        found = True
            if found and item is not None:
                owners.append(str(item))
        out.append((i, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)))
    return out


def key(rows):
    return sorted(rows, key=repr)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id bigint, text string, starts int")


def test_against_brute_force(spark):
    texts = noise(1, 60) + [None, "", "AB cd\tEF,gh é", "zz " * 300]
    texts += texts[:5]
    bench = [(k, t) for k, t in enumerate(noise(2, 12, size=25))] + [(20, None), (21, ""), (22, "AB, Cd!"), (23, "zz"), (24, "Zz")]
    rows = list(enumerate(texts)) + [(None, "ab cd ab cd zz")]
    got = d.contamination(docs(spark, rows), items(spark, bench)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert key(map(tuple, got)) == key(brute(rows, bench))


@pytest.mark.parametrize("size", [40, 200_000])
def test_blocks_of_items_give_the_same(spark, monkeypatch, size):
    bench = [(k, t) for k, t in enumerate(noise(3, 10, size=25))]
    bench += bench[:4] + [(7, "ab"), (7, "cd"), (None, "ef gh")]  # repeated items and ids, over blocks and in one
    rows = list(enumerate(noise(4, 30) + noise(4, 30))) + [(3, "ab"), (3, "ab"), (2**63 - 1, "ab"), (None, "ab")]
    monkeypatch.setattr(d, "BLOCK_WORDS", size)
    got = d.contamination(docs(spark, rows), items(spark, bench)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert key(map(tuple, got)) == key(brute(rows, bench))


def test_empty_tables(spark):
    assert d.contamination(docs(spark, []), items(spark, [(1, "ab")])).count() == 0
    got = d.contamination(docs(spark, ["ab"]), items(spark, [])).first()
    assert (got.n_words, got.n_hit, got.contaminated) == (1, 0, False)
    assert d.removed(docs(spark, ["ab"]), items(spark, [])).first().text == "ab"


def test_removed_cuts_the_passage_and_keeps_the_rest(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = ["Before it: " + passage.upper().replace(" ", ", ") + "! after.", "clean text", None, passage]
    got = d.removed(docs(spark, rows), items(spark, [(1, passage)])).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["Before it: ! after.", "clean text", None, ""]
    assert got[0].n_chars == len(got[0].text) and got[0].starts == "x" and got[0]["items"] == 7


def test_a_task_feeds_few_workers_however_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_WORDS", 5)
    bench = items(spark, [(k, f"v{k} w{k} x{k} y{k}") for k in range(11)])
    rows = docs(spark, ["a v3 w3 x3 y3 b v10 w10 x10 y10"])
    got = d.contamination(rows, bench)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= d.CHAINED + 1
    assert [(r.n_hit, r.n_items) for r in got.collect()] == [(8, 2)]


def test_removed_is_the_same_in_blocks(spark, monkeypatch):
    whole = [f"w{k}" for k in range(15)]
    bench = [(1, " ".join(whole[:10])), (2, " ".join(whole)), (3, " ".join(f"v{k}" for k in range(10)))]
    # without w0..w14, what stands before and after would be item 3, which the text never held
    rows = ["Before: " + " ".join(whole) + " after.", "v0 v1 v2 v3 v4 " + " ".join(whole) + " v5 v6 v7 v8 v9", None]
    once = [r.text for r in d.removed(docs(spark, rows), items(spark, bench)).orderBy("doc_id").collect()]
    monkeypatch.setattr(d, "BLOCK_WORDS", 5)
    blocks = [r.text for r in d.removed(docs(spark, rows), items(spark, bench)).orderBy("doc_id").collect()]
    assert blocks == once == ["Before:  after.", "v0 v1 v2 v3 v4  v5 v6 v7 v8 v9", None]


def test_equal_rows_keep_their_other_columns(spark):
    rows = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "y"), (1, None, "z")], "doc_id bigint, text string, starts string")
    got = d.removed(rows, items(spark, [(1, "b")])).collect()
    assert {tuple(r) for r in got} == {(1, "a  c", "x"), (1, "a  c", "y"), (1, None, "z")} and len(got) == 3


def test_fm_index_finds_every_occurrence():
    r = np.random.default_rng(5)
    for n in (1, 2, 30, 500):
        text = np.append(r.integers(0, 4, n), 0)
        index = d.FMIndex(text)
        patterns = r.integers(1, 6, (50, 4))
        lengths = r.integers(1, 5, 50)
        lo, hi = index.search(patterns, lengths)
        for p, m, a, b in zip(patterns, lengths, lo, hi, strict=True):
            want = [i for i in range(len(text) - m + 1) if (text[i : i + m] == p[:m]).all()]
            assert sorted(index.locate(np.arange(a, b))) == want
