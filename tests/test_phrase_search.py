"""Short phrases by grams of words, long ones by postings that are not gathered."""

import random
from collections import Counter

import pytest

from skeinlake.operators import phrases


def _found(spark, texts, items, **more):
    return phrases.containing(spark.createDataFrame(texts, "doc bigint, t string"), spark.createDataFrame(items, "item bigint, phrase string"), **more).select("doc", "item", "first")


def _want(texts, items):
    return Counter((k, i, t.startswith(p)) for k, t in texts for i, p in items if t is not None and p is not None and p in t)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few_words", [100_000, 1])
def test_many_short_phrases_equal_plain_search(spark, monkeypatch, few_words):
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abé𝄞\n ") for _ in range(rng.randint(0, n)))
    long = "".join(rng.choice("ab") for _ in range(70))
    texts = [(k, make(40)) for k in range(50)] + [(50, f"x {long} y{long}"), (51, ""), (52, " "), (None, "ab  ab"), (53, None), (0, "ab ab"), (0, "ab ab")]
    items = [(k, make(8)) for k in range(150)] + [(151, long), (152, long[3:40]), (153, f"{long[50:]} y"), (154, "a "), (155, " b"), (156, ""), (157, " "), (158, None), (159, "ab"), (159, "ab"), (160, "ab  ab")]
    monkeypatch.setattr(phrases, "FEW_WORDS", few_words)
    assert sum(p is not None and p.count(" ") < 2 for _, p in items) > 50
    assert Counter(tuple(r) for r in _found(spark, texts, items).collect()) == _want(texts, items)


def test_many_short_phrases_are_not_held_against_all_texts(spark):
    texts, items = [(k, f"large ring{k} brand#{k}") for k in range(200)], [(k, f"part:{k}") for k in range(200)] + [(k, f"ring{k} b") for k in range(200)]
    got = _found(spark, texts, items)
    assert not any("Join Inner, Contains" in line or "Join Cross" in line for line in _plan(got).splitlines())
    assert Counter(tuple(r) for r in got.collect()) == _want(texts, items)


def test_words_of_texts_are_not_gathered_for_long_phrases(spark, monkeypatch):
    rng = random.Random(8)
    words = "of the and alpha beta gamma delta".split()
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(k, make(60)) for k in range(40)] + [(k, make(60)) for k in range(2)] + [(99, "the the the the"), (98, None)]
    items = [(k, make(rng.randint(3, 6))) for k in range(40)] + [(50, "the the the"), (51, " of "), (52, "  "), (53, "no such words here")]

    def gathered(texts):
        raise AssertionError("all positions of all words were gathered")

    want = _want(texts, items)
    by_index = _found(spark, texts, items, index_=phrases.index(spark.createDataFrame(texts, "doc bigint, t string")))
    assert Counter(tuple(r) for r in by_index.collect()) == want
    monkeypatch.setattr(phrases, "index", gathered)
    assert Counter(tuple(r) for r in _found(spark, texts, items).collect()) == want
