import random

import numpy as np
import pytest

from skeinlake.llm import jaccard_join as j

from .helpers import docs, noise


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [3, 2000])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(j, "BLOCK", block)
    monkeypatch.setattr(j, "LEAST_HOT", 3)
    monkeypatch.setattr(j, "SALT", 2)
    monkeypatch.setattr(j, "BATCH_SHINGLES", 150)
    r = random.Random(4)
    base = [t.split() for t in noise(1, 6, tuple("abcdefghijklmnop"), 90)]
    texts = [None, "", "a b", "A B", "a b c d e", "one two", "a b c d f"]
    for _ in range(60):  # chains of near copies around the threshold
        w = list(r.choice(base))
        for _ in range(r.randrange(6)):
            if w:
                w[r.randrange(len(w))] = r.choice("qrst")
        texts.append(" ".join(w))
    texts += [texts[-1]] * 5 + [" ".join(f"w{k % 3001}" for k in range(9000))] * 2  # exact copies, a very long text
    rows = list(enumerate(texts)) + [(200, texts[20]), (200, texts[21]), (200, texts[21]), (201, "tie one two three four five"), (201, texts[30]), (202, "tie one two three four five")]
    got = j.linked(docs(spark, rows).repartition(3))
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert got.count() == len(rows)
    kept = {r.doc_id for r in j.one_of_each(docs(spark, rows)).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_rows_without_id_and_empty_tables(spark):
    rows = [(None, "p q r s t u"), (None, "p q r s t u"), (5, "p q r s t u"), (None, "other words here"), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.linked(docs(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 2, 5), (None, 2, 5), (5, 2, 5), (None, 1, None), (None, 0, None)], key=repr)
    assert j.linked(docs(spark, [])).count() == 0


def test_ids_of_all_sizes(spark):
    last = 2**63 - 1
    rows = [(8 * 10**18, "a b c d e f"), (8 * 10**18 + 1, "a b c d e f"), (last, "p q r s t u"), (None, "p q r s t u"), (None, "v w"), (-(2**63), ""), (last - 1, None)]
    got = sorted(((r.doc_id, r.component_id) for r in j.linked(docs(spark, rows)).collect()), key=repr)
    assert got == sorted([(8 * 10**18, 8 * 10**18), (8 * 10**18 + 1, 8 * 10**18), (last, last), (None, last), (None, None), (-(2**63), -(2**63)), (last - 1, last - 1)], key=repr)
    assert {(r.doc_id, r.text) for r in j.one_of_each(docs(spark, rows)).collect()} == {(8 * 10**18, "a b c d e f"), (last, "p q r s t u"), (None, "v w"), (-(2**63), ""), (last - 1, None)}


def test_prefix_size_is_enough():
    for n in range(1, 200):
        for m in range(-(-75 * n // 100), n + 1):
            least = -(-75 * (n + m) // 175)
            assert j.prefix_size(n) >= n - least + 1 and j.prefix_size(m) >= m - least + 1
    assert np.all([1 <= j.prefix_size(n) <= n for n in range(1, 50)])


def test_parity_bits_never_exceed_the_difference():
    r = np.random.default_rng(3)
    for n in (3, 40, 300, 700):
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for drop in (0, 1, n // 5, n // 2):
            y = np.unique(np.concatenate([x[drop:], r.integers(0, 2**63, drop // 2).astype(np.uint64)]))
            a, b = j.parity(x), j.parity(y)
            k = min(len(a), len(b))
            apart = int(np.bitwise_count(j.folded(a, k) ^ j.folded(b, k)).sum())
            both = len(np.intersect1d(x, y))
            assert apart <= len(x) + len(y) - 2 * both
            assert not j.similar(len(x), len(y), both) or len(x) + len(y) - 2 * both <= j.most_apart(len(x), len(y))


def test_forest_joins_what_is_likely():
    r = np.random.default_rng(4)
    base = np.unique(r.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.delete(base, r.integers(0, len(base), 3)) for _ in range(30)] + [np.unique(r.integers(0, 2**63, 190).astype(np.uint64)) for _ in range(5)]
    n, k = np.array([len(s) for s in sets]), np.arange(len(sets))
    group = j.Group(k, n, k, k % 2, [j.parity(s, 1 + 7 * (i % 2)).tobytes() for i, s in enumerate(sets)])
    (every, whole), (few, less) = group.pairs(False, False), group.pairs(True, False)
    assert every.shape[1] == 30 * 29 // 2 and few.shape[1] == 29 and few.max() < 30 and less and not whole
    assert group.pairs(False, True)[0].shape[1] == 15 * 15
    two = j.Group(k[:2], n[:2], k[:2], k[:2], [j.parity(s).tobytes() for s in sets[:2]]).pairs(True, False)
    assert two[0].tolist() == [[0], [1]] and not two[1]


def test_shingles_of_the_same_classes_are_one(spark):
    held = {1: (10, 11, 12), 2: (10, 11, 12), 3: (10, 11), 4: (11, 12, 10), 5: (13,), 6: (13, 14)}
    lists = spark.createDataFrame([(k, c, 100) for k, cs in held.items() for c in cs], "key bigint, c bigint, n int")
    got = {}
    for r in j.one_for_each_set(lists).collect():
        got.setdefault(r.key, set()).add(r.c)
    assert got == {1: {10, 11, 12}, 3: {10, 11}, 6: {13, 14}}


def test_a_forest_names_the_classes_of_likely_pairs_only(spark):
    """Three sets that are alike and many that share nothing with them at one shingle: the last round gets the three."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    sets = [np.unique(np.concatenate([base[:360], rng.integers(0, 1 << 63, 40, np.uint64)])) for _ in range(3)] + [np.unique(rng.integers(0, 1 << 63, 400, np.uint64)) for _ in range(20)]
    lists = spark.createDataFrame([(7, c, len(s)) for c, s in enumerate(sets)], "key bigint, c bigint, n int")
    bits = spark.createDataFrame([(c, bytearray(j.parity(s).tobytes())) for c, s in enumerate(sets)], "c bigint, bits binary")
    made = j.between(lists, spark.createDataFrame([], "node bigint, root bigint"), bits, True).collect()
    assert {(r.a, r.key) for r in made if r.b is None} == {(0, 7), (1, 7), (2, 7)}
    assert {x for r in made if r.b is not None for x in (r.a, r.b)} == {0, 1, 2}
