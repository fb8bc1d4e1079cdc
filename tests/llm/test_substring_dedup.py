import hashlib

import numpy as np
import pytest

from skeinlake.llm import substring_dedup as d

from .helpers import docs, noise


def brute(rows, key, window):
    own = sorted({(2**63 if i is None else i, key[t or ""], t or "") for i, t in rows})
    seen, out = set(), {}
    for i, h, t in own:
        w = t.encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            if x in seen:
                gone.update(range(s, s + window))
            seen.add(x)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, t] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return sorted(((i, *out[2**63 if i is None else i, t or ""]) for i, t in rows), key=repr)


@pytest.mark.parametrize("window", [3, 20])
def test_against_brute_force(spark, monkeypatch, window):
    from pyspark.sql import functions as F

    monkeypatch.setattr(d, "BATCH_WORDS", 200)
    texts = noise(1, 25, ("a", "b"), 70) + noise(2, 25, tuple("abcdefgh"), 80) + [None, "", " \t\n", "a " * 400, "a b " * 100]
    texts += texts[:8] + [texts[0] + " " + texts[1], "x " + texts[30] + " y"]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[4]), (None, texts[5]), (None, "a " * 50), (2**63 - 1, texts[5]), (2**63 - 1, "p q " * 30)]
    table = docs(spark, rows).repartition(5)
    key = {r.t: r.h for r in table.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    got = d.deduplicated(table, window).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, key, window)


def test_symbols_depend_on_their_extent_only():
    r = np.random.default_rng(3)
    x = r.integers(0, 4, 400).astype(np.uint64)
    for rounds in (1, 2, 3):
        sym, lo, hi = d.symbols(x, np.zeros(400, np.int64), rounds)
        assert (np.diff(lo) >= 0).all() and (np.diff(hi) >= 0).all()
        part, plo, phi = d.symbols(x[100:300], np.zeros(200, np.int64), rounds)
        inside = (lo >= 100) & (hi < 300)
        known = (plo >= 0) & (phi < 200)
        assert sym[inside].tolist() == part[known].tolist()


def test_empty_table(spark):
    assert d.deduplicated(docs(spark, [])).count() == 0
