import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from skeinlake.llm import periodic_runs as pr

from .helpers import docs, noise


def _runs(w, least=12):
    """Every period, every stretch, by comparing words."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                out.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in out.items())


def _by_hand(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc).encode())
    n, g = len(w), h // 10
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = sorted(_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(kept)


def test_runs_of_many_documents_side_by_side():
    r = random.Random(3)
    for _ in range(1500):
        own = []
        for _ in range(r.randrange(1, 5)):
            n, letters = r.randrange(60), r.choice([1, 2, 3, 6])
            w = [r.randrange(letters) for _ in range(n)]
            if n and r.random() < 0.4:
                p = r.randrange(1, n + 1)
                w = (w[:p] * 60)[:n]
                if r.random() < 0.5:
                    w[r.randrange(n)] = 9
            own.append(w)
        least = r.choice([2, 12])
        sizes = np.array([len(w) for w in own])
        got = pr.find(np.array([x for w in own for x in w], np.int64), sizes, least)
        base = np.cumsum(sizes) - sizes
        want = [(s + b, n, q) for w, b in zip(own, base.tolist(), strict=True) for s, n, q in sorted(_runs(w, least), key=lambda x: (x[0], x[2]))]
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_query_by_hand(spark, tmp_path):
    texts = ["", None, "a", "x y " * 5, "x y " * 6, "a " * 12, "a " * 2_000, " ".join(map(str, range(3000))), "p q r " * 40 + "s " + "p q r " * 40, "é ü ß " * 9, "same words", "same words"]
    rows = [*enumerate(texts), *((100 + k, t) for k, t in enumerate(noise(5, 60))), *((200 + k, " ".join(f"w{j % (50 + k)}" for j in range(400))) for k in range(40)), (None, "n o " * 30), (3, "x y " * 7), (3, "x y " * 7), (2**63 - 1, "b " * 30)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = pr.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = [(i, *_by_hand(i, t)) for i, t in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_batches_do_not_matter_and_texts_come_back(spark):
    d = docs(spark, [*noise(8, 30, size=200), "k l m n " * 10])
    assert [x.tolist() for x in pr.find(np.zeros(20_000, np.int64), np.array([20_000]))] == [[0], [20_000], [1]]
    one, many = (sorted((r.doc_id, str(r.runs), r.collapsed) for r in pr.periodic(d, batch_words=n).collect()) for n in (1, 10**9))
    assert one == many and one[-1][2] == "k l m n"
    assert pr.periodic(docs(spark, [])).count() == 0 and pr.periodic(docs(spark, [None])).select(F.size("runs")).first()[0] == 0
