import hashlib
import random

import numpy as np
import pytest

from skeinlake.llm import suffix_dedup as sd

from .helpers import docs


def _by_hand(rows, width=50):
    """Every window of every document, and the least id that has it."""
    none = 2**64
    texts = [(none if i is None else i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, int] = {}
    for i, t in texts:
        for k in range(len(t) - width + 1):
            w = t[k : k + width]
            least[w] = min(least.get(w, none), i)
    out = []
    for (i, _), (own, t) in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if least[t[k : k + width]] < own:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(map(str, out))


def _corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé\n ") for _ in range(r.randrange(1, 9)))
    passages = ["".join(word() for _ in range(30)) for _ in range(6)] + ["a" * 130, "xy" * 60, "\x00" * 70, "p" * 49, "q" * 50]
    rows = []
    for k in range(n):
        parts = [r.choice(passages)[r.randrange(20) :][: r.randrange(30, 140)] if r.random() < 0.6 else "".join(word() for _ in range(20)) for _ in range(r.randrange(1, 7))]
        rows.append((r.choice([k, k, k, 3, None, 2**63 - 1, -k]), "".join(parts)))
    return [*rows, (50, None), (51, ""), (52, "short"), rows[0], rows[1]]


def _got(df):
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))) for r in df.collect())


@pytest.mark.parametrize("seed, lot_bytes, run_items, parts, hot", [(1, 2_000_000, 400_000, None, 2_000), (2, 600, 50, 3, 2_000), (3, 1, 1, 5, 1), (4, 5_000, 30, 2, 3)])
def test_as_by_hand(spark, monkeypatch, seed, lot_bytes, run_items, parts, hot):
    rows = _corpus(seed)
    monkeypatch.setattr(sd, "HOT", hot)
    assert _got(sd.deduplicated(docs(spark, rows), lot_bytes, run_items, parts)) == _by_hand(rows)


def test_a_long_text_and_no_rows(spark, monkeypatch):
    r = random.Random(7)
    long = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    rows = [(5, long), (6, long[7_000:9_000]), (2, "z" * 80 + long[100:180]), (9, long[:50] + "!" + long[-50:])]
    monkeypatch.setattr(sd, "CHUNK", 1_000)
    assert _got(sd.deduplicated(docs(spark, rows))) == _by_hand(rows)
    assert sd.deduplicated(docs(spark, [])).count() == 0 and sd.deduplicated(docs(spark, [None, ""])).select("n_bytes", "n_removed").distinct().collect() == [(0, 0)]


def test_prefixes_are_never_compared_twice():
    """The merge looks at bytes behind the known prefixes only: at most one more for each comparison than what it learns."""

    class Text(bytes):
        looked = 0

        def __getitem__(self, k):
            if isinstance(k, int):
                Text.looked += 1
            return bytes.__getitem__(self, k)

    class Piece:
        def __init__(self, texts):
            self.texts, self.item, self.text = texts, -1, None

        def advance(self):
            self.item += 1
            if self.item == len(self.texts):
                return -1
            before, self.text = self.text or b"", Text(self.texts[self.item])
            same = [a == b for a, b in zip(bytes(before), bytes(self.text), strict=False)]
            return same.index(False) if False in same else len(same)

    r = random.Random(5)
    texts = [b"common prefix of all of them " * 3 + bytes(r.choice(b"abc") for _ in range(30)) for _ in range(900)]
    pieces = [Piece(sorted({*texts[k::9]})) for k in range(9)]
    total = sum(len(p.texts) for p in pieces)
    out = [(shared, bytes(p.text)) for shared, p in sd.merged(pieces)]
    assert [t for _, t in out] == sorted(t for p in pieces for t in p.texts)
    for (_, a), (shared, b) in zip(out, out[1:], strict=False):
        same = [x == y for x, y in zip(a, b, strict=True)]
        assert shared == (same.index(False) if False in same else len(b))
    assert Text.looked < total * (4 * np.log2(9) + 30)  # the common prefix alone has 87 bytes
