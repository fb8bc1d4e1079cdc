import hashlib
import random

from skeinlake.llm import line_dedup as d

from .helpers import docs, noise


def bounds(rows):
    """By strings alone, without any alignment: the lines of each document, places that must go, and places that may."""
    own = sorted({(2**63 if i is None else i, t) for i, t in rows if t}, key=lambda x: (x[0], KEY[x[1]]))
    seen, texts, out = set(), set(), {}
    for i, t in own:
        lines = t.split("\n")
        may = {k for k, x in enumerate(lines) if x in seen}
        must = {k for k in may if len(lines[k].split()) >= d.MIN_WORDS}
        if t in texts and (len(lines) > 1 or must):
            must = may
        out[i, t] = (lines, must, may)
        seen.update(lines)
        texts.add(t)
    return out


KEY = {}


def test_against_brute_force(spark):
    lines = [" ".join(w) for w in (x.split()[:7] for x in noise(1, 40)) if w]
    rows = [(k, "\n".join(lines[j % len(lines)] for j in x)) for k, x in enumerate(([1, 2, 3], [1, 2, 3], [4, 2, 3, 5], [3, 2, 1], [6], [7, 7, 8, 1], [9, 10, 4, 2, 3, 5, 11], [], [12, 1, 13, 2, 14, 3]))]
    rows += [(100, None), (101, ""), (None, rows[2][1]), (5, rows[0][1]), (5, rows[0][1]), (103, "one line of five words"), (104, "one line of five words"), (105, "short"), (106, "short")]
    table = docs(spark, rows)
    from pyspark.sql import functions as F

    KEY.update({r.text: r.h for r in table.select("text", F.xxhash64("text").alias("h")).collect()})
    want = bounds(rows)
    got = sorted((tuple(r) for r in d.deduplicated(table).collect()), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    left = list(got)
    for i, t in rows:
        lines, must, may = want.get((2**63 if i is None else i, t), ([], set(), set()))
        fit = [x for x in left if x[0] == i and x[1] == len(lines) and len(must) <= x[2] <= len(may)]
        kept = "\n".join(x for k, x in enumerate(lines) if k not in must)
        fit = [x for x in fit if x[2] > len(must) or x[3] == sha(kept if kept.strip() else "")]
        assert fit, (i, t)
        left.remove(fit[0])
    assert not left and got.count(got[0]) == 1
    kept = {r.doc_id: r for r in d.without_copied_lines(table).collect()}
    assert 1 not in kept and 104 not in kept and kept[100].text is None and kept[106].text == "short" and kept[0]["items"] == 7
    assert d.deduplicated(docs(spark, [])).count() == 0


def test_patience_keeps_order_and_grows():
    a, b = list("abXcdYe"), list("QbXcZdYe")
    hit = d.patience(a, b, {"X", "Y"}, {"X", "Y"})
    assert sorted(hit) == [1, 2, 3, 5, 6, 7]
    assert d.patience(list("XY"), list("YX"), {"X", "Y"}, {"X", "Y"}) in ([0], [1])


def _longest(a, b):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_repeated_lines_align(monkeypatch):
    r = random.Random(1)
    for bits in (d.BITS, 20):
        monkeypatch.setattr(d, "BITS", bits)
        for _ in range(300):
            a, b = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in range(2))
            pairs = d.subsequence(a, b)
            assert len(pairs) == _longest(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
            # every line twice: no anchor is unique, so the whole alignment is the common subsequence
            a, b = a + a, b + b
            hit = d.patience(a, b, set(a), set(b))
            assert len(hit) == len(set(hit)) == _longest(a, b) == _longest(a, [b[k] for k in sorted(hit)])
    assert sorted(d.patience(list("XaX"), list("bXcXd"), {"X"}, {"X"})) == [1, 3]


def test_short_lines_lead_to_pairs(spark):
    verse = "roses red\nviolets blue\n\nsugar sweet\nso you"
    rows = [verse, verse, "own head\n" + verse + "\nown tail", "one\n", "one\n", "so you\nroses red", "so you"]
    rows += ["x\ny\nx\ny", "z\nx\ny\nq\nx\ny"]
    got = {r.doc_id: (r.n_deleted, r.kept_sha256) for r in d.deduplicated(docs(spark, rows)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = {1: (5, ""), 2: (5, "own head\nown tail"), 4: (2, ""), 8: (4, "z\nq")}
    assert got == {k: (n, sha(t)) for k, (n, t) in ({k: (0, t) for k, t in enumerate(rows)} | kept).items()}


def test_every_rare_line_of_an_earlier_document_goes(spark):
    r = random.Random(9)
    pool = [" ".join(r.choice("abcdefgh") * 3 for _ in range(5)) + f" {k}" for k in range(25)] + ["short", "", "two words", "-"]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 14)))) for k in range(60)]
    rows += [(100 + k, "\n".join(reversed(pool[:25]))) for k in range(2)] + [(103, "\n".join(f"line {k} of a very long list" for k in range(3000)))]
    rows += [(104, "\n".join(f"line {k} of a very long list" for k in range(2999, -1, -1)))]
    table = docs(spark, rows)
    from pyspark.sql import functions as F

    KEY.update({x.text: x.h for x in table.select("text", F.xxhash64("text").alias("h")).collect()})
    kept = {x.doc_id: (x.n_lines, x.n_deleted, x.text) for x in d._shortened(table, ["doc_id"]).selectExpr("row.doc_id", "n_lines", "n_deleted", "kept as text").collect()}
    for (i, _), (lines, must, may) in bounds(rows).items():
        n, gone, text = kept[i]
        left = text.split("\n") if gone < n else []
        assert n == len(lines) and len(must) <= gone <= len(may)
        rest = [x for k, x in enumerate(lines) if k not in must]
        assert all(x in rest for x in left if x.strip()) and not any(lines[k] in left for k in must)
    assert kept[104][1] == 3000


def test_other_orders_and_copies_of_short_lines(spark):
    x, y, z = ("the first long line is x", "the second long line is y", "a third long line is z")
    rows = [f"{x}\n{y}", f"{y}\n{x}", f"{y}\n{x}\n{z}", *["one two three four\nfive six seven eight\n" * 50] * 3]
    got = {r.doc_id: (r.n_deleted, r.n_lines) for r in d.deduplicated(docs(spark, rows)).collect()}
    assert got == {0: (0, 2), 1: (2, 2), 2: (2, 3), 3: (0, 101), 4: (101, 101), 5: (101, 101)}


def test_hot_lines_and_documents_are_split_alike(spark, monkeypatch):
    r = random.Random(3)
    head = "a license line that all of them hold"
    rows = ["\n".join([head, *(f"own line number {r.randrange(30)} of this text" for _ in range(4))]) for _ in range(80)]
    want = sorted(tuple(x) for x in d.deduplicated(docs(spark, rows)).collect())
    monkeypatch.setattr(d, "SALT", 7)
    monkeypatch.setattr(d, "LEAST_HOT", 5)
    assert sorted(tuple(x) for x in d.deduplicated(docs(spark, rows)).collect()) == want
