import hashlib
import re

import pytest
from pyspark.sql import functions as F

from skeinlake.llm import fill_in_middle as fim

from .helpers import docs


def _plain(doc, text):
    """The contract, with all units in a list."""
    text = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(w)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(w[:a]), "".join(w[a:z]), "".join(w[z:])
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = ["", None, "a", "one two", "<P>", "x <S> y", "a<M", "P>a", "<", "<<<PS>>>", "\n\t é𝄞 ß\x00z", "word " * 20_000, "a" * 300_000, "?" * 50_000, "same text", "same text"]


def test_as_by_hand_and_back(spark):
    rows = [(k, t) for k in range(40) for t in TEXTS if len(t or "") < 100] + [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(None, "no id at all"), (7, "twice"), (7, "twice"), (2**63 - 1, "the last id"), (-5, "below nothing")]
    t = fim.transformed(docs(spark, rows))
    got = t.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((str(r.doc_id), (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) for r in got) == sorted((str(i), _plain(i, x), x or "") for i, x in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_marks_and_empty_tables(spark):
    rows = [(k, "some text [with] marks <P> of others") for k in range(30)]
    t = fim.transformed(docs(spark, rows), seed=2, marks=("#pre", "#suf", "#mid"), plain_from=100, spm_below=50)
    got = t.withColumn("back", fim.restored(F.col("output"), F.col("form"), ("#pre", "#suf", "#mid"))).collect()
    assert {r.back for r in got} == {rows[0][1]} and {r.form for r in got} == {"psm", "spm"}
    assert fim.transformed(docs(spark, [])).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("<<", "a", "b"), ("ab", "ba", "c"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.transformed(docs(spark, rows), marks=marks)
