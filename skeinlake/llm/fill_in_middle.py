"""Fill-in-middle transformation in constant memory beside the text.

A text is a row of units, runs of letters A-Z and a-z or single other code points.
Two passes of a lazy matcher go over it: the first counts the units, the second
advances one match iterator to the two ranks at which the text is cut and reads the
code points there. No array of units is ever stored. Where the text is cut, and into
which form, follows from a hash of the document's id.

Forms: ``plain`` is the text; ``psm`` is prefix, suffix, middle, and ``spm`` suffix,
prefix, middle, each piece behind its mark. A mark begins with a character that occurs
in no other place of any mark, so no mark can arise across the edge of a piece, and
``restored`` takes a text back from its form without knowing where it was cut.

Defined results: a null text is an empty one, and empty texts are plain; texts that
hold a mark are plain; a null doc_id counts as an id of no digits; repeated rows give
repeated rows; an empty table gives none; other columns are left behind.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents, those from this one on stay plain; of a hundred others, those below this one are spm.
PLAIN_FROM, SPM_BELOW = 90, 20

SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def n_units(text: str) -> int:
    """The first pass: how many units a text has."""
    n = count()
    deque(zip(UNIT.finditer(text), n), maxlen=0)
    return next(n)


def places(text: str, low: int, high: int) -> tuple[int, int]:
    """The second pass: code points before the units of ranks ``low`` and ``high`` (low <= high), by one iterator."""
    units: Iterator[re.Match] = UNIT.finditer(text)
    a = next(islice(units, low - 1, low)).end() if low else 0
    b = next(islice(units, high - low - 1, high - low)).end() if high > low else a
    return a, b


def transformed(docs: DataFrame, seed: int = 1, marks: tuple[str, str, str] = MARKS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n (units), form, prefix_chars and middle_chars (null if plain) and output, a row per row of ``docs``."""
    pairs = [(x, y, j == k) for j, x in enumerate(marks) for k, y in enumerate(marks)]
    if not all(marks) or any(x[0] in y[1:] or not same and y.startswith(x) for x, y, same in pairs):
        raise ValueError(f"the marks have to differ, and begin with a character that stands nowhere else in them: {marks!r}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    part = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(part(k).alias(f"h{k + 1}") for k in range(4)))
    p, s, m = marks

    def run(it):
        for b in slices(it):
            out: dict[str, list] = {x.split()[0]: [] for x in SCHEMA.split(", ")}
            for doc, text, h1, h2, h3, h4 in zip(*(x.to_pylist() for x in b.columns), strict=True):
                n = n_units(text)
                form, a, mid, whole = "plain", None, None, text
                if n and h3 % 100 < plain_from and p not in text and s not in text and m not in text:
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, z = places(text, low, high)
                    mid = z - a
                    form = "spm" if h4 % 100 < spm_below else "psm"
                    whole = f"{s}{text[z:]}{p}{text[:a]}{m}{text[a:z]}" if form == "spm" else f"{p}{text[:a]}{s}{text[z:]}{m}{text[a:z]}"
                for name, x in zip(out, (doc, n, form, a, mid, whole), strict=True):
                    out[name].append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return rows.mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text, from its output and form alone."""
    p, s, m = (F.lit(x) for x in marks)
    piece = lambda x, mark, k: F.split_part(x, mark, F.lit(k))
    bare = lambda x, mark: F.substr(x, F.length(mark) + 1)
    back = piece(output, s, 2)
    psm = F.concat(bare(piece(output, s, 1), p), piece(back, m, 2), piece(back, m, 1))
    back = piece(output, p, 2)
    spm = F.concat(piece(back, m, 1), piece(back, m, 2), bare(piece(output, p, 1), s))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda x: F.sha2(x, 256)
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
    CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS z,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:z], '') AS mid, array_to_string(w[z + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
