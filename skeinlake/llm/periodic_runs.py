"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

The words of many documents are worked on side by side, none across documents.

* ``Tree`` holds what the method takes from a suffix tree: names of all word strings of
  2^k words (equal in one document if and only if the strings are), the suffix array
  that they lead to, and from both longest common extensions in either direction. A
  place in the tree is a first word and a length; its suffix link is the next word.
* LZ blocks: the text is cut greedily into longest factors that begin earlier too.
* Leftmost squares: for every block, squares whose centre lies in it are found at its
  two ends by extensions, a constant number of them for each period up to the lengths of
  two blocks. They cover the leftmost occurrence of every square.
* Vocabulary: from each, walks along suffix links while the next word repeats; places
  already marked are not marked twice. Squares of squares are left out.
* Occurrences: each square's interval of the suffix array has all of them; stretches of
  neighbouring starts with one period are runs.

Work is linear in the words for documents without repeats, and grows with occurrences
of primitive squares otherwise (n log n at most). Memory is about 100 bytes a word, and
four bytes more for each doubling of the longest repeat, for ``BATCH_WORDS`` words or one
document.

Defined results: null texts are empty and have no words; a null doc_id is never changed by
``planted``; repeated rows give repeated rows; an empty table gives none; other columns are
left behind.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, task

#: Least words of a run, and least periods.
LEAST, TIMES = 12, 2
#: Words that are worked on at once, about (a document is never split).
BATCH_WORDS = 200_000

SCHEMA = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): first, first + 1, ... , ``many`` of them, for each."""
    which = np.repeat(np.arange(len(many)), many)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + first[which]


class Tree:
    """Names of strings of 2^k words, suffix array, extensions. ``words``: numbers of words, document after document."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        n = self.n = len(words)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        key = doc * (int(words.max()) + 1) + words
        suffixes = np.argsort(key, kind="stable")
        key = key[suffixes]
        names, slots = [], np.arange(n)
        name = np.full(n + 1, -1)  # behind the last word there is no name
        while len(slots):  # slots of the suffix array whose strings are not yet told apart
            new = np.concatenate([[True], key[1:] != key[:-1]])
            name = name.copy()
            name[suffixes[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            slots = slots[~(new & np.concatenate([new[1:], [True]]))]
            if not len(slots):
                break
            names.append(name)
            own = suffixes[slots]
            key = name[own] * (n + 1) + name[own + (1 << len(names) - 1)] + 1
            order = np.argsort(key)
            suffixes[slots], key = own[order], key[order]
        self.suffixes, self.depth = suffixes, len(names)
        self.names = np.array([*names, name])  # the last ones are names of suffixes

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes from i and from j have in common."""
        size = np.zeros(len(i), np.int64)
        for k in reversed(range(self.depth)):
            size += (self.names[k, i + size] == self.names[k, j + size]).astype(np.int64) << k
        return size

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common that end with i and with j (i < j)."""
        size = np.zeros(len(i), np.int64)
        for k in reversed(range(self.depth)):
            a, b = i - size - (1 << k) + 1, j - size - (1 << k) + 1
            size += ((a >= 0) & (self.names[k, np.maximum(a, 0)] == self.names[k, np.maximum(b, 0)])).astype(np.int64) << k
        return size

    def place(self, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two names that tell strings of one size apart."""
        k = np.minimum(np.frexp(size.astype(np.float64))[1] - 1, self.depth)
        return self.names[k, i], self.names[k, np.where(k < self.depth, i + size - (1 << k), i)]

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from i and from j are the same (i <> j, size > 0)."""
        (a, b), (c, d) = self.place(i, size), self.place(j, size)
        return (a == c) & (b == d)


def blocks(tree: Tree, ends: np.ndarray) -> np.ndarray:
    """First words of the LZ blocks of all documents: each block is the longest string that begins earlier in its document too, or a new word."""
    n, step = tree.n, np.ones(tree.n, np.int64)
    if tree.depth > 1:  # else no two words in a row come twice, and all blocks are single words
        two = tree.names[1, tree.suffixes]
        again = np.concatenate([[False], two[1:] == two[:-1]])
        again |= np.concatenate([again[1:], [False]])
        own, group = tree.suffixes[again], two[again].tolist()
        low, high, stack, last = [-1] * len(own), [-1] * len(own), [], None
        for r, (p, g) in enumerate(zip(own.tolist(), group, strict=True)):  # nearest earlier suffixes on both sides
            if g != last:
                stack, last = [], g
            while stack and stack[-1][0] > p:
                high[stack.pop()[1]] = p
            if stack:
                low[r] = stack[-1][0]
            stack.append((p, r))
        for side in (low, high):
            side = np.array(side)
            at = np.flatnonzero(side >= 0)
            step[own[at]] = np.maximum(step[own[at]], tree.forward(side[at], own[at]))
    first, hop, i = [], step.tolist(), 0
    for end in ends.tolist():
        while i < end:
            first.append(i)
            i += hop[i]
        i = end
    return np.array(first, np.int64)


def leftmost_squares(tree: Tree, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, period) of squares that cover the leftmost occurrence of each."""
    ends = np.cumsum(sizes)
    h = blocks(tree, ends)
    doc = np.searchsorted(ends, h, "right")
    begin, end = (ends - sizes)[doc], ends[doc]
    h1 = np.minimum(np.append(h[1:], tree.n), end)
    h2 = np.where(h1 < end, np.append(h1[1:], tree.n), h1)
    word = tree.names[0]
    # squares over the end of a block
    at, q = spread(np.where(h1 < end, h, 0), np.where(h1 < end, h1 - h, 0))
    hit = word[h1[at]] == word[q]
    at, q = h1[at[hit]], q[hit]
    k, right, left = at - q, tree.forward(q, at), tree.backward(q - 1, at - 1)
    fine = left + right >= k
    start, period = [np.maximum(q - left, q - k + 1)[fine]], [k[fine]]
    # squares over its beginning
    at, q = spread(h + 1, np.where(h > begin, np.maximum(np.minimum(h2, end - 1) - h, 0), 0))
    at = h[at]
    hit = word[at - 1] == word[q - 1] if len(at) else np.zeros(0, bool)
    at, q = at[hit], q[hit]
    k, left, right = q - at, tree.backward(at - 1, q - 1), tree.forward(at, q)
    fine = left + right >= k
    start.append(np.maximum(at - left, at - k + 1)[fine])
    period.append(k[fine])
    both = np.unique(np.stack([np.concatenate(start), np.concatenate(period)]), axis=1)
    return both[0], both[1]


def primitive(tree: Tree, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether a square's half is no power of a shorter string: no period that a prime divides is one of the half."""
    fine, rest = np.ones(len(start), bool), period.copy()
    top = int(period.max(initial=1))
    least = np.arange(top + 1)  # least prime factors
    for p in range(2, int(top**0.5) + 1):
        if least[p] == p:
            multiples = least[p * p :: p]
            multiples[multiples == np.arange(p * p, top + 1, p)] = p
    while (rest > 1).any():
        at = np.flatnonzero(rest > 1)
        p = least[rest[at]]
        d = period[at] // p
        fine[at] &= ~tree.same(start[at], start[at] + d, period[at] - d)
        rest[at] //= p
    return fine


def occurrences(tree: Tree, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, period) of all occurrences of the given squares: their intervals of the suffix array."""
    two = tree.names[min(1, tree.depth), tree.suffixes]
    near = np.concatenate([[False], two[1:] == two[:-1]])
    common = np.zeros(tree.n + 1, np.int64)  # of a suffix and the one before
    at = np.flatnonzero(near)
    common[at] = tree.forward(tree.suffixes[at - 1], tree.suffixes[at])
    slot = tree.names[-1, start]
    low, high, size = slot.copy(), slot + 1, 2 * period
    least = [common]  # of 2^k neighbours
    while len(least[-1]) > (1 << len(least) - 1) and (least[-1] >= 2).any():
        x = least[-1]
        least.append(np.minimum(x[: len(x) - (1 << len(least) - 1)], x[1 << len(least) - 1 :]))
    for k in reversed(range(len(least))):
        x, hop = least[k], 1 << k
        a = low - hop + 1  # all of common[a .. low] are long enough: the interval begins before
        low -= np.where((a >= 0) & (x[np.clip(a, 0, len(x) - 1)] >= size), hop, 0)
        high += np.where((high < len(x)) & (x[np.minimum(high, len(x) - 1)] >= size), hop, 0)
    which, r = spread(low, high - low)
    return tree.suffixes[r], period[which]


def find(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of all runs of ``least`` words and two periods or more, by first word, then period."""
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    tree = Tree(words, sizes)
    start, period = leftmost_squares(tree, sizes)
    if not len(start):
        return none, none, none
    fine = primitive(tree, start, period)
    start, period = start[fine], period[fine]
    which, at = spread(start, tree.forward(start, start + period) - period + 1)  # along the suffix links
    period = period[which]
    a, b = tree.place(at, 2 * period)
    order = np.lexsort((b, a, period))
    a, b, at, period = (x[order] for x in (a, b, at, period))
    marked = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (period[1:] == period[:-1])])
    start, period = occurrences(tree, at[~marked], period[~marked])
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    new = np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(start)) - 1
    length = start[b] - start[a] + 2 * period[a]
    start, period = start[a], period[a]
    fine = np.flatnonzero(length >= np.maximum(least, TIMES * period))
    fine = fine[np.lexsort((period[fine], start[fine]))]
    return start[fine], length[fine], period[fine]


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """One document of ten, by its id, is made periodic from some word on."""
    h = zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if doc is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _batches(rows, limit: int):
    own, total = [], 0
    for doc, words in rows:
        own.append((doc, words))
        total += len(words)
        if total >= limit:
            yield own
            own, total = [], 0
    if own:
        yield own


def periodic(docs: DataFrame, change=None, least: int = LEAST, batch_words: int = BATCH_WORDS) -> DataFrame:
    """doc_id, runs (start, length, period by start, then period) and the text without what repeats a run's first period, a row per row.

    ``change`` gets doc_id and words and gives the words to look at.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def texts(it):
        for b in slices(it):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = text.split()  # white space of bytes is that of ASCII
                yield doc, words if change is None else change(doc, words)

    def run(it):
        for own in _batches(texts(it), batch_words):
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            sizes = np.array([len(w) for _, w in own])
            words = np.fromiter((number[x] for _, w in own for x in w), np.int64, int(sizes.sum()))
            ends = np.cumsum(sizes)
            start, length, period = find(words, sizes, least)
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, start + period, 1)
            np.add.at(depth, start + length, -1)
            kept = (np.cumsum(depth)[:-1] == 0).tolist()
            bounds = np.searchsorted(start, np.append(0, ends))
            first = np.repeat(ends - sizes, np.diff(bounds))
            cells = pa.StructArray.from_arrays([pa.array(start - first), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            collapsed = []
            for k, (_, w) in enumerate(own):
                end = int(ends[k])
                collapsed.append(b" ".join(w if bounds[k] == bounds[k + 1] else compress(w, kept[end - len(w) : end])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in own], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), cells), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"]
            )

    return rows.mapInArrow(task(run), SCHEMA)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = periodic(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return t.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
c AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
v AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN w[1:a] || list_transform(range(a, n), lambda i: w[1 + a + (i - a) % p]) ELSE w END AS w FROM c),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM v),
e AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND l.i < r.i),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island HAVING count(*) >= q AND count(*) + q >= 12),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
o AS (SELECT doc_id, count(*) AS n_runs, max({'length': length, 'start': -start, 'period': -period}) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
z AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM r) GROUP BY doc_id)
SELECT v.doc_id, coalesce(n_runs, 0) AS n_runs, -best.start AS start, best.length AS length, -best.period AS period, 1000 * best.length // -best.period AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda y, i: NOT list_contains(gone, i - 1)) END, ' '), '')) AS collapsed_sha256
FROM v LEFT JOIN o USING (doc_id) LEFT JOIN z USING (doc_id)"""
