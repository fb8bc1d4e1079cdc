"""Benchmark decontamination with an FM-index per training shard.

Each Arrow batch of documents is a shard. Its words are coded over the
vocabulary of the test phrases; a run of phrase words between other words is
kept if the shortest window can fit in it (no occurrence of a window can hold
any other word, so nothing is lost), and the kept runs are the text of the
shard's FM-index: suffix array by prefix doubling, Burrows-Wheeler transform,
a wavelet matrix for ranks and sampled suffix positions. All windows of all
phrases are searched backwards at once; the rows found are located by walking
back to the next sampled position. Spans are merged per document.

Phrases are taken in blocks of at most ``BLOCK_WORDS`` words, so what is
broadcast is bounded by that and does not grow with the benchmark; every block
is one more pass over the documents.

Defined results: null texts have no words; an item without words has no
window; repeated items count one by one (and the digest repeats an item_id
that is repeated); a null item_id is left out of ``items`` but its words are
hit; rows with a null doc_id are treated like any other; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, plain_names, slices, staged, task, texts

WINDOW = 10
#: Words of the phrases that one pass searches for at most (bound of the broadcast: about 100 bytes a word).
BLOCK_WORDS = 200_000
#: Blocks that are searched one after another before the rows are written.
CHAINED = 4
#: Words of a shard's FM-index at most.
SHARD_WORDS = 1_000_000
SAMPLE = 8

#: A-Z to lower case; other ASCII that is not a digit or letter to a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # on the text as it stands, A-Z included


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Wavelet:
    """A wavelet matrix over small non-negative integers: access and rank for arrays of queries."""

    def __init__(self, x: np.ndarray, top: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            b = (x >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(b == 0, dtype=np.int32)]).astype(np.int32)
            self.levels.append((bit, zeros, int(zeros[-1])))
            x = np.concatenate([x[b == 0], x[b == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at
        for bit, zeros, n in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            zl, zh = zeros[lo], zeros[hi]
            lo, hi = np.where(one, n + lo - zl, zl), np.where(one, n + hi - zh, zh)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before."""
        lo, at, symbol = np.zeros_like(at), at, np.zeros(len(at), np.int64)
        for bit, zeros, n in self.levels:
            zl, zp = zeros[lo], zeros[at]
            one = zeros[at + 1] == zp
            lo, at = np.where(one, n + lo - zl, zl), np.where(one, n + at - zp, zp)
            symbol |= one.astype(np.int64) << bit
        return symbol, at - lo


class FMIndex:
    """Over an integer text in which 0 is a separator that no pattern holds; the text ends with 0."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        cut = text == 0
        rank = np.where(cut, np.cumsum(cut) - 1, text.astype(np.int64) + int(cut.sum()))  # every separator differs
        h, order = 1, None
        while True:
            key = rank * np.int64(n + int(text.max(initial=0)) + 2)
            key[: n - h] += rank[h:] + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = new
            if h >= n or rank[order[-1]] == n - 1:
                break
            h *= 2
        before = text[order - 1]  # position 0 is preceded by the last separator
        before[order == 0] = 0
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 2))]).astype(np.int64)
        self.top = int(text.max(initial=0))
        self.bwt = Wavelet(before.astype(np.int64), self.top)
        self.sampled = (order % SAMPLE == 0) | (before == 0)  # walks never pass a separator
        self.place = order[self.sampled]
        self.nth = np.cumsum(self.sampled) - 1
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) of suffixes that begin with each pattern (rows of ``patterns``, padded at the right)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((k < lengths) & (lo < hi))
            s = patterns[live, k]
            known = s <= self.top
            lo[live[~known]] = hi[live[~known]] = 0
            live, s = live[known], s[known]
            base = self.starts[s]
            lo[live], hi[live] = base + self.bwt.rank(s, lo[live]), base + self.bwt.rank(s, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_, at = np.arange(len(rows)), rows.copy()
        while len(open_):
            done = self.sampled[at]
            out[open_[done]] = self.place[self.nth[at[done]]] + step[open_[done]]
            open_, at = open_[~done], at[~done]
            if len(open_):
                symbol, before = self.bwt.access(at)
                at = self.starts[symbol] + before
                step[open_] += 1
        return out


class Phrases:
    """The windows of a block of items: each distinct window once, with the items that hold it."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        code = self.vocabulary
        seen: dict[tuple[int, ...], set[int]] = {}
        self.ids = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            w = [code.setdefault(x, len(code) + 1) for x in words_of(text or "")]
            size = min(window, len(w))
            for p in range(len(w) - size + 1 if size else 0):
                seen.setdefault(tuple(w[p : p + size]), set()).add(k)
        self.lengths = np.array([len(x) for x in seen], np.int64)
        self.patterns = np.zeros((len(seen), window), np.int64)
        for k, x in enumerate(seen):
            self.patterns[k, : len(x)] = x
        self.owners = [sorted(x) for x in seen.values()]
        self.least = int(self.lengths.min(initial=window))

    def hits(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(word count, window starts, window ends, owners' numbers) of each text."""
        part: list[np.ndarray] = []
        size = 0
        for text in texts:
            w = words_of(text)
            part.append(np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.int64, len(w)))
            size += len(w)
            if size >= SHARD_WORDS:
                yield from self._shard(part)
                part, size = [], 0
        yield from self._shard(part)

    def _shard(self, docs: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        if not docs:
            return
        text = np.concatenate([x for d in docs for x in (d, [0])]).astype(np.int64)
        ends = np.cumsum([len(d) + 1 for d in docs])
        inside = text > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        begin, end = edge[::2], edge[1::2]
        keep = end - begin >= self.least
        begin, end = begin[keep], end[keep]
        none = np.zeros(0, np.int64)
        found: dict[int, list[np.ndarray]] = {}
        if len(begin) and len(self.patterns):
            sizes = end - begin + 1  # each run and a separator
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            short = text[np.minimum(at, len(text) - 1)]
            short[np.cumsum(sizes) - 1] = 0
            index = FMIndex(short)
            lo, hi = index.search(self.patterns, self.lengths)
            which = np.repeat(np.arange(len(lo)), hi - lo)
            rows = np.repeat(lo, hi - lo) + (np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo))
            place = at[index.locate(rows)]
            doc = np.searchsorted(ends, place, "right")
            order = np.lexsort((place, doc))
            which, place, doc = which[order], place[order], doc[order]
            for d, a, b in zip(*_runs(doc), strict=True):
                found[int(d)] = [which[a:b], place[a:b] - (ends[d] - len(docs[d]) - 1)]
        for d, codes in enumerate(docs):
            if d in found:
                which, place = found[d]
                owners = np.unique(np.concatenate([self.owners[w] for w in np.unique(which)]))
                yield len(codes), place, place + self.lengths[which], owners
            else:
                yield len(codes), none, none, none


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(x)) + 1
    a = np.concatenate([[0], cut]) if len(x) else cut
    return x[a], a, np.append(cut, len(x))[: len(a)]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint spans that cover the same words."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, far = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > far[:-1]])
    return starts[first], np.append(far[np.flatnonzero(first)[1:] - 1], far[-1])


SPANS = "n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most BLOCK_WORDS words (a longer item is a block of its own).

    The driver holds one block and one partition of the benchmark at a time.
    """
    block: list[tuple[object, str]] = []
    size, some = 0, False
    for item, text in benchmark.select("item_id", F.coalesce("text", F.lit(""))).toLocalIterator(prefetchPartitions=False):
        n = len(words_of(text))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size, some = [], 0, True
        block.append((item, text))
        size += n
    if block or not some:
        yield block


def leak_spans(docs: DataFrame, items: list[tuple[object, str]], window: int = WINDOW) -> DataFrame:
    """For one block of items, a row per row of ``docs``: its columns, merged word spans hit, and the items that occur."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)

    def scan(it):
        phrases = None
        for batch in slices(it, 1000):
            phrases = phrases or Phrases(shared.value, window)
            rows = {"n_words": [], "starts": [], "ends": [], "items": []}
            for n, a, b, owners in phrases.hits([t or "" for t in batch.column("text").to_pylist()]):
                a, b = merged(a, b)
                rows["n_words"].append(n)
                rows["starts"].append(a)
                rows["ends"].append(b)
                rows["items"].append([str(phrases.ids[k]) for k in owners.tolist() if phrases.ids[k] is not None])
            kinds = {"n_words": pa.int64(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "items": pa.list_(pa.string())}
            rest = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in rest] + [pa.array(v, kinds[k]) for k, v in rows.items()], names=rest + list(rows)
            )

    own = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema)
    return docs.mapInArrow(task(scan), f"{own}, {SPANS}")


def _over_blocks(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``rows`` with the spans of every block behind left, right and, where they have them, found and n.

    Every CHAINED blocks the rows are written, so that no task feeds more Python workers than that in a row.
    """
    out, last = rows, None
    more = {"left": F.concat("left", "starts"), "right": F.concat("right", "ends"), "found": F.concat("found", "items"), "n": F.col("n_words")}
    for k, block in enumerate(_blocks(benchmark)):
        if k and k % CHAINED == 0:
            out = staged(out, "spans")
            if last is not None:
                discard(last)
            last = out
        out = leak_spans(out, block, window).select(*(more[x].alias(x) if x in more else x for x in rows.columns))
    return out


def _all_spans(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, starts, ends, items) of each row, spans and items of all blocks in a row.

    Every block is one more step over the same rows, whose text stays as it is
    and whose lists grow, so no block needs a shuffle and repeated items of
    several blocks stay apart as those of one do.
    """
    none = F.array().cast("array<bigint>")
    out = texts(docs).select("doc_id", "text", none.alias("left"), none.alias("right"), none.cast("array<string>").alias("found"), F.lit(0).cast("bigint").alias("n"))
    out = _over_blocks(out, benchmark, window)
    return out.select("doc_id", F.col("n").alias("n_words"), F.col("left").alias("starts"), F.col("right").alias("ends"), F.col("found").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the merged word spans."""
    spans = _all_spans(docs, benchmark, window)

    def digest(it):
        for b in it:
            hit, many, sha, left, right = [], [], [], [], []
            for s, e, items in zip(b.column("starts").to_pylist(), b.column("ends").to_pylist(), b.column("items").to_pylist(), strict=True):
                s, e = merged(np.array(s, np.int64), np.array(e, np.int64))
                hit.append(int((e - s).sum()))
                many.append(len(items))
                sha.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
                left.append(s)
                right.append(e)
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "span_starts", "span_ends"]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array(many, pa.int64()), pa.array(sha, pa.string()), pa.array(left, longs), pa.array(right, longs)], names=names
            )

    out = spans.mapInArrow(task(digest), "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, span_starts array<bigint>, span_ends array<bigint>")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "span_starts", "span_ends")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    out, last, at = [], 0, iter(spans)
    span = next(at, None)
    begin = 0
    for k, m in enumerate(WORD.finditer(text)):
        if span is None:
            break
        if k == span[0]:
            begin = m.start()
        if k == span[1] - 1:
            out.append(text[last:begin])
            last = m.end()
            span = next(at, None)
    out.append(text[last:])
    return "".join(out)


@plain_names
def removed(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the benchmark's windows cut out of the texts; ``n_chars``, if there, follows. Null texts stay null."""
    names = docs.columns
    none = F.array().cast("array<bigint>")
    rest = [x for x in names if x != "text"]
    out = docs.select(F.struct(*rest, F.lit(0).alias("_")).alias("row"), "text", none.alias("left"), none.alias("right"))
    own = f"row {out.schema['row'].dataType.simpleString()}"
    out = _over_blocks(out, benchmark, window)  # all on the text as it was, so that blocks make no difference

    def cut(it):
        for b in slices(it):
            texts = []
            for t, s, e in zip(b.column("text").to_pylist(), b.column("left").to_pylist(), b.column("right").to_pylist(), strict=True):
                s, e = merged(np.array(s, np.int64), np.array(e, np.int64))
                texts.append(cut_words(t, list(zip(s.tolist(), e.tolist(), strict=True))) if len(s) else t)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    out = out.mapInArrow(task(cut), f"{own}, text string")
    out = out.select(*(F.col("text") if x == "text" else F.col("row")[x].alias(x) for x in names))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
