"""Exact repeated-substring removal by recompression.

Words are symbols. A round replaces runs (a a a) and then pairs (a b, with a
in the round's left half of the alphabet and b in its right half) by new
symbols. Names are hashes of what they stand for, so every task of every round
names equal runs and pairs alike over the whole corpus without a dictionary to
join. Each symbol carries the extent of words that decided it; equal
substrings share every symbol whose extent lies inside them.

A window of 20 words is anchored at the symbol of widest extent inside it, of
equally wide ones that of least hash (at its own words, if there is none). On one side of
that symbol the window has half of its other words or more, on the left if on both;
the words of the symbol with that half are its anchor: equal windows have equal ones.
Windows with one anchor stand in a row, a group. Groups are exchanged as (anchor,
hash of all words of the group, document, place):

* the group's words occur earlier: all its windows are repeats;
* its anchor occurs nowhere else: none is;
* else its windows are exchanged one by one, by the hash of their words. The
  first occurrence of a window is always in such a group, so this is exact.

Each batch of documents combines equal keys before it sends them, so a
passage in a third of all documents costs one entry a batch. Entries travel in
packets, one for each batch and fragment of the key space, documents listed once
and places as differences; a fragment is sorted in numpy. Anchors are cut to
four bytes, which can only send more windows to the second exchange.

Words are compared by 64-bit hashes, windows by 64-bit hashes of those.

Defined results: null and empty texts have no words, and keep the hash of an
empty text; documents are ordered by (doc_id, text hash), null ids last; rows
equal in both are one document and get one result each; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, WordHashes, combine, id_column, keyed, mix, staged

WINDOW = 20
ROUNDS = 2
#: Shuffle partitions to a fragment of the key space.
FRAGMENTS = 1
#: Words that are worked on at once, about (a document is never split).
BATCH_WORDS = 400_000

_HASHES = WordHashes()


def split(text: str | bytes) -> list[bytes]:
    """Words of a text, or of a compressed one."""
    if isinstance(text, bytes):
        return zstandard.decompress(text).split()
    return text.encode("utf-8", "surrogatepass").split()  # white space of bytes is that of ASCII


def packed(docs: DataFrame) -> DataFrame:
    """doc, h and the text as compressed bytes: texts are what is shuffled most."""

    def pack(it):
        small = zstandard.ZstdCompressor(level=1).compress
        for b in it:
            texts = [small(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("h"), pa.array(texts, pa.binary())], names=["doc", "h", "text"])

    return docs.mapInArrow(pack, "doc bigint, h bigint, text binary")


def symbols(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, first word, last word that decided it) after the rounds; ``doc`` numbers the documents of the words."""
    place = np.arange(len(words))
    first = np.searchsorted(doc, doc, "left") - 1  # outside of the document
    last = np.searchsorted(doc, doc, "right")
    sym, lo, hi = words, place, place
    for r in range(rounds):
        for runs in (True, False):
            n = len(sym)
            if not n:
                break
            same = doc[1:] == doc[:-1]
            before = np.concatenate([first[:1], np.where(same, lo[:-1], first[1:])])
            after = np.concatenate([np.where(same, hi[1:], last[:-1]), last[-1:]])
            if runs:
                begin = np.concatenate([[True], ~same | (sym[1:] != sym[:-1])])
                a = np.flatnonzero(begin)
                size = np.diff(np.append(a, n))
                b = a + size - 1
                sym = np.where(size > 1, combine(sym[a], size.astype(np.uint64)), sym[a])
                lo, hi = before[a], after[b]
            else:
                right = (mix(sym + np.uint64((r + 1) * int(ODD) % (1 << 64))) & np.uint64(1)).astype(bool)
                pair = np.append(same & ~right[:-1] & right[1:], False)
                second = np.concatenate([[False], pair[:-1]])
                a = np.flatnonzero(~second)
                p = pair[a]
                nxt = np.minimum(a + 1, n - 1)
                lo = np.where(right[a], before[a], lo[a])
                hi = np.where(p, hi[nxt], np.where(right[a], hi[a], after[a]))
                sym = np.where(p, combine(sym[a], sym[nxt]), sym[a])
            doc, first, last = doc[a], first[a], last[a]
    return sym, lo, hi


class Ranges:
    """Hashes of any run of words, from two sums of powers."""

    def __init__(self, words: np.ndarray):
        self.sums = []
        with np.errstate(over="ignore"):
            for base, x in ((0x9E3779B97F4A7C15, words), (0xC2B2AE3D27D4EB4F, mix(words + ODD))):
                power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), base, np.uint64)]), dtype=np.uint64)
                back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), pow(base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
                self.sums.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[:-1], dtype=np.uint64)]), back))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            a, b = ((s[end] - s[begin]) * back[begin] for s, back in self.sums)
            return combine(mix(a) + (end - begin).astype(np.uint64), b)


def anchored(words: np.ndarray, sizes: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Groups of windows with one anchor: (anchor key, key of all words, first start, last start), starts over all words."""
    n = len(words)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    start = np.flatnonzero(np.arange(n) + window <= ends[doc]) if n else np.zeros(0, np.int64)
    if not len(start):
        return (np.zeros(0, np.uint64),) * 2 + (start,) * 2
    sym, lo, hi = symbols(words, doc, rounds)
    long = np.minimum(hi - lo, 15).astype(np.uint64)  # what took more words to decide is rarer
    key = (np.uint64(15) - long) << np.uint64(60) | mix(sym) >> np.uint64(4)
    a, b = np.searchsorted(lo, start, "left"), np.searchsorted(hi, start + window - 1, "right")
    level, best = [np.arange(len(key))], 1
    while 2 * best <= max(1, int((b - a).max())):  # level k: place of the least key among 2**k in a row
        x, y = level[-1][:-best], level[-1][best:]
        level.append(np.where(key[x] <= key[y], x, y))
        best *= 2
    size = np.maximum(b - a, 1)
    k = np.frexp(size.astype(np.float64))[1] - 1
    anchor = np.full(len(start), -1)
    for j, row in enumerate(level):
        at = np.flatnonzero((k == j) & (b > a))
        x, y = row[a[at]], row[b[at] - (1 << j)]
        anchor[at] = np.where(key[x] <= key[y], x, y)
    ranges = Ranges(words)
    found = anchor >= 0
    # the anchor's words and half of the window's others, on the side that has them
    a, b = np.where(found, lo[anchor], start), np.where(found, hi[anchor] + 1, start + window)
    half = (window - (b - a) + 1) // 2
    left = a - start >= half
    begin = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | ~found[1:] | (start[1:] != start[:-1] + 1)])
    g = np.flatnonzero(begin)
    s1, s2 = start[g], start[np.append(g[1:], len(start)) - 1]
    a, b, half, left = a[g], b[g], half[g], left[g]
    return ranges.of(np.where(left, a - half, a), np.where(left, b, b + half)), ranges.of(s1, s2 + window), s1, s2


def _packets(key, whole, who, s1, s2, docs, hs, fragments, anchors=True):
    """Combine equal keys of a batch, and deal its entries out: an Arrow batch with a row for each fragment."""
    order = np.lexsort((s1, hs[who], docs[who], whole))
    key, whole, who, s1, s2 = (x[order] for x in (key, whole, who, s1, s2))
    head = np.concatenate([[True], whole[1:] != whole[:-1]])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(whole)), 0))
    later = (docs[who] != docs[who[lead]]) | (hs[who] != hs[who[lead]]) | (s1 != s1[lead])
    frag = (mix(key) % np.uint64(fragments)).astype(np.int64)
    keep = np.flatnonzero(head | later)  # rows equal in all are one
    order = keep[np.lexsort((s1[keep], who[keep], later[keep], frag[keep]))]
    at = np.searchsorted(frag[order], np.arange(fragments + 1))
    rows = {x: [] for x in ("frag", "keys", "wholes", "doc", "h", "many", "s1", "s2")}
    for f in np.flatnonzero(np.diff(at)):
        own = order[at[f] : at[f + 1]]
        new = own[~later[own]]
        begin = np.flatnonzero(np.concatenate([[True], (who[own][1:] != who[own][:-1]) | (later[own][1:] != later[own][:-1])]))
        step = np.diff(s1[own], prepend=0)
        step[begin] = s1[own][begin]
        rows["frag"].append(f)
        rows["keys"].append((key[new] >> np.uint64(32)).astype("<u4").tobytes() if anchors else b"")
        rows["wholes"].append(whole[new].tobytes())
        rows["doc"].append(docs[who[own[begin]]].tobytes())
        rows["h"].append(hs[who[own[begin]]].tobytes())
        rows["many"].append(np.diff(np.append(begin, len(own))).astype("<u4").tobytes())
        rows["s1"].append((b"2" if step.max() < 1 << 16 else b"4") + step.astype("<u2" if step.max() < 1 << 16 else "<u4").tobytes())
        rows["s2"].append((s2 - s1)[own].astype("u1").tobytes() if anchors else b"")
    kinds = [pa.int32(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def _unpacked(keys, wholes, doc, h, many, s1, s2):
    """(key, whole, doc, h, s1, s2 - s1, known to be later) of a packet's entries."""
    many = np.frombuffer(many, "<u4")
    total = int(many.sum())
    step = np.frombuffer(s1, f"<u{s1[:1].decode()}", offset=1).astype(np.int64)
    begin = np.cumsum(many) - many
    run = np.cumsum(step)
    place = run - np.repeat(run[begin] - step[begin], many)
    whole = np.frombuffer(wholes, np.uint64)
    key = np.frombuffer(keys, "<u4").astype(np.uint64) if keys else whole
    pad = np.zeros(total - len(whole), np.uint64)
    width = np.frombuffer(s2, "u1") if s2 else np.zeros(total, np.uint8)
    both = (np.repeat(np.frombuffer(x, np.int64), many) for x in (doc, h))
    return np.concatenate([key, pad]), np.concatenate([whole, pad]), *both, place, width, np.arange(total) >= len(whole)


PACKET = "frag int, keys binary, wholes binary, doc binary, h binary, many binary, s1 binary, s2 binary"
#: span: first start, starts behind it (a byte) and verdict (a byte) of a group. A row a group, as rows by document and fragment would grow with both.
VERDICT = "doc bigint, h bigint, span bigint"
REPEATED, UNDECIDED = 1, 2


def _judge(table: pa.Table) -> pa.Table:
    """All packets of a fragment: which groups are repeats (1), and which have windows to look at (2)."""
    cols = ([v.as_py() for v in table.column(x)] for x in ("keys", "wholes", "doc", "h", "many", "s1", "s2"))
    parts = [_unpacked(*x) for x in zip(*cols, strict=True)]
    key, whole, doc, h, s1, s2, known = (np.concatenate(x) for x in zip(*parts, strict=True))
    verdict = np.where(known, REPEATED, 0).astype(np.int8)
    own = np.flatnonzero(~known)
    order = own[np.lexsort((s1[own], h[own], doc[own], whole[own]))]
    if len(order):
        head = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        differs = (doc[order] != doc[lead]) | (h[order] != h[lead]) | (s1[order] != s1[lead])
        verdict[order[differs]] = REPEATED
        # an anchor of several groups: what is first among equal words is undecided
        rest = own[verdict[own] == 0]
        found, at, n = np.unique(key[rest], return_inverse=True, return_counts=True)
        several = n[at] > 1
        # equal rows in two packets are one group
        if several.any():
            r = rest[several]
            o = r[np.lexsort((s1[r], h[r], doc[r], key[r]))]
            same = np.concatenate([[False], (key[o][1:] == key[o][:-1]) & (doc[o][1:] == doc[o][:-1]) & (h[o][1:] == h[o][:-1]) & (s1[o][1:] == s1[o][:-1])])
            o = o[~same]
            found, at, n = np.unique(key[o], return_inverse=True, return_counts=True)
            verdict[o[n[at] > 1]] = UNDECIDED
        repeated = own[verdict[own] == REPEATED]  # an anchor whose other groups are all repeats of other words
        if len(repeated):
            rest = own[verdict[own] == 0]
            hit = np.isin(key[rest], key[repeated])
            verdict[rest[hit]] = UNDECIDED
    del parts
    pa.default_memory_pool().release_unused()
    out = np.flatnonzero(verdict)
    out = out[np.lexsort((s1[out], h[out], doc[out]))]
    span = s1[out].astype(np.int64) << 16 | s2[out].astype(np.int64) << 8 | verdict[out]
    return pa.Table.from_arrays([pa.array(doc[out]), pa.array(h[out]), pa.array(span)], names=["doc", "h", "span"])


def _spans(spans: list[int] | None, verdict: int) -> tuple[np.ndarray, np.ndarray]:
    """First starts, and starts behind those, of a document's groups of one verdict."""
    x = np.array(spans or [], np.int64)
    x = x[x & 255 == verdict]
    return x >> 16, x >> 8 & 255


def _exchange(packets: DataFrame) -> DataFrame:
    return packets.groupBy("frag").applyInArrow(_judge, VERDICT)


def _chunks(it, limit: int = BATCH_WORDS):
    """Documents in lots: (docs, hs, word hashes in a row, words of each, the rows' further columns)."""
    docs, hs, words, rest, total = [], [], [], [], 0
    for b in it:
        more = [b.column(x).to_pylist() for x in b.schema.names if x not in ("doc", "h", "text")]
        for k, (d, h, t) in enumerate(zip(b.column("doc").to_pylist(), b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True)):
            w = _HASHES.of(split(t))
            docs.append(d)
            hs.append(h)
            words.append(w)
            rest.append([x[k] for x in more])
            total += len(w)
            if total >= limit:
                yield np.array(docs, np.int64), np.array(hs, np.int64), np.concatenate(words), np.array([len(x) for x in words]), rest
                docs, hs, words, rest, total = [], [], [], [], 0
    if docs:
        yield np.array(docs, np.int64), np.array(hs, np.int64), np.concatenate(words), np.array([len(x) for x in words]), rest


def _verdicts(docs: DataFrame, window: int, fragments: int) -> DataFrame:
    def groups(it):
        for ids, hs, words, sizes, _ in _chunks(it):
            key, whole, s1, s2 = anchored(words, sizes, window)
            if len(key):
                begin = np.cumsum(sizes) - sizes
                who = np.searchsorted(begin + sizes, s1, "right")
                yield _packets(key, whole, who, s1 - begin[who], s2 - begin[who], ids, hs, fragments)

    first = staged(_exchange(docs.mapInArrow(groups, PACKET)), "repeats")

    def windows(it):
        for ids, hs, words, sizes, rest in _chunks(it):
            begin = np.cumsum(sizes) - sizes
            who, start = [], []
            for k, (spans,) in enumerate(rest):
                a, b = _spans(spans, UNDECIDED)
                b = b + 1
                s = np.repeat(a - (np.cumsum(b) - b), b) + np.arange(b.sum())
                start.append(s)
                who.append(np.full(len(s), k))
            if start and sum(map(len, start)):
                who, start = np.concatenate(who), np.concatenate(start)
                at = start + begin[who]
                key = Ranges(words).of(at, at + window)
                yield _packets(key, key, who, start, start, ids, hs, fragments, anchors=False)

    by_doc = lambda v: v.groupBy("doc", "h").agg(F.collect_list("span").alias("spans"))
    undecided = packed(docs).join(by_doc(first.where(f"span & 255 = {UNDECIDED}")).hint("shuffle_hash"), ["doc", "h"])
    second = _exchange(undecided.select("doc", "h", "text", "spans").mapInArrow(windows, PACKET))
    return by_doc(first.union(second))


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text, a row per row of ``docs``."""
    spark = docs.sparkSession
    base = keyed(docs)
    fragments = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // FRAGMENTS)
    verdicts = _verdicts(base, window, fragments)

    def cut(it):
        for b in it:
            n, gone, sha, kept = [], [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = split(text)
                n.append(len(words))
                left = words
                if spans:
                    a, e = _spans(spans, REPEATED)
                    e = a + e + window
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, e, -1)
                    left = [words[k] for k in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
                gone.append(len(words) - len(left))
                whole = b" ".join(left)
                sha.append(hashlib.sha256(whole).hexdigest())
                kept.append(whole.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), b.column("h"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc", "h", "n_words", "n_removed", "kept_sha256", "kept"]
            )

    out = packed(base).join(verdicts.hint("shuffle_hash"), ["doc", "h"], "left").select("doc", "h", "text", "spans").mapInArrow(cut, "doc bigint, h bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return out.select(id_column().alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
