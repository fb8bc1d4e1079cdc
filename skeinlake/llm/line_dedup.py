"""Line dedup by pairwise alignment.

Lines are what stands between newlines; two lines are equal if their 64-bit
hashes are. A line is rare here if it has ``MIN_WORDS`` words or more: such lines
anchor patience diff, those that stand once first. How many documents hold
it does not count against it, since a group of copies makes all its lines
frequent.

Short lines anchor by twos: a short line and the next one that is not blank, if
that is short as well, are one rare line. So verse, lists and code are paired and
aligned too. A text of several lines also leads to the first equal one. A short
line between long ones, or alone in its text, starts no match.

Each rare line leads to the first document that holds it (rarely more than one
or two for a document), so a group of n copies gives n - 1 pairs, not n squared.
Each pair is aligned: rare lines of both, longest increasing run of them, and
again between those; where none is unique, a longest common subsequence of those
that both hold decides, as in an ordinary diff. Matches grow over equal neighbours
of any kind. What stands in another order is aligned again, without what is
matched, until no rare line of both is left (after ``PASSES`` alignments each for
itself). Aligned lines are deleted from the later document. So every rare line that
an earlier document holds goes, and a line is only ever deleted for an equal one in
an earlier document: the first copy of each stays.

Equal documents are not aligned: of all but the first, every line is matched.
A line that very many documents hold meets its first document by broadcast (there
are ``HOT`` such lines at most); the lines of a first document that many others lead
to are sent once for each ``SALT`` of them.

Texts are shuffled once, for the deletion; before that, only hashes of lines
travel.

Defined results: null texts stay null and have no line; a text without newline
is one line; a document all of whose words are deleted has an empty text;
documents are ordered by (doc_id, text hash), null ids last; equal rows are one
document and get equal results; empty tables give empty results; further columns
travel along in ``without_copied_lines``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, combine, discard, doc_column, hash_column, keyed, mix, plain_names, slices, staged, task

MIN_WORDS = 5
#: Alignments of one pair, before the lines that are left are matched one by one.
PASSES = 6
#: Lines that are broadcast with their first documents at most, and least holders of one.
HOT, LEAST_HOT = 1 << 14, 2_000
#: Documents that meet one copy of their first document's lines, about.
SALT = 1_000
#: Bits of alignment state that one gap takes at most (64 MB).
BITS = 1 << 29


def line_table(docs: DataFrame) -> DataFrame:
    """doc, h, lines (hashes in order), kind (of each: 0 blank, 1 short, 2 long enough to be an anchor)."""
    lines = F.split("text", "\n", -1)
    # enough words: a gap of spaces or tabs after at least MIN_WORDS - 1 words
    long = lambda x: x.rlike(r"^\s*(\S+\s+){%d}\S" % (MIN_WORDS - 1))
    kind = F.transform(lines, lambda x: F.when(long(x), 2).when(x.rlike(r"\S"), 1).otherwise(0).cast("tinyint"))
    return keyed(docs).where("text <> ''").select("doc", "h", F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"), kind.alias("kind"))


def anchor_keys(lines: np.ndarray, kind: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """What each line anchors by, 0 if by nothing: a long line by itself, a short one with the next if that is short (blank ones between count too)."""
    x = lines.view(np.uint64)
    key = np.where(kind == 2, x, np.uint64(0))
    at = np.flatnonzero(kind > 0)
    at = np.stack([at[:-1], at[1:]])[:, (kind[at[:-1]] == 1) & (kind[at[1:]] == 1) & (owner[at[:-1]] == owner[at[1:]])]
    total = np.cumsum(mix(x + ODD), dtype=np.uint64)
    key[at[0]] = combine(x[at[0]], total[at[1]] - total[at[0]])
    return key.view(np.int64)


def _anchors(it):
    for b in it:
        lists = b.column("lines")
        size = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(b.num_rows), size)
        lines, kind = lists.flatten().to_numpy(), b.column("kind").flatten().to_numpy()
        key = anchor_keys(lines, kind, owner)
        # a whole text of several lines is a key of its own
        h = b.column("h").to_numpy()
        several = np.flatnonzero(size > 1)
        some = key != 0
        who = np.concatenate([owner[some], several])
        key = np.concatenate([key[some], mix(h[several].view(np.uint64)).view(np.int64)])
        yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(who)), pa.array(h[who]), pa.array(key)], names=["doc", "h", "line"])


def patience(a: list[int], b: list[int], anchors_a: set[int], anchors_b: set[int]) -> list[int]:
    """Places in ``b`` that align with equal ones in ``a``; anchors are values that may start a match."""
    keys = lambda x, anchors: [v if v in anchors else None for v in x]
    return aligned(a, b, keys(a, anchors_a), keys(b, anchors_b))


def aligned(a: list[int], b: list[int], keys_a: list[int | None], keys_b: list[int | None]) -> list[int]:
    """Places in ``b`` that align with equal ones in ``a``; places of equal keys, None being none, may start a match."""
    hit: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0] and (hit and hit[-1] == b0 - 1 or keys_a[a0] is not None and keys_a[a0] == keys_b[b0]):
            hit.append(b0)
            a0, b0 = a0 + 1, b0 + 1
        once_a = _once(keys_a, a0, a1)
        once_b = _once(keys_b, b0, b1)
        pairs = sorted((once_a[x], once_b[x]) for x in once_a.keys() & once_b.keys())
        chain = _increasing(pairs) if pairs else _common(keys_a, a0, a1, keys_b, b0, b1)
        if not chain:
            continue
        x0, y0 = a0, b0
        for x, y in chain:
            if x < x0 or y < y0:
                continue  # a match before has grown over it
            x_, y_ = x, y
            while x_ > x0 and y_ > y0 and a[x_ - 1] == b[y_ - 1]:
                x_, y_ = x_ - 1, y_ - 1
            todo.append((x0, x_, y0, y_))
            while x < a1 and y < b1 and a[x] == b[y]:
                x, y = x + 1, y + 1
            hit.extend(range(y_, y))
            x0, y0 = x, y
        todo.append((x0, a1, y0, b1))
    return hit


def matched(a: list[int], b: list[int], keys_a: list[int | None], keys_b: list[int | None]) -> set[int]:
    """Places in ``b`` of all that alignments with ``a`` match: every place whose key ``a`` has, and what grows from them."""
    there = {k for k in keys_a if k is not None}
    b, keys_b = [*b], [*keys_b]
    hit: set[int] = set()
    for _ in range(PASSES):
        if there.isdisjoint(keys_b):
            return hit
        for k in aligned(a, b, keys_a, keys_b):
            hit.add(k)
            b[k] = keys_b[k] = None  # equal to no line
    first = {}
    for x, k in enumerate(keys_a):
        first.setdefault(k, x)
    for y, k in enumerate(keys_b):
        if k is None or k not in there or y in hit:
            continue
        x = first[k]
        for step, end in ((-1, -1), (1, len(b))):
            i, j = (x, y) if step > 0 else (x - 1, y - 1)
            while 0 <= i < len(a) and j != end and b[j] is not None and a[i] == b[j]:
                hit.add(j)
                i, j = i + step, j + step
    return hit


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first places, whose second places increase."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        p = bisect_left(tops, y)
        back[k] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(y)
            piles.append(k)
        else:
            tops[p], piles[p] = y, k
    chain = []
    k = piles[-1]
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def _common(a: list[int | None], a0: int, a1: int, b: list[int | None], b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of the keys in a gap without unique ones."""
    both = (set(a[a0:a1]) & set(b[b0:b1])) - {None}
    if not both:
        return []
    x = [k for k in range(a0, a1) if a[k] in both]
    y = [k for k in range(b0, b1) if b[k] in both]
    return [(x[i], y[j]) for i, j in subsequence([a[k] for k in x], [b[k] for k in y])]


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """For each prefix of ``x``, a bit per place of ``y``: 0 where the common subsequence grows (Hyyro's bit vectors)."""
    at: dict[int, int] = {}
    for j, v in enumerate(y):
        at[v] = at.get(v, 0) | 1 << j
    full = row = (1 << len(y)) - 1
    for v in x:
        u = row & at.get(v, 0)
        row = (row + u | row - u) & full
        yield row


def subsequence(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence; halves ``x`` where the bit vectors would take over ``BITS``."""
    if not x or not y:
        return []
    if len(x) > 1 and len(x) * len(y) > BITS:
        half = len(x) // 2
        grown = []
        for p, q in ((x[:half], y), (x[:half - 1:-1], y[::-1])):
            *_, row = _rows(p, q)
            bits = np.unpackbits(np.frombuffer(row.to_bytes(len(q) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(q)]
            grown.append(np.concatenate([[0], np.cumsum(bits == 0)]))
        cut = int(np.argmax(grown[0] + grown[1][::-1]))
        return subsequence(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in subsequence(x[half:], y[cut:])]
    rows = list(_rows(x, y))
    out = []
    i, j = len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _once(x: list[int | None], begin: int, end: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for k in range(begin, end):
        if x[k] is not None:
            seen[x[k]] = -1 if x[k] in seen else k
    return {v: k for v, k in seen.items() if k >= 0}


def _align(it):
    for b in slices(it, 200):
        cut = []
        cols = (b.column(x) for x in ("lines", "kind", "lines0", "kind0"))
        for row in zip(*cols, strict=True):
            own, kind, first, kind0 = (x.values.to_numpy() for x in row)
            keys, keys0 = (anchor_keys(x, k, np.zeros(len(x), np.int8)) for x, k in ((own, kind), (first, kind0)))
            hit = matched(first.tolist(), own.tolist(), [k or None for k in keys0.tolist()], [k or None for k in keys.tolist()])
            cut.append(np.array(sorted(hit), np.int32))
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("h"), pa.array(cut, pa.list_(pa.int32()))], names=["doc", "h", "cut"])


def copied_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, h, cut): the places of the lines to delete, for documents that have some; and (h, first) of texts that several documents hold."""
    table = staged(line_table(docs), "lines")
    texts = table.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.size("lines") > 1).alias("several"), F.max(F.exists("kind", lambda k: k == 2)).alias("rare"))
    copies = staged(texts.where("first < last and (several or rare)").select("h", "first"), "copies")
    # copies of an earlier text are deleted whole, and no line of theirs comes first
    own = table.join(copies, "h", "left").where("first is null or doc = first").drop("first").dropDuplicates(["doc", "h"])
    lines = staged(own, "firsts")
    discard(table)
    one = lines.select("doc", "h", "lines", "kind").mapInArrow(task(_anchors), "doc bigint, h bigint, line bigint")
    at = F.struct("doc", "h")
    first = staged(one.groupBy("line").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).where("first <> last").select("line", "first", "n"), "leads")
    least = max(LEAST_HOT, -(-(first.agg(F.sum("n")).first()[0] or 0) // HOT))
    hot = F.broadcast(first.where(F.col("n") >= least).drop("n"))  # HOT lines at most, as their holders add up to the total at most
    found = one.join(hot, "line").unionByName(one.join(hot, "line", "left_anti").join(first.where(F.col("n") < least).drop("n"), "line"))
    pairs = staged(found.where(at > F.col("first")).select("doc", "h", F.col("first.doc").alias("doc0"), F.col("first.h").alias("h0")).distinct(), "pairs")
    salts = pairs.groupBy("doc0", "h0").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    theirs = lines.select(F.col("doc").alias("doc0"), F.col("h").alias("h0"), F.col("lines").alias("lines0"), F.col("kind").alias("kind0")).join(salts, ["doc0", "h0"])
    theirs = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    both = pairs.join(salts, ["doc0", "h0"]).withColumn("salt", F.pmod(F.xxhash64("doc", "h"), F.col("salts")).cast("int")).drop("salts")
    both = both.join(lines, ["doc", "h"]).join(theirs, ["doc0", "h0", "salt"])
    cut = both.select("doc", "h", "lines", "kind", "lines0", "kind0").mapInArrow(task(_align), "doc bigint, h bigint, cut array<int>")
    out = staged(cut.where("size(cut) > 0").groupBy("doc", "h").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut")), "cuts")
    discard(lines, first, pairs)
    return out, copies


def _shortened(docs: DataFrame, names: list[str]) -> DataFrame:
    """``names`` of docs, n_lines, n_deleted and the kept text (null if the text is)."""
    text = F.coalesce("text", F.lit(""))
    rest = [x for x in names if x != "text"]
    rows = docs.select(F.struct(*rest, F.lit(0).alias("_")).alias("row"), F.col("text"), doc_column().alias("doc"), hash_column(text).alias("h"))
    cuts, copies = copied_lines(docs)
    out = rows.join(cuts.hint("shuffle_hash"), ["doc", "h"], "left")
    # few texts are held by several documents, but some of them by very many
    out = out.join(copies, "h", "left").withColumn("copy", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)))

    def delete(it):
        for b in slices(it):
            n, gone, kept = [], [], []
            for text, cut, copy in zip(b.column("text").to_pylist(), b.column("cut").to_pylist(), b.column("copy").to_pylist(), strict=True):
                lines = text.split("\n") if text else []
                cut = range(len(lines)) if copy else cut
                n.append(len(lines))
                gone.append(len(cut or ()))
                if cut:
                    drop = set(cut)
                    lines = [x for k, x in enumerate(lines) if k not in drop]
                    text = "\n".join(lines)
                    if not text.strip():
                        text = ""
                kept.append(text)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_lines", "n_deleted", "kept"])

    own = rows.schema["row"].dataType.simpleString()
    return out.select("row", "text", "cut", "copy").mapInArrow(task(delete), f"row {own}, n_lines bigint, n_deleted bigint, kept string")


@plain_names
def without_copied_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with aligned lines deleted; documents of which no word is left go. ``n_chars``, if there, follows."""
    names = docs.columns
    out = _shortened(docs, names).where("n_deleted = 0 or kept <> ''")
    own = {x: F.col("row")[x].alias(x) for x in names} | {"text": F.col("kept").alias("text")}
    if "n_chars" in names:
        own["n_chars"] = F.when(F.col("n_deleted") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")).alias("n_chars")
    return out.select(*own.values())


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted, kept_sha256, a row per row of ``docs``."""
    out = _shortened(docs, ["doc_id"])
    return out.select("row.doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
