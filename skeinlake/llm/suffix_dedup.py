"""Removal of repeated byte strings: suffixes sorted over all documents by a merge sort that knows common prefixes.

What is sorted. A window is ``WINDOW`` bytes of one document. Its anchor is that one of
its strings of ``GRAM`` bytes whose hash is least (the first of equals), so equal windows
have equal anchors at one place. Windows in a row with one anchor are one item: the
suffix from the anchor on, cut behind the last window, and then the bytes before the
anchor, read backwards to the first window. Equal items are equal groups of windows,
and items of one anchor stand beside each other in sorted order.

Which items travel. As in sorts that exchange only prefixes that tell strings apart, a
round of hashes comes first: items whose anchor no other document has are unique and
stay at home. An anchor with more than ``HOT`` different items is left out of groups: its
windows are items of their own then, dealt by their hash, so that no group grows with
the data.

The sort. Every task sorts its items into runs of different strings, front-codes them
(the length of the prefix shared with the string before, and the rest), cuts the runs at
splitters and exchanges the pieces. Where pieces meet, a loser tree merges them: strings
carry the length of the prefix they share with the last one taken, the longer prefix wins
without a look at the bytes, and bytes are compared from there on only. Shared
prefixes of the merged order tell equal items and items of one anchor. A window goes if it
stands in a document with a smaller id; a run keeps each string for its least id only, later
ones are decided at home.

Lots. Texts are packed into lots of ``LOT_BYTES`` once, staged, and read again for the hashes,
the sort and the cut. Parts of the key space follow from the bytes of the texts. The driver gets
sums, and four strings of ``GRAM`` bytes for each part, which become splitters: they
balance the parts and decide nothing.

Strings are compared byte by byte; a hash can only bring more strings into the sort.

Defined results: null texts are empty; rows without doc_id come after all ids and are not smaller
than each other, nor are rows of one doc_id, repeated or not; texts shorter than a window stay
whole; an empty table gives none; other columns are left behind. ``kept`` is bytes, as a cut
can fall into a character.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, discard, mix, slices, staged, task, tidy

WINDOW, GRAM = 50, 20
#: Grams of a window, and the widest item with its kind and its two places.
GRAMS = WINDOW - GRAM + 1
WIDTH = 1 + WINDOW + GRAMS - 1 + 2
#: Bytes of texts in a lot (a document is never split), and for a part of the key space.
LOT_BYTES, PART_BYTES = 2_000_000, 32_000_000
#: Windows whose hashes are in memory at once, items of a run, and rows that are made at once.
CHUNK, RUN_ITEMS, ROWS = 1 << 18, 150_000, 1 << 13
#: Different items of one anchor that may meet in one group.
HOT = 2_000
SAMPLE = 32

LOTS = "lot bigint, ids binary, nulls binary, sizes binary, bytes bigint, sample binary, texts binary"
PACKET = "part int, known boolean, items bigint, prefixes binary, sizes binary, tails binary, ids binary, nulls binary, many binary, lots binary, which binary, places binary, counts binary"
VERDICT = "lot bigint, starts binary, counts binary"


def _small(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _array(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def in_lots(docs: DataFrame, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """The texts, some megabytes to a row, with the ids and sizes of their documents."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def pack(it):
        own, total, at = [], 0, TaskContext.get().partitionId() << 32

        def lot():
            text = b"".join(t for _, t in own)
            n = len(text) - GRAM
            sample = b"".join(text[x : x + GRAM] for x in (range(0, n, -(-n // SAMPLE)) if n > 0 else ()))
            cells = [at, np.array([d or 0 for d, _ in own], np.int64).tobytes(), np.array([d is None for d, _ in own]).tobytes(), np.array([len(t) for _, t in own], np.int64).tobytes(), len(text), sample, _small(text)]
            return pa.RecordBatch.from_pylist([dict(zip((x.split()[0] for x in LOTS.split(", ")), cells, strict=True))], pa.schema([("lot", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.int64()), ("sample", pa.binary()), ("texts", pa.binary())]))

        for b in slices(it):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own.append((doc, text))
                total += len(text)
                if total >= lot_bytes:
                    yield lot()
                    own, total, at = [], 0, at + 1
        if own:
            yield lot()

    return rows.mapInArrow(task(pack), LOTS)


class Lot:
    """A row of ``in_lots``, open."""

    def __init__(self, ids: bytes, nulls: bytes, sizes: bytes, texts: bytes):
        self.ids, self.nulls = np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool)
        self.sizes = np.frombuffer(sizes, np.int64)
        self.text = np.frombuffer(zstandard.decompress(texts), np.uint8)
        self.ends = np.cumsum(self.sizes)

    def groups(self) -> tuple[np.ndarray, ...]:
        """(hash of the anchor, hash of all bytes, first window, last window, anchor) of all items."""
        n, parts = len(self.text), []
        inside = np.zeros(n + 1, np.int8)  # windows within one document
        long = self.sizes >= WINDOW
        inside[(self.ends - self.sizes)[long]] += 1
        inside[self.ends[long] - WINDOW + 1] -= 1
        inside = np.cumsum(inside, dtype=np.int8).astype(bool)
        for base in range(0, n, CHUNK):
            size = min(CHUNK, n - base)
            text = np.zeros(size + WINDOW + 24, np.uint8)
            own = self.text[base : base + size + WINDOW]
            text[: len(own)] = own
            eight = np.ndarray((size + WINDOW + 8,), "<u8", text, strides=(1,))  # eight bytes from each place on
            many = size + GRAMS
            with np.errstate(over="ignore"):
                gram = eight[:many] * ODD + eight[8 : many + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + eight[GRAM - 8 : many + GRAM - 8] * np.uint64(0x165667B19E3779F9)
                gram ^= gram >> np.uint64(32)
                gram *= np.uint64(0xD6E8FEB86659FD93)
                gram ^= gram >> np.uint64(29)
            least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(many, dtype=np.uint64)
            reach = 1
            while 2 * reach <= GRAMS:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            rest = GRAMS - reach
            least = np.minimum(least[: len(least) - rest], least[rest:])[:size]
            anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            fine = inside[base : base + size]
            a = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (fine[1:] != fine[:-1])]))
            b = np.append(a[1:], size) - 1
            a, b = a[fine[a]], b[fine[a]]
            end, whole = b + WINDOW - GRAM, gram[a]
            with np.errstate(over="ignore"):
                for step in range(GRAM, WINDOW + GRAMS, GRAM):
                    whole = mix(whole) * ODD + gram[np.minimum(a + step, end)]
                whole = mix(whole) + (b - a).astype(np.uint64)
            parts.append((gram[anchor[a]], whole, a + base, b + base, anchor[a] + base))
        if not parts:
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, place, "right")


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """Parts of hashes, in their order."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


# ---------------------------------------------------------------- which anchors are shared

SHARED, MANY = 1, 2


def _anchors(lots: DataFrame, parts: int) -> DataFrame:
    """(part, lot, keys, flags): the anchors of a lot, by hash; flags: different items, and 128 if two documents have it."""

    def run(it):
        for b in it:
            for r in b.to_pylist():
                lot = Lot(r["ids"], r["nulls"], r["sizes"], r["texts"])
                key, whole, first, _, _ = lot.groups()
                if not len(key):
                    continue
                order = np.lexsort((whole, key))
                key, whole, doc = key[order], whole[order], lot.document(first[order])
                head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                other = np.concatenate([[True], (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])])
                different = np.minimum(np.add.reduceat(other.astype(np.int64), head), 127)
                two = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
                key, flags = key[head], (different + 128 * two).astype(np.uint8)
                bounds = np.searchsorted(_part(key, parts), np.arange(parts + 1))
                at = np.flatnonzero(np.diff(bounds))
                short = (key >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]  # less of a hash finds more to be shared
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array([r["lot"]] * len(at), pa.int64()), pa.array([short[bounds[p] : bounds[p + 1]].T.tobytes() for p in at], pa.binary()), pa.array([flags[bounds[p] : bounds[p + 1]].tobytes() for p in at], pa.binary())],
                    names=["part", "lot", "keys", "flags"],
                )

    return lots.select("lot", "ids", "nulls", "sizes", "texts").mapInArrow(task(run), "part int, lot bigint, keys binary, flags binary")


def _shared(table: pa.Table) -> pa.Table:
    """For all anchors of a part: a byte for each of a lot's, 0 if one document has it alone."""
    rows = table.to_pylist()
    flags = [np.frombuffer(r["flags"], np.uint8) for r in rows]
    key = np.concatenate([np.pad(np.frombuffer(r["keys"], np.uint8).reshape(5, -1).T, ((0, 0), (0, 3))).copy().view("<u8").ravel() for r in rows])
    flag = np.concatenate(flags)
    order = np.argsort(key)
    key, flag = key[order], flag[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = np.diff(np.append(head, len(key)))
    shared = (many > 1) | (np.maximum.reduceat(flag, head) >= 128)
    different = np.add.reduceat((flag & 127).astype(np.int64), head)
    code = np.empty(len(key), np.uint8)
    code[order] = np.repeat(np.where(shared, np.where(different > HOT, MANY, SHARED), 0), many)
    cut = np.split(code, np.cumsum([len(x) for x in flags])[:-1])
    del key, flag, order, shared, different, many, head
    tidy()
    keep = [k for k, x in enumerate(cut) if x.any()]
    return pa.Table.from_arrays([pa.array([rows[k]["lot"] for k in keep], pa.int64()), pa.array([rows[k]["part"] for k in keep], pa.int32()), pa.array([_small(cut[k].tobytes()) for k in keep], pa.binary())], names=["lot", "part", "codes"])


# ---------------------------------------------------------------- runs


def _grouped(lot: Lot, key, whole, first, last, anchor) -> np.ndarray:
    """Rows of ``WIDTH`` bytes: kind 0, suffix from the anchor, bytes before it backwards, and behind them the places (and 1) of the anchor in the first and in the last window."""
    out = np.zeros((len(first), WIDTH), np.uint8)
    column = np.arange(WIDTH - 1, dtype=np.int64)
    for k in range(0, len(first), ROWS):
        a, o1, o2 = anchor[k : k + ROWS, None], (anchor - first)[k : k + ROWS, None], (anchor - last)[k : k + ROWS, None]
        right = WINDOW - o2
        at = np.where(column < right, a + column, a - 1 - column + right)
        rows = np.where(column < right + o1, lot.text[np.clip(at, 0, len(lot.text) - 1)], 0).astype(np.uint8)
        np.put_along_axis(rows, right + o1, (o1 + 1).astype(np.uint8), 1)
        np.put_along_axis(rows, right + o1 + 1, (o2 + 1).astype(np.uint8), 1)
        out[k : k + ROWS, 1:] = rows
    return out


def _single(lot: Lot, start: np.ndarray) -> np.ndarray:
    """Rows of ``WIDTH`` bytes: kind 1, hash of the window, window."""
    out = np.zeros((len(start), WIDTH), np.uint8)
    out[:, 0] = 1
    for k in range(0, len(start), ROWS):
        rows = np.zeros((len(start[k : k + ROWS]), 56), np.uint8)
        rows[:, :WINDOW] = lot.text[start[k : k + ROWS, None] + np.arange(WINDOW)]
        key = np.zeros(len(rows), np.uint64)
        with np.errstate(over="ignore"):
            for x in rows.view("<u8").T:
                key = mix(key + x) * ODD
        out[k : k + ROWS, 1:9] = mix(key).astype(">u8").view(np.uint8).reshape(-1, 8)
        out[k : k + ROWS, 9 : 9 + WINDOW] = rows[:, :WINDOW]
    return out


class Run:
    """Items of a task on their way to a sorted run."""

    def __init__(self):
        self.rows, self.doc, self.lot, self.place, self.ids, self.nulls, self.lots = ([] for _ in range(7))
        self.items = self.docs = 0

    def add(self, number: int, lot: Lot, rows: np.ndarray, place: np.ndarray, start: np.ndarray) -> None:
        self.rows.append(rows)
        self.doc.append(lot.document(start) + self.docs)
        self.lot.append(np.full(len(rows), len(self.lots)))
        self.place.append(place)
        self.items += len(rows)

    def close(self, number: int, lot: Lot) -> None:
        """No more items of this lot."""
        self.ids.append(lot.ids)
        self.nulls.append(lot.nulls)
        self.lots.append(number)
        self.docs += len(lot.ids)

    def packets(self, splitters: np.ndarray, parts: int):
        """The run, sorted, front-coded and cut at the splitters, and what is known to be repeated already."""
        ids, nulls, doc = np.concatenate(self.ids), np.concatenate(self.nulls), np.concatenate(self.doc)
        order = np.lexsort((ids, nulls))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (ids[order][1:] != ids[order][:-1]) | (nulls[order][1:] != nulls[order][:-1])]))
        rows, lot, place = np.concatenate(self.rows), np.concatenate(self.lot), np.concatenate(self.place)
        self.rows = []
        order = np.argsort(rank[doc], kind="stable")
        order = order[np.argsort(rows.view(f"S{WIDTH}").ravel()[order], kind="stable")]
        rows, doc, lot, place = rows[order], doc[order], lot[order], place[order]
        prefix = np.zeros(len(rows), np.int64)
        for k in range(1, len(rows), ROWS):
            differs = rows[k : k + ROWS] != rows[k - 1 : k - 1 + len(rows[k : k + ROWS])]
            prefix[k : k + ROWS] = np.where(differs.any(1), differs.argmax(1), WIDTH)
        head = prefix < WIDTH
        head[0] = True
        lead = np.flatnonzero(head)
        item = np.cumsum(head) - 1
        later = rank[doc] > rank[doc][lead][item]
        first = np.flatnonzero(~later)
        size = WIDTH - (rows[lead][:, ::-1] != 0).argmax(1)
        single = rows[lead, 0] == 1
        size[single] = 9 + WINDOW
        part = np.empty(len(lead), np.int64)
        n = int((~single).sum())  # items of kind 0 come first
        part[:n] = np.searchsorted(splitters, np.ascontiguousarray(rows[lead[:n], 1 : 1 + GRAM]).view(f"S{GRAM}").ravel(), "right")
        part[n:] = _part(np.ascontiguousarray(rows[lead[n:], 1:9]).view(">u8").ravel().astype(np.uint64), parts)
        bounds = [np.searchsorted(x, np.arange(parts + 1)) for x in (part[:n], part[n:])]
        many = np.bincount(item[first], minlength=len(lead))
        at = np.cumsum(many) - many
        lots, column = np.array(self.lots, np.int64), np.arange(WIDTH)
        out = {x.split()[0]: [] for x in PACKET.split(", ")}

        def put(*cells):
            for name, x in zip(out, cells, strict=True):
                out[name].append(x)

        for p in np.unique(part):
            own = np.concatenate([np.arange(bounds[0][p], bounds[0][p + 1]), np.arange(bounds[1][p], bounds[1][p + 1]) + n])
            shared = prefix[lead[own]].copy()
            shared[0] = 0
            if bounds[0][p + 1] - bounds[0][p] < len(own):
                shared[bounds[0][p + 1] - bounds[0][p]] = 0  # the first of kind 1
            text = rows[lead[own]]
            tails = text[(column >= shared[:, None]) & (column < size[own][:, None])]
            which = first[np.repeat(at[own] - (np.cumsum(many[own]) - many[own]), many[own]) + np.arange(int(many[own].sum()))]
            used, short = np.unique(lot[which], return_inverse=True)
            put(
                int(p), False, len(own), shared.astype("u1").tobytes(), size[own].astype("u1").tobytes(), _small(tails.tobytes()), _small(ids[doc[lead[own]]].tobytes()), _small(nulls[doc[lead[own]]].tobytes()),
                _small(many[own].astype("<u4").tobytes()), lots[used].tobytes(), _small(short.astype("<u4").tobytes()), _small(place[which].astype("<u4").tobytes()), b"",
            )
        known = np.flatnonzero(later)
        text = rows[known]
        tail = size[item[known]]
        one = single[item[known]]
        o1, o2 = (text[np.arange(len(known)), tail - x].astype(np.int64) - 1 for x in (2, 1))
        start, count = np.where(one, place[known], place[known] - o1), np.where(one, 1, o1 - o2 + 1)
        for x in np.unique(lot[known]):  # dealt by lot, as their items' part has nothing to add
            own = np.flatnonzero(lot[known] == x)
            put(int(lots[x] % parts), True, len(own), b"", b"", b"", b"", b"", b"", lots[x : x + 1].tobytes(), b"", _small(start[own].astype("<u4").tobytes()), _small(count[own].astype("u1").tobytes()))
        kinds = [pa.int32(), pa.bool_(), pa.int64(), *[pa.binary()] * 10]
        for k in range(0, len(out["part"]), 64):
            yield pa.RecordBatch.from_arrays([pa.array(v[k : k + 64], t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


def _runs(lots: DataFrame, codes: DataFrame, splitters: np.ndarray, parts: int, run_items: int) -> DataFrame:
    by_lot = codes.groupBy("lot").agg(F.collect_list(F.struct("part", "codes")).alias("codes"))
    both = lots.select("lot", "ids", "nulls", "sizes", "texts").join(by_lot.hint("shuffle_hash"), "lot")

    def run(it):
        own = Run()
        for b in it:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                lot = Lot(r["ids"], r["nulls"], r["sizes"], r["texts"])
                key, whole, first, last, anchor = lot.groups()
                keys, at = np.unique(key, return_inverse=True)
                bounds = np.searchsorted(_part(keys, parts), np.arange(parts + 1))
                code = np.zeros(len(keys), np.uint8)
                for x in r["codes"]:
                    code[bounds[x["part"]] : bounds[x["part"] + 1]] = _array(x["codes"], np.uint8)
                code = code[at]
                take = np.flatnonzero(code == SHARED)
                for k in range(0, len(take), run_items):
                    t = take[k : k + run_items]
                    own.add(r["lot"], lot, _grouped(lot, key[t], whole[t], first[t], last[t], anchor[t]), anchor[t], first[t])
                take = np.flatnonzero(code == MANY)
                many = (last - first + 1)[take]
                start = np.repeat(first[take] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                own.add(r["lot"], lot, _single(lot, start), start, start)
                own.close(r["lot"], lot)
                if own.items >= run_items:
                    yield from own.packets(splitters, parts)
                    own = Run()
        if own.items:
            yield from own.packets(splitters, parts)

    return both.mapInArrow(task(run), PACKET)


# ---------------------------------------------------------------- the merge


class Piece:
    """A front-coded run, read string by string."""

    def __init__(self, r: dict):
        self.prefixes, self.sizes = r["prefixes"], r["sizes"]
        self.tails, self.at, self.item = zstandard.decompress(r["tails"]), 0, -1
        self.ids, self.nulls = _array(r["ids"], np.int64).tolist(), _array(r["nulls"], np.uint8).tolist()
        self.many = _array(r["many"], "<u4").astype(np.int64)
        self.lots, self.which, self.places = np.frombuffer(r["lots"], np.int64), _array(r["which"], "<u4"), _array(r["places"], "<u4").astype(np.int64)
        self.text: bytes | None = b""

    def advance(self) -> int:
        """On to the next string; how many bytes it shares with the one before (-1 at the end)."""
        self.item += 1
        if self.item == len(self.sizes):
            self.text = None
            return -1
        shared = self.prefixes[self.item]
        end = self.at + self.sizes[self.item] - shared
        self.text = self.text[:shared] + self.tails[self.at : end]
        self.at = end
        return shared


def merged(pieces: list[Piece]):
    """(bytes shared with the string before, piece) in sorted order, by a loser tree; the piece stands at the string."""
    n = len(pieces)
    shared = [p.advance() for p in pieces]  # with the last string taken, of which there is none yet
    tree = [0] * n  # losers; tree[0]: the winner

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser. The longer shared prefix wins; only what lies behind equal ones is compared."""
        x, y = shared[a], shared[b]
        if x > y:
            return a, b
        if x < y:
            return b, a
        if x < 0:
            return a, b
        s, t = pieces[a].text, pieces[b].text
        m, n = len(s), len(t)
        end = m if m < n else n
        while x < end and s[x] == t[x]:
            x += 1
        if x == m or x < n and s[x] < t[x]:
            shared[b] = x
            return a, b
        shared[a] = x
        return b, a

    winners = [*[0] * n, *range(n)]
    for node in range(n - 1, 0, -1):
        winners[node], tree[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if n > 1 else 0
    while shared[best] >= 0:
        p = pieces[best]
        yield shared[best], p
        shared[best] = p.advance()
        node = (best + n) >> 1
        while node:
            best, tree[node] = play(best, tree[node])
            node >>= 1


class Found:
    """Windows of items that are repeats: piece by piece, the item, how far the first one is before the item's place, and how many."""

    def __init__(self, pieces: list[Piece]):
        self.rows = {id(p): (array("q"), array("q"), array("q")) for p in pieces}

    def add(self, piece: Piece, item: int, before: int, count: int) -> None:
        for x, v in zip(self.rows[id(piece)], (item, before, count), strict=True):
            x.append(v)

    def places(self, piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lot, first start, how many)"""
        item, before, count = (np.array(x, np.int64) for x in self.rows[id(piece)])
        many = piece.many[item]
        at = np.repeat((np.cumsum(piece.many) - piece.many)[item] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return piece.lots[piece.which[at]], piece.places[at] - np.repeat(before, many), np.repeat(count, many)


def _settle(block: list[tuple[bytes, list[tuple]]], found: Found) -> None:
    """The items of one anchor: (string, [(null id, id, piece, item)])."""
    if len(block) == 1:
        text, members = block[0]
        if len(members) > 1:
            least = min(m[:2] for m in members)
            before, count = (0, 1) if text[0] else (text[-2] - 1, text[-2] - text[-1] + 1)
            for null, doc, piece, item in members:
                if (null, doc) > least:
                    found.add(piece, item, before, count)
        return
    first: dict[bytes, tuple] = {}
    windows = []
    for text, members in block:
        before, behind = text[-2] - 1, WINDOW - text[-1] + 1
        whole = text[1 + behind : -2][::-1] + text[1 : 1 + behind]
        own = [whole[k : k + WINDOW] for k in range(len(whole) - WINDOW + 1)]
        windows.append((before, own))
        least = min(m[:2] for m in members)
        for w in own:
            if w not in first or least < first[w]:
                first[w] = least
    for (before, own), (_, members) in zip(windows, block, strict=True):
        seen = [first[w] for w in own]
        for null, doc, piece, item in members:
            begin = None
            for k, x in enumerate([*seen, None]):
                if x is not None and x < (null, doc):
                    begin = k if begin is None else begin
                elif begin is not None:
                    found.add(piece, item, before - begin, k - begin)
                    begin = None


def _merge(table: pa.Table) -> pa.Table:
    """All pieces of a part: which windows stand in a smaller document."""
    rows = table.to_pylist()
    pieces = [Piece(r) for r in rows if not r["known"]]
    out = [(np.full(r["items"], np.frombuffer(r["lots"], np.int64)[0]), _array(r["places"], "<u4").astype(np.int64), _array(r["counts"], "u1").astype(np.int64)) for r in rows if r["known"]]
    found = Found(pieces)
    if pieces:
        block: list[tuple[bytes, list[tuple]]] = []
        for shared, p in merged(pieces):
            text, member = p.text, (p.nulls[p.item], p.ids[p.item], p, p.item)
            if block and shared == len(text):
                block[-1][1].append(member)
            elif block and shared > GRAM and not text[0]:
                block.append((text, [member]))
            else:
                _settle(block, found) if block else None
                block = [(text, [member])]
        _settle(block, found)
        out += [found.places(p) for p in pieces]
    del rows, pieces, found
    tidy()
    if not out:
        out = [(np.zeros(0, np.int64),) * 3]
    lot, start, count = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((start, lot))
    lot, start, count = lot[order], start[order], count[order]
    head = np.flatnonzero(np.concatenate([[True], lot[1:] != lot[:-1]])) if len(lot) else np.zeros(0, np.int64)
    bounds = np.append(head, len(lot))
    cut = lambda x, kind: pa.array([_small(x[a:b].astype(kind).tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
    return pa.Table.from_arrays([pa.array(lot[head]), cut(start, "<u4"), cut(count, "u1")], names=["lot", "starts", "counts"])


# ---------------------------------------------------------------- the whole


def _splitters(lots: DataFrame, n_lots: int, parts: int) -> np.ndarray:
    """Strings of the texts that cut their order into ``parts`` parts of about one size."""
    rare = max(1, n_lots * SAMPLE // max(20_000, 4 * parts))
    rows = lots.where(F.pmod(F.xxhash64("lot"), F.lit(rare)) == 0).select("sample").collect()
    grams = np.sort(np.frombuffer(b"".join(r.sample for r in rows), f"S{GRAM}"))
    return np.unique(grams[len(grams) * np.arange(1, parts) // parts]) if len(grams) else grams


def deduplicated(docs: DataFrame, lot_bytes: int = LOT_BYTES, run_items: int = RUN_ITEMS, parts: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes, a row per row of ``docs``."""
    spark = docs.sparkSession
    lots = staged(in_lots(docs, lot_bytes), "lots")
    n_lots, total = lots.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    codes = staged(_anchors(lots, parts).groupBy("part").applyInArrow(_shared, "lot bigint, part int, codes binary"), "anchors")
    splitters = _splitters(lots, n_lots, parts)
    verdicts = staged(_runs(lots, codes, splitters, parts, run_items).groupBy("part").applyInArrow(_merge, VERDICT), "verdicts")
    discard(codes)
    by_lot = verdicts.groupBy("lot").agg(F.collect_list(F.struct("starts", "counts")).alias("found"))

    def cut(it):
        for b in it:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                lot = Lot(r["ids"], r["nulls"], r["sizes"], r["texts"])
                n = len(lot.text)
                depth = np.zeros(n + 1, np.int32)
                for x in r["found"] or []:
                    start, count = _array(x["starts"], "<u4").astype(np.int64), _array(x["counts"], "u1")
                    np.add.at(depth, start, 1)
                    np.add.at(depth, start + count + WINDOW - 1, -1)
                gone = np.cumsum(depth[:n]) > 0
                begin = lot.ends - lot.sizes
                edge = gone & ~np.concatenate([[False], gone[:-1]]) if n else gone
                edge[begin[(lot.sizes > 0)]] = gone[begin[(lot.sizes > 0)]]
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.append(begin, n)])  # noqa: E731, B023
                removed, spans = total(gone), total(edge)
                kept = [lot.text[a:z][~gone[a:z]].tobytes() if m else lot.text[a:z].tobytes() for a, z, m in zip(begin.tolist(), lot.ends.tolist(), removed.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lot.ids, mask=lot.nulls), pa.array(lot.sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    both = lots.select("lot", "ids", "nulls", "sizes", "texts").join(by_lot.hint("shuffle_hash"), "lot", "left")
    return both.mapInArrow(task(cut), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
v AS (SELECT doc_id, s, substr(x, 2 * s + 1, 100) AS t FROM (SELECT *, unnest(range(n - 49)) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY t) AS least FROM v) WHERE least < doc_id),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM r)),
g AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM i GROUP BY doc_id, span),
k AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM g),
p AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS gone, count(*) AS spans FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)"""
