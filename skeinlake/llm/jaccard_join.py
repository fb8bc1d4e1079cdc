"""N-gram Jaccard join with vertical partitioning, and the groups it makes.

Classes: documents with equal shingle sets are one class, and only one of them
is looked at; the others are members. One pass over the texts leaves each
document's class, set size, ``low`` part (its shingles of the lowest ``LOW`` of
the hash space, and further ones if the prefix needs them) and parity bits.

Global order: the plain shingles of the low part by the number of classes that
hold them, then its hot ones (at most 2**19, so their broadcast is bounded) by
count, then the rest by hash. Plain counts are taken in fragments of the hash
space whose number follows from the bytes to be counted; a shingle that many
documents share is hot, so no fragment gets it.

Candidates: two sets of similarity 0.75 or more share a shingle among the
first n - ceil(0.75 n) + 1 of each. Prefix shingles that no other class holds
lead nowhere, and of shingles that the same classes hold one is enough, so what is
left are few postings (shingle, class). Rounds:

1. stars: each shingle's classes are paired with the least of them;
2. shingles whose classes still lie in several components: a forest over the
   likely pairs between components;
3. of the shingles where that forest left a likely pair out, and of those of their classes
   that are in one: all likely pairs that still lie between components.

Every pair of a shingle's classes that could be similar is so either verified or
inside one component. Rounds 2 and 3 compare classes in numpy, in blocks of
``BLOCK`` by ``BLOCK`` classes, so that a shingle of many classes is many tasks,
and only likely pairs leave a block: a shingle sits at one of the parity bits, so
two sets differ in as many shingles as their bits do at least, which is an
exact filter and a close one.

Verification: the hash space is cut into ``VERTICAL`` fragments, overlaps are
counted in each apart and summed per pair. A set travels once for each
pivot and fragment, sorted behind the pivot's, so a task holds one pivot's part;
pivots of many classes are salted.

Defined results: null and empty texts have no shingles, no links, and their own
component; rows that share a doc_id are one document with the links of any of
its rows; rows without doc_id are one document for each distinct text, whose
component_id is null unless a document with an id is reachable; equal texts
link; empty tables give empty results; other columns travel along in
``one_of_each`` and are ignored elsewhere.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, components, discard, plain_names, shingle_hashes, slices, staged, task

WIDTH, PERCENT = 5, 75
#: Shingles that can be hot at most, and the least count of one.
HOT, LEAST_HOT = 1 << 19, 16
VERTICAL = 2
#: Part of the hash space that is low, in 64ths.
LOW = 26
#: Bytes of shingles that one fragment counts, about.
FRAGMENT_BYTES = 16 << 20
BATCH_SHINGLES = 1_000_000
#: Classes of a pivot that one task verifies, about.
SALT = 2000
#: Classes of a shingle that one task compares with as many others.
BLOCK = 2000
#: Bits of the filter that keeps texts no pair asks for out of a shuffle: 2 MB, whatever the number of pairs.
BITS = 1 << 24
#: Nodes from here on stand for texts without an id.
NO_ID, NODE = 1 << 63, "decimal(20,0)"

_HASHES = WordHashes()
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return np.unique(shingle_hashes(_HASHES.of(text.encode("utf-8", "surrogatepass").translate(_LOWER).split()), WIDTH))


def similar(n0, n1, both):
    return 100 * both >= PERCENT * (n0 + n1 - both)


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def node() -> Column:
    """doc_id, or a number above all of them that stands for a text without one. Wider than 64 bits, so that both have all of their range."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    return F.coalesce(F.col("doc_id").cast("bigint").cast(NODE), (h.cast(NODE) + F.expr(f"{2 * NO_ID}BD")).cast(NODE))


def class_of(s: np.ndarray, own: Decimal) -> int:
    """The class of a shingle set; an empty one is a class of its document only."""
    raw = s.tobytes() if len(s) else b"-%d" % own
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64))


def parity(s: np.ndarray, times: int = 1) -> np.ndarray:
    """A bit for each residue of the hashes: whether an odd number of them has it. As many bits as shingles, about, or that many times."""
    n = times << min(20, max(8, int(len(s)).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, n_bytes: int) -> np.ndarray:
    """The parity bits for fewer residues."""
    return np.bitwise_xor.reduce(bits.reshape(-1, n_bytes), 0)


def _below(s: np.ndarray, part: int) -> int:
    return int(np.searchsorted(s, np.uint64(part << 58)))


#: Bits of ``fine`` for each of ``bits``.
FINE = 8
PARTS = f"node {NODE}, doc_id bigint, c bigint, n int, low binary, bits binary, fine binary"


def low_parts(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: node, doc_id, class c, n (shingles of the document), low part and parity bits."""

    def run(it):
        for b in slices(it):
            cells = {x: [] for x in ("c", "n", "low", "bits", "fine")}
            for own, t in zip(b.column("node").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingles(t)
                cells["c"].append(class_of(s, own))
                cells["n"].append(len(s))
                cells["low"].append(s[: max(_below(s, LOW), prefix_size(len(s)) if len(s) else 0)].tobytes())
                fine = parity(s, FINE)
                cells["bits"].append(folded(fine, len(fine) // FINE).tobytes())
                cells["fine"].append(fine.tobytes())
            kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("doc_id"), *(pa.array(v, k) for v, k in zip(cells.values(), kinds, strict=True))], names=["node", "doc_id", *cells])

    rows = docs.select(node().alias("node"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(task(run), PARTS)


# ---------------------------------------------------------------- the order and the prefixes


def _lots(it):
    """Lots of (classes, sizes, low parts)."""
    cs, sizes, lows, total = [], [], [], 0
    for b in it:
        for c, n, low in zip(b.column("c").to_pylist(), b.column("n").to_pylist(), b.column("low"), strict=True):
            cs.append(c)
            sizes.append(n)
            lows.append(np.frombuffer(low.as_py(), np.uint64))
            total += len(lows[-1])
            if total >= BATCH_SHINGLES:
                yield cs, sizes, lows
                cs, sizes, lows, total = [], [], [], 0
    if cs:
        yield cs, sizes, lows


def hot_shingles(reps: DataFrame, total: int) -> np.ndarray:
    """Hashes of the hot shingles by count, rarest first. Counted are those that a lot holds twice or more."""

    def count(it):
        for _, _, lows in _lots(it):
            found, n = np.unique(np.concatenate(lows), return_counts=True)
            some = (n > 1) & (found < np.uint64(LOW << 58))
            yield pa.RecordBatch.from_arrays([pa.array(found[some].view(np.int64)), pa.array(n[some])], names=["shingle", "n"])

    counts = reps.select("c", "n", "low").mapInArrow(task(count), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= max(LEAST_HOT, -(-total // HOT))).toArrow()  # HOT at most, as they add up to the total at most
    shingle, n = rows.column("shingle").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    return shingle[np.lexsort((shingle, n))]


class Split:
    """Takes the hot shingles out of low parts."""

    def __init__(self, hot: np.ndarray):
        self.rank = np.argsort(hot)
        self.hot = hot[self.rank]

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(plain shingles, what comes behind them in the order)."""
        k = _below(s, LOW)
        own, rest = s[:k], s[k:]
        if not len(self.hot):
            return own, rest
        i = np.minimum(np.searchsorted(self.hot, own), len(self.hot) - 1)
        hot = self.hot[i] == own
        return own[~hot], np.concatenate([own[hot][np.argsort(self.rank[i[hot]], kind="stable")], rest])


def _counted(table: pa.Table) -> pa.Table:
    """(c, key, df) of a fragment's shingles that several classes hold."""
    keys, classes = [], []
    for k, m, c in zip(*(table.column(x) for x in ("keys", "many", "classes")), strict=True):
        keys.append(np.frombuffer(k.as_py(), np.uint64))
        classes.append(np.repeat(np.frombuffer(c.as_py(), np.int64), np.frombuffer(m.as_py(), "<u4")))
    key, c = np.concatenate(keys), np.concatenate(classes)
    del keys, classes
    order = np.argsort(key, kind="stable")
    key, c = key[order], c[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    df = np.repeat(*[np.diff(np.append(begin, len(key)))] * 2)
    some = df > 1
    return pa.Table.from_arrays([pa.array(c[some]), pa.array(key[some].view(np.int64)), pa.array(df[some].astype(np.int32))], names=["c", "key", "df"])


def postings(reps: DataFrame) -> DataFrame:
    """(key, c, n): prefix shingles that may lead to another class, and the sizes of the classes that hold them."""
    spark = reps.sparkSession
    total = reps.agg(F.sum(F.octet_length("low"))).first()[0] or 0
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FRAGMENT_BYTES))
    shared = spark.sparkContext.broadcast(hot_shingles(reps, total // 8))

    def packets(it):
        split = Split(shared.value)
        for cs, _, lows in _lots(it):
            plain = [split(s)[0] for s in lows]
            key, who = np.concatenate(plain), np.repeat(np.arange(len(cs)), [len(s) for s in plain])
            frag = ((key >> np.uint64(20)) % np.uint64(fragments)).astype(np.int64)
            order = np.argsort(frag, kind="stable")
            at = np.searchsorted(frag[order], np.arange(fragments + 1))
            classes = np.array(cs, np.int64)
            for f in np.flatnonzero(np.diff(at)):
                own = order[at[f] : at[f + 1]]
                few, many = np.unique(who[own], return_counts=True)
                cells = [key[own].tobytes(), many.astype("<u4").tobytes(), classes[few].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32())] + [pa.array([x], pa.binary()) for x in cells], names=["frag", "keys", "many", "classes"])

    def sizes(it):
        split = Split(shared.value)
        for b in slices(it):
            plain, extra = [], []
            for n, low in zip(b.column("n").to_pylist(), b.column("low"), strict=True):
                own, behind = split(np.frombuffer(low.as_py(), np.uint64))
                plain.append(len(own))
                extra.append(behind[: max(0, prefix_size(n) - len(own))].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("n"), pa.array(plain, pa.int32()), pa.array(extra, pa.list_(pa.int64()))], names=["c", "n", "plain", "extra"])

    low = reps.select("c", "n", "low")
    counted = low.mapInArrow(task(packets), "frag int, keys binary, many binary, classes binary").groupBy("frag").applyInArrow(_counted, "c bigint, key bigint, df int")
    several = counted.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("s"))  # of one document
    facts = low.mapInArrow(task(sizes), "c bigint, n int, plain int, extra array<bigint>").join(several, "c", "left")
    s = F.coalesce("s", F.array().cast("array<struct<df:int,key:bigint>>"))
    # those that one class holds come first
    left = F.expr(f"n - ({PERCENT} * n + 99) div 100 + 1").cast("int") - (F.col("plain") - F.size(s))
    keys = F.concat(F.transform(F.slice(s, F.lit(1), F.greatest(left, F.lit(0))), lambda x: x["key"]), F.col("extra"))
    out = staged(facts.select(F.explode(keys).alias("key"), "c", "n"), "postings")
    shared.unpersist()
    return out


# ---------------------------------------------------------------- pairs


def one_for_each_set(lists: DataFrame) -> DataFrame:
    """``lists`` with the least key of those that the same classes hold, and without keys of one class.

    A passage that classes share gives as many keys as it has shingles, all of the same classes, and they lead to the same
    pairs. Sets are compared by their size and two 64-bit hashes.
    """
    sets = lists.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y")).where("m > 1")
    return lists.join(sets.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def stars(lists: DataFrame) -> DataFrame:
    """(a, b): each shingle's classes with the least of them, if their sizes can be similar."""
    least = lists.groupBy("key").agg(F.min(F.struct("c", "n")).alias("p"), F.max("c").alias("z")).where("p.c < z").select("key", "p")
    n0, n1 = F.col("p.n"), F.col("n")
    fits = (F.col("c") != F.col("p.c")) & (100 * F.least(n0, n1) >= PERCENT * F.greatest(n0, n1))
    return lists.join(least, "key").where(fits).select(F.col("p.c").alias("a"), F.col("c").alias("b")).distinct()


def most_apart(n0, n1):
    """The largest symmetric difference of similar sets."""
    return n0 + n1 - 2 * -(-PERCENT * (n0 + n1) // (100 + PERCENT))


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose parity bits let them be similar."""

    def run(it):
        for b in slices(it, 2000):
            ok = []
            for x, y, n0, n1 in zip(b.column("bits0"), b.column("bits1"), b.column("n0").to_pylist(), b.column("n1").to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
                k = min(len(x), len(y))
                ok.append(int(np.bitwise_count(folded(x, k) ^ folded(y, k)).sum()) <= most_apart(n0, n1))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda k, end: reps.select(F.col("c").alias(end), F.col("bits").alias(f"bits{k}"), F.col("n").alias(f"n{k}"))
    return pairs.join(side(0, "a"), "a").join(side(1, "b"), "b").select("a", "b", "bits0", "bits1", "n0", "n1").mapInArrow(task(run), "a bigint, b bigint")


class Group:
    """The classes of a block: likely pairs between their components."""

    def __init__(self, c: np.ndarray, n: np.ndarray, comp: np.ndarray, part: np.ndarray, bits: list[bytes]):
        self.c, self.n, self.part = c, n.astype(np.int64), part
        self.label = np.unique(comp, return_inverse=True)[1]
        self.bits = [np.frombuffer(x, np.uint8) for x in bits]

    def pairs(self, forest: bool, two_parts: bool) -> tuple[np.ndarray, bool]:
        """(2, n) of classes, and whether a likely pair was left out: a ``forest`` joins only what earlier pairs have not joined. ``near``: its classes of likely pairs."""
        size = np.array([len(x) for x in self.bits])
        label, out, less, near = self.label.copy(), [], False, np.zeros(len(self.c), bool)
        for k in np.unique(size):
            longer = np.flatnonzero(size >= k)
            matrix = np.stack([folded(self.bits[i], k) for i in longer]).view(np.uint64)
            first_label, theirs_label = self.label, self.label[longer]
            n1, part = self.n[longer], self.part[longer]
            for row, i in enumerate(longer):
                if size[i] != k:
                    continue
                n0 = self.n[i]
                ok = (theirs_label != first_label[i]) & ((size[longer] > k) | (longer > i)) & (100 * np.minimum(n0, n1) >= PERCENT * np.maximum(n0, n1))
                if two_parts:
                    ok &= part != self.part[i]
                at = np.flatnonzero(ok)
                at = at[np.bitwise_count(matrix[at] ^ matrix[row]).sum(1) <= most_apart(n0, n1[at])]
                if forest and len(at):
                    near[i] = near[longer[at]] = True
                    theirs, first = np.unique(label[longer[at]], return_index=True)
                    new = theirs != label[i]
                    less |= int(new.sum()) < len(at)
                    at = at[first[new]]
                    label[np.isin(label, theirs)] = label[i]
                out.append(np.stack([np.full(len(at), self.c[i]), self.c[longer[at]]]))
        self.near = self.c[near]
        return np.sort(np.concatenate(out, 1), axis=0), less


def _first_common(a: pa.Scalar, b: pa.Scalar) -> int:
    return int(np.intersect1d(a.values.to_numpy(), b.values.to_numpy(), assume_unique=True)[0])


def between(lists: DataFrame, comps: DataFrame, bits: DataFrame, forest: bool) -> DataFrame:
    """(a, b, key): likely pairs of classes of one shingle that lie in different components; where a forest left one out, every class a of a likely pair and its key, without b.

    bits: (c, bits). A forest's pairs may be repeated, as several shingles lead to them; others are made at the least shingle of both only.
    """
    each = lists.join(comps.withColumnRenamed("node", "c"), "c", "left").select("key", "c", "n", F.coalesce("root", "c").alias("comp"))
    several = each.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("lo < hi").select("key", "parts")
    open_ = each.join(several, "key").join(bits, "c")
    mine = F.array().cast("array<bigint>")
    if not forest:
        open_ = open_.join(lists.groupBy("c").agg(F.sort_array(F.collect_set("key")).alias("mine")), "c")  # of one document
        mine = F.col("mine")
    open_ = open_.withColumn("mine", mine)
    part = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")
    dealt = open_.select("key", "c", "n", "comp", "bits", "mine", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "c", "n", "comp", "part", "bits", "mine")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "c")

    def blocks(it):
        """The rows of one block after the other, as Arrow tables."""
        kept: list[pa.RecordBatch] = []
        for b in it:
            k = [b.column(x).to_numpy() for x in ("key", "x", "y")]
            cut = [0, *(np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if kept and any(kept[0].column(x)[0].as_py() != v[lo] for x, v in zip(("key", "x", "y"), k, strict=True)):
                    yield pa.Table.from_batches(kept)
                    kept = []
                kept.append(b.slice(lo, hi - lo))
        if kept:
            yield pa.Table.from_batches(kept)

    def run(it):
        seen, out, marks, found = set(), [], [], 0

        def batch():
            x = np.unique(np.concatenate([*out, np.zeros((2, 0), np.int64)], 1), axis=1)
            key = [k for k, c in marks for _ in range(len(c))]
            a = np.concatenate([x[0], *(c for _, c in marks)])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(x[1].tolist() + [None] * len(key), pa.int64()), pa.array([None] * x.shape[1] + key, pa.int64())], names=["a", "b", "key"])

        for t in blocks(it):
            c, comp = t.column("c").to_numpy(), t.column("comp").to_numpy()
            if len(c) < 2 or (comp == comp[0]).all():
                continue
            two = t.column("x")[0].as_py() != t.column("y")[0].as_py()
            own = xxhash.xxh3_64_intdigest(c.tobytes() + b"%d" % two)
            near = c[:0]
            if own not in seen:  # else one of the same classes stands for it
                group = Group(c, t.column("n").to_numpy(), comp, t.column("part").to_numpy(), t.column("bits").to_pylist())
                pairs, less = group.pairs(forest, two)
                near = group.near if less else near
                if not forest:
                    keys = dict(zip(c.tolist(), t.column("mine"), strict=True))
                    here = t.column("key")[0].as_py()
                    first = [_first_common(keys[a], keys[b]) == here for a, b in pairs.T.tolist()]
                    pairs = pairs[:, np.array(first, bool)]
                elif len(seen) < 500_000:
                    seen.add(own)
                out.append(pairs)
                found += pairs.shape[1]
            if len(near):
                marks.append((t.column("key")[0].as_py(), near))
                found += len(near)
            if found > 200_000:
                yield batch()
                out, marks, found = [], [], 0
        if out or marks:
            yield batch()

    return dealt.mapInArrow(task(run), "a bigint, b bigint, key bigint")


# ---------------------------------------------------------------- verification


def _asked(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source`` without most rows whose node is not in ``wanted``; a join has to follow."""
    spark = source.sparkSession
    bit = F.pmod(F.xxhash64("node"), F.lit(BITS))
    x = (bit + 1).alias("x")
    maps = wanted.select(x).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).toArrow()
    bits = np.zeros(BITS // 8, np.uint8)
    for k, own in zip(maps.column("k").to_pylist(), maps.column("bits").to_pylist(), strict=True):
        bits[(k - 1) * len(own) : k * len(own)] = np.frombuffer(own, np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def keep(it):
        for b in it:
            at = b.column("bit").to_numpy()
            some = b.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            if some.num_rows:
                yield some.drop_columns(["bit"])

    return source.withColumn("bit", bit).mapInArrow(task(keep), source.schema)


DEALT = {"a": pa.int64(), "v": pa.int32(), "salt": pa.int32(), "member": pa.bool_(), "c": pa.int64(), "n": pa.int32(), "part": pa.binary()}


def _overlaps(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n0, n1, both): sizes and overlap, for each pair and fragment of the hash space."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select(F.col("b").alias("c"), F.struct("a", "salts", F.lit(True).alias("member")).alias("to"))
    pivots = salts.select(F.col("a").alias("c"), F.struct("a", "salts", F.lit(False).alias("member")).alias("to"))
    wanted = members.union(pivots).groupBy("c").agg(F.collect_list("to").alias("to")).join(classes, "c").select("node", "c", "to")

    def deal(it):
        for batch in slices(it):
            rows = {x: [] for x in DEALT}
            for own, text, c, to in zip(*(batch.column(x).to_pylist() for x in ("node", "text", "c", "to")), strict=True):
                s = shingles(text)
                if class_of(s, own) != c:
                    continue  # another text of the same doc_id
                cut = [0, *(_below(s, 64 * v // VERTICAL) for v in range(1, VERTICAL)), len(s)]
                parts = [s[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)]
                for x in to:
                    for salt in [c % x["salts"]] if x["member"] else range(x["salts"]):
                        for v, part in enumerate(parts):
                            for k, y in zip(rows, (x["a"], v, salt, x["member"], c, len(s), part), strict=True):
                                rows[k].append(y)
                if len(rows["a"]) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[x], k) for x, k in DEALT.items()], names=list(rows))
                    rows = {x: [] for x in DEALT}
            if rows["a"]:
                yield pa.RecordBatch.from_arrays([pa.array(rows[x], k) for x, k in DEALT.items()], names=list(rows))

    base = docs.select(node().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    spread = _asked(base, wanted).join(wanted.hint("shuffle_hash"), "node").mapInArrow(task(deal), "a bigint, v int, salt int, member boolean, c bigint, n int, part binary")
    dealt = spread.repartition("a", "v", "salt").sortWithinPartitions("a", "v", "salt", "member", "c")

    def overlap(it):
        at, pivot, last = None, None, None
        for batch in slices(it, 2000):
            rows = {x: [] for x in ("a", "b", "n0", "n1", "both")}
            for a, v, salt, member, c, n, part in zip(*(batch.column(x).to_pylist() for x in DEALT), strict=True):
                if at != (a, v, salt):
                    at, pivot, last = (a, v, salt), None, None
                own = np.frombuffer(part, np.uint64)
                if not member:
                    pivot = n, own
                elif c != last:  # equal rows of one document are one
                    n0, p = pivot
                    both = int((p[np.minimum(np.searchsorted(p, own), len(p) - 1)] == own).sum()) if len(p) and len(own) else 0
                    for k, x in zip(rows, (a, c, n0, n, both), strict=True):
                        rows[k].append(x)
                    last = c
            if rows["a"]:
                yield pa.RecordBatch.from_arrays([pa.array(rows[x], pa.int64()) for x in rows], names=list(rows))

    return dealt.mapInArrow(task(overlap), ", ".join(f"{x} bigint" for x in ("a", "b", "n0", "n1", "both")))


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs that are similar."""
    whole = _overlaps(docs, classes, pairs).groupBy("a", "b", "n0", "n1").agg(F.sum("both").alias("both"))
    return staged(whole.where(similar(F.col("n0"), F.col("n1"), F.col("both"))).select("a", "b"), "links")


def _links(docs: DataFrame, reps: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root): the component of every class that is similar to another."""
    spark = docs.sparkSession
    every = postings(reps)
    lists = staged(one_for_each_set(every), "postings")
    discard(every)
    comps = spark.createDataFrame([], "node bigint, root bigint")
    links = tried = spark.createDataFrame([], "a bigint, b bigint")
    for turn in ("stars", "forest", "rest"):
        if turn == "stars":
            found = likely(stars(lists), reps)
        else:
            made = staged(between(lists, comps, reps.select("c", "bits" if turn == "forest" else F.col("fine").alias("bits")), turn == "forest"), "between")
            found = made.where("b is not null").select("a", "b").distinct()
        pairs = staged(found.join(tried, ["a", "b"], "left_anti"), "pairs")
        if turn == "forest":
            near = made.where("b is null").select("key", F.col("a").alias("c")).distinct()
            last, lists = lists, staged(one_for_each_set(lists.join(near, ["key", "c"], "left_semi")), "postings")
            discard(last)
        if turn != "stars":
            discard(made)
        if not pairs.isEmpty():
            new = verified(docs, classes, pairs)
            if not new.isEmpty():
                links, last = links.union(new), comps
                comps = components(spark, links, "components")
                discard(last)
        tried = tried.union(pairs)
    discard(lists, tried, links)
    return comps


def groups(docs: DataFrame) -> DataFrame:
    """node, doc_id, n and label, a row per row of ``docs``: the smallest node that links reach."""
    parts = staged(low_parts(docs), "low")
    ids = staged(parts.select("node", "doc_id", "c", "n"), "ids")
    classes = staged(ids.groupBy("c").agg(F.min("node").alias("node")), "classes")
    reps = staged(parts.where("n > 0").groupBy("c").agg(*(F.first(x).alias(x) for x in ("n", "low", "bits", "fine"))), "reps")  # equal in a class
    discard(parts)
    comps = _links(docs, reps, classes)
    # rows that share a doc_id hold their classes' components together
    root = ids.join(comps.withColumnRenamed("node", "c"), "c", "left").select("node", "doc_id", "n", F.coalesce("root", "c").alias("root"))
    rooted = staged(root, "rooted")
    discard(reps, classes, ids, comps)
    twice = rooted.groupBy("node").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("node")
    joins = rooted.join(twice, "node").groupBy("node").agg(F.min("root").alias("a"), F.array_distinct(F.collect_list("root")).alias("bs")).select("a", F.explode("bs").alias("b")).where("a < b")
    joins = staged(joins, "joins")
    if not joins.isEmpty():
        over = components(docs.sparkSession, joins, "over").select(F.col("node").alias("root"), F.col("root").alias("top"))
        rooted = rooted.join(over, "root", "left").select("node", "doc_id", "n", F.coalesce("top", "root").alias("root"))
    discard(joins)
    return rooted.join(rooted.groupBy("root").agg(F.min("node").alias("label")), "root").drop("root")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of ``docs``."""
    label = F.col("label")
    return groups(docs).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(label < F.expr(f"{NO_ID}BD"), label.cast("bigint")).alias("component_id"))


@plain_names
def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that a smaller one of their component stands for."""
    others = groups(docs).where("label < node").select(F.col("node").alias("_node"))
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), node().alias("_node"))
    return rows.join(others.hint("shuffle_hash"), "_node", "left_anti").select(*(F.col("row")[x].alias(x) for x in names))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
