"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code.

Three passes. (1) Texts are encoded with the tokenizers library; what is
encoded are chunks, each remembered: a space that a character other than white
space follows always begins a pre-token, so a text may be cut before it. Each task counts its ids as it goes. (2)
These counts are summed and the ids ranked, commonest first. (3) documents are dealt out by ranges of doc_id,
sorted, and written in blocks: ranks below 2**8, 2**16, 2**24 take one, two,
three bytes, others four; the lengths stand apart as two bits an id in control
bytes. Reading a block back looks control bytes up in a table of lengths,
gathers the data bytes and looks the ids up by rank.

The blocks are the rows of a Parquet folder (payload: magic, counts, doc ids,
control bytes, data bytes), so that Spark's commit protocol covers lost
executors and any Hadoop path works; the rank table is written beside them.
The rank table has as many rows as the vocabulary at most, which bounds the
broadcast; of the blocks, only a sum per written partition reaches the driver.

Defined results: null texts are empty (their only id is the end id); rows
with a null doc_id come after all others; rows that repeat a doc_id follow each
other by text hash; strings of special tokens in a text get the special ids, as in the library's
plain call; empty tables give empty files.
"""

from __future__ import annotations

import codecs
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, discard, keyed, shared_dir, staged

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: ids of a block at least, but for a partition's last one; a document is never split.
BLOCK_IDS = 1_000_000
#: bytes of text that are encoded at once, but for longer texts.
SLICE_BYTES = 4 << 20
_CUT = re.compile(r" (?=\S)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Chunks of these two kinds of characters are two pre-tokens at most: letters (with the space before them), punctuation.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]*)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> str:
    """Byte-level BPE writes each byte as a letter: printable Latin-1 as it is, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


#: What Python takes for white space (the library takes less), and the end of a part.
_SPACES = frozenset(["", *filter(str.isspace, map(chr, range(0x3001)))])


def _unsound(part: str) -> bool:
    """Is empty, or begins or ends with white space."""
    return part[:1] in _SPACES or part[-1:] in _SPACES


class ChunkEncoder:
    """Encodes whole texts by remembered chunks, in memory bounded by ``limit`` bytes.

    Chunks are remembered in two generations: the young one becomes the old
    one when it has half of ``limit``, and chunks of the old one that are met
    again go to the young one, so that common chunks are never forgotten.

    Texts are cut, and their chunks counted off and put together again, as
    Arrow and numpy arrays; Python sees each different chunk of a call once.
    Plain chunks go to the library's BPE model as the pre-tokens they are;
    whatever else is in a text goes through the library's whole pipeline, as
    does a text that holds the string of a special token.
    """

    def __init__(self, path: str, limit: int = 96 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.model = self.t.model
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.limit = limit
        self.code = "H" if self.t.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = "<u2" if self.code == "H" else "<u4"
        self.after: dict[str, bytes] = {}  # what follows a space, which is part of it
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.marks: dict[str, bytes] = {}  # punctuation behind letters, white space before a space
        self.letters = _byte_letters()
        self.newline = self.raw(["\n"])[0]

    def raw(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, part: str, space: str) -> bytes | None:
        if part.isascii() and part.isalpha():
            word, tail = part, ""
        else:
            found = _PLAIN.fullmatch(part)
            if not found:
                return None
            word, tail = found.groups()
        if not word:  # the space belongs to the punctuation
            return self.raw([space + tail])[0]
        ids = (self.after.get(word) or self.old.get(word)) if space and tail else None
        if ids is None:
            if not word.isascii():
                word = codecs.charmap_decode(word.encode(), "strict", self.letters)[0]
            ids = array(self.code, [x.id for x in self.model.tokenize("Ġ" + word if space else word)]).tobytes()
        if not tail:
            return ids
        if tail not in self.marks:
            self._mark(tail)
        return ids + self.marks[tail]

    def _mark(self, text: str) -> None:
        if len(self.marks) > 10_000:
            self.marks.clear()
        self.marks[text] = self.raw([text])[0]

    def part(self, part: str) -> bytes:
        """ids of a space and a part that does not begin with white space."""
        core = part.rstrip(" \n\r\t")
        if len(core) < len(part) and not _unsound(core):  # what is behind it is a pre-token of its own
            gap = part[len(core) :]
            if gap not in self.marks:
                self._mark(gap)
            return (self.after.get(core) or self.old.get(core) or self.part(core)) + self.marks[gap]
        ids = self._plain(part, " ")
        if ids is None and "\n" in part:
            lines = part.split("\n")  # a newline between other characters is a pre-token of its own
            if not any(map(_unsound, lines)):
                each = [self._plain(x, "" if k else " ") for k, x in enumerate(lines)]
                ids = None if None in each else self.newline.join(each)
        return self.raw([" " + part])[0] if ids is None else ids

    def _add(self, parts: list[str]) -> list[bytes]:
        """ids of a space and a part, for parts that the young generation lacks; now it has them."""
        ids = list(map(self.old.get, parts))
        for k, x in enumerate(parts):
            if ids[k] is None:
                ids[k] = self.part(x)
            self.after[x] = ids[k]
        self.size += sum(map(len, parts)) + sum(map(len, ids)) + 190 * len(parts)  # with what Python adds to each
        if self.size > self.limit // 2:
            self.old, self.after, self.size = self.after, {}, 0
        return ids

    def _apart(self, text: str, special: bool) -> bytes:
        """ids of a text that not every space cuts."""
        head, *parts = [text] if special else _CUT.split(text)
        known = dict(zip(parts, map(self.after.get, parts), strict=True))
        new = [x for x, ids in known.items() if ids is None]
        known.update(zip(new, self._add(new), strict=True))
        return b"".join([self.raw([head])[0], *map(known.__getitem__, parts)])

    def encode_array(self, texts: pa.StringArray, end: bytes = b"") -> pa.BinaryArray:
        """ids of each text, with ``end`` behind them."""
        n = len(texts)
        if not n:
            return pa.array([], pa.binary())
        cut = pc.split_pattern(texts, " ")
        at = cut.offsets.to_numpy()
        at = at - at[0]
        chunks = cut.flatten().dictionary_encode()
        seq = chunks.indices.to_numpy()
        parts = chunks.dictionary.to_numpy(zero_copy_only=False)
        firsts, lengths = at[:-1], np.diff(at)
        heads = parts[seq[firsts]].tolist()

        special = np.zeros(n, bool)  # has an id of its own, which cuts differ from
        for x in self.special:
            special |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        apart = special.copy()
        behind = np.repeat(~apart, lengths)  # chunks behind a space, in texts that every space cuts
        behind[firsts] = False

        def met() -> np.ndarray:
            seen = np.zeros(len(parts), bool)
            seen[seq[behind]] = True
            return np.flatnonzero(seen)

        used = met()
        names = parts[used].tolist()
        ids = list(map(self.after.get, names))
        new = [k for k, x in enumerate(ids) if x is None]
        unsound = [k for k in new if names[k][:1] in _SPACES]  # after two spaces, or before other white space
        if unsound:  # no others of their texts are needed
            odd = np.zeros(len(parts), bool)
            odd[used[unsound]] = True
            apart |= np.logical_or.reduceat(odd[seq] & behind, firsts)
            behind &= np.repeat(~apart, lengths)
            used = met()
            names = parts[used].tolist()
            ids = list(map(self.after.get, names))
            new = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(new, self._add([names[k] for k in new]), strict=True):
            ids[k] = x

        first = self.raw(["" if a else x for a, x in zip(apart.tolist(), heads, strict=True)])
        for k in np.flatnonzero(apart).tolist():
            first[k] = self._apart(texts[k].as_py(), bool(special[k]))
        table = pa.array([b"", end, *first, *ids], pa.binary())
        entry = np.zeros(len(parts), np.int32)
        entry[used] = np.arange(len(used)) + 2 + n
        seq = np.where(behind, entry[seq], 0)
        seq[firsts] = np.arange(n) + 2
        out = table.take(pa.array(np.insert(seq, at[1:], 1)))
        ends = np.frombuffer(out.buffers()[1], np.int32)[at + np.arange(n + 1)]
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), out.buffers()[2]])

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each tokenizer and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def by_bytes(b: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``size`` bytes of a string column; a row is never split."""
    ends = np.cumsum(pc.binary_length(b.column(column)).to_numpy().astype(np.int64))
    at = 0
    while at < b.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield b.slice(at, to - at)
        at = to


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc, h, ids, seen): little-endian ids of two bytes (four, if the vocabulary needs them), the end id last.

    The last row of each task has only ``seen``: how often it met each id, from 0 to the greatest one, in eight bytes.
    """

    def run(it):
        coder = encoder(path)
        end = np.array([end_id], coder.dtype).tobytes()
        names = ["doc", "h", "ids", "seen"]
        total = np.zeros(0, np.int64)
        for b in it:
            for s in by_bytes(b, "text", SLICE_BYTES):
                ids = coder.encode_array(s.column("text"), end)
                total = _sum(total, np.bincount(_flat(ids, coder.dtype)[0]))
                yield pa.RecordBatch.from_arrays([s.column("doc"), s.column("h"), ids, pa.nulls(len(ids), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    return keyed(docs).mapInArrow(run, "doc bigint, h bigint, ids binary, seen binary")


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of two arrays of counts, of which one may be shorter."""
    out, less = (a.copy(), b) if len(a) > len(b) else (b.copy(), a)
    out[: len(less)] += less
    return out


def _flat(ids: pa.BinaryArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column without nulls in a row, and the number of each value's."""
    if not len(ids):
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    _, offsets, data = ids.buffers()
    at = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
    wide = np.dtype(dtype).itemsize
    return np.frombuffer(data, dtype, (at[-1] - at[0]) // wide, at[0]), np.diff(at) // wide


# ---------------------------------------------------------------- the code

_LENGTHS = np.array([[((c >> (2 * k)) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


#: ids whose bytes are worked out at once: few enough for a processor's cache, and a multiple of four.
_PIECE = 1 << 15


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of ranks."""
    controls, datas = [], []
    for k in range(0, len(ranks), _PIECE):
        part = ranks[k : k + _PIECE]
        most = int(part.max())
        more = [np.flatnonzero(part >= 1 << 8 * w) if most >> 8 * w else part[:0].astype(np.intp) for w in (1, 2, 3)]
        size = np.zeros(-(-len(part) // 4) * 4, np.uint8)
        for x in more:
            size[x] += 1
        four = size.reshape(-1, 4)
        controls.append((four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes())
        size = size[: len(part)]
        at = np.cumsum(size, dtype=np.int64) - size + np.arange(len(part))
        data = np.empty(len(part) + sum(map(len, more)), np.uint8)
        data[at] = part & 255
        for w, x in enumerate(more, 1):
            data[at[x] + w] = part[x] >> 8 * w & 255
        datas.append(data.tobytes())
    return b"".join(controls), b"".join(datas)


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.uint32)
    begin = 0
    for k in range(0, n, _PIECE):
        to = min(n, k + _PIECE)
        size = _LENGTHS[control[k // 4 : -(-to // 4)]].reshape(-1)[: to - k]
        at = np.cumsum(size, dtype=np.int64)
        end = begin + int(at[-1])
        own = data[begin:end]
        at -= size
        part = own[at].astype(np.uint32)
        for w in range(1, int(size.max())):
            more = np.flatnonzero(size > w)
            part[more] |= own[at[more] + w].astype(np.uint32) << np.uint32(8 * w)
        out[k:to] = part
        begin = end
    return out


MAGIC = b"SKV1"


def block(docs: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = struct.pack("<4sIQQ", MAGIC, len(docs), len(ranks), len(control))
    return b"".join([head, np.array(docs, "<i8").tobytes(), np.array(counts, "<i8").tobytes(), control, data])


def read_block(payload: bytes, id_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, ids of each, all ids in a row)."""
    magic, n_docs, n, n_control = struct.unpack_from("<4sIQQ", payload)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at = struct.calcsize("<4sIQQ")
    docs, counts = np.frombuffer(payload, "<i8", 2 * n_docs, at).reshape(2, -1)
    body = np.frombuffer(payload, np.uint8, offset=at + 16 * n_docs)
    return docs, counts, id_of[unpack(body[:n_control], body[n_control:], n)]


def rank_table(tokens: DataFrame) -> DataFrame:
    """(rank, id): ids by falling count over the whole corpus, ties by id. A row for each id that occurs."""

    def count(it):
        total = np.zeros(0, np.int64)
        for b in it:
            for x in b.column("seen"):
                total = _sum(total, np.frombuffer(x.as_buffer(), "<i8"))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    counts = tokens.where("seen is not null").select("seen").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "id")


def write_tokens(docs: DataFrame, to: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Write the blocks of ``docs`` under ``to``/blocks and the rank table under ``to``/ranks."""
    path = path or tokenizer_path()
    tokens = staged(encoded(docs, path, end_id), "tokens", "zstd")
    ids = np.array([r.id for r in rank_table(tokens).collect()], np.uint32)  # as many as the vocabulary has, at most
    spark = docs.sparkSession
    spark.createDataFrame([(k, int(x)) for k, x in enumerate(ids)], "rank int, id bigint").coalesce(1).write.parquet(f"{to}/ranks")
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def write(it):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kind = encoder(path).dtype
        own: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        pieces: list[np.ndarray] = []
        size = before = nulls = 0

        def flush():
            ranks = np.concatenate([shared.value[x] for x in pieces])
            data = block(np.concatenate(own), np.concatenate(counts), ranks)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ranks)], pa.int64()), pa.array([nulls], pa.int64()), pa.array([data], pa.binary())], names=["part", "before", "n_ids", "n_null", "payload"])

        for b in it:
            docs = b.column("doc").to_numpy()
            last = (docs == NO_ID) & (b.column("h").to_numpy() >= 0)  # these come last
            ids, each = _flat(b.column("ids"), kind)
            ends = np.cumsum(each)
            at = done = 0
            while at < len(docs):
                to = min(len(docs), int(np.searchsorted(ends, done + BLOCK_IDS - size)) + 1)  # with the document that fills the block
                own.append(docs[at:to])
                counts.append(each[at:to])
                pieces.append(ids[done : ends[to - 1]])
                nulls += int(last[at:to].sum())
                size += len(pieces[-1])
                at, done = to, int(ends[to - 1])
                if size >= BLOCK_IDS:
                    yield flush()
                    own, counts, pieces, size, nulls, before = [], [], [], 0, 0, before + size
        if own:
            yield flush()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.where("ids is not null").select("doc", "h", "ids").repartitionByRange(n, "doc", "h").sortWithinPartitions("doc", "h")
    ordered.mapInArrow(write, "part int, before bigint, n_ids bigint, n_null bigint, payload binary").write.option("compression", "uncompressed").parquet(f"{to}/blocks")
    discard(tokens)


def read_tokens(spark: SparkSession, at: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids themselves (uint32, little-endian), decoded from the files."""
    ids = spark.read.schema("rank int, id bigint").parquet(f"{at}/ranks").orderBy("rank").collect()
    blocks = spark.read.schema("part int, before bigint, n_ids bigint, n_null bigint, payload binary").parquet(f"{at}/blocks")
    starts: dict[int, int] = {}
    total = 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each written partition
        starts[r.part] = total
        total += r.n
    shared = spark.sparkContext.broadcast((np.array([r.id for r in ids], np.uint32), starts))

    def read(it: Iterator[pa.RecordBatch]):
        id_of, starts = shared.value
        for b in it:
            for part, before, nulls, payload in zip(*(b.column(x).to_pylist() for x in ("part", "before", "n_null")), b.column("payload"), strict=True):
                docs, counts, all_ids = read_block(payload.as_py(), id_of)
                at = np.concatenate([[0], np.cumsum(counts)])
                raw = all_ids.astype("<u4", copy=False)
                columns = {
                    "doc_id": pa.array(docs, pa.int64(), mask=np.arange(len(docs)) >= len(docs) - nulls),
                    "start": pa.array(at[:-1] + starts[part] + before, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([raw[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return blocks.select("part", "before", "n_null", "payload").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/token-output-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), to)
    return read_tokens(spark, to, with_ids=False)
