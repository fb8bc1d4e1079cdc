"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a Viterbi search.

One pass over the characters: at each end position the automaton yields every
piece that ends there (its own output and, along output links, the shorter
ones), and each relaxes the best score of that position. A character that is
no piece itself costs ``UNKNOWN`` below the lowest score and is written as its
bytes. Of equal sums the piece that begins first (the longest) wins.

The segmentation is the one of greatest summed piece score, that of the
library for models of unigram type. For a model that was built by merges (BPE)
the library replays the merges instead, so its segmentation may differ; ids
stand for the same pieces, and decoding restores the text either way.

Where no piece holds the space mark behind another character (checked when the
model is read), the best segmentation of a text is that of its space-led
chunks put in a row, so chunks are remembered (a bounded number) and texts of
any length need little memory.

Defined results: null and empty texts have no ids; the mark U+2581 in a text
decodes to a space, as in the library; rows are independent, so repeated rows,
null ids and extra columns need no care.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, slices, task, texts

MODEL = "piece_bpe_32k.model"
UNKNOWN = 10.0
MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec(Remembered):
    """chunk -> bytes of its ids; forgets all chunks at ``limit`` bytes."""

    def __init__(self, path: str, limit: int = 48 << 20):
        super().__init__(limit)
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        self.singles: set[str] = set()
        lowest = 0.0
        self.chunked = True
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_unknown(i) or model.is_control(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(MARK, " ").encode())
                self.automaton.add_word(piece, (len(piece), i, score))
                lowest = min(lowest, score)
                if len(piece) == 1:
                    self.singles.add(piece)
                self.chunked &= MARK not in piece.lstrip(MARK)
        self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN

    def viterbi(self, text: str) -> list[int]:
        n, worst, singles, unknown = len(text), float("-inf"), self.singles, self.unknown
        best, back = [0.0] + [worst] * n, [(0, -1)] * (n + 1)
        at = 0  # positions up to here have their final score
        for end, (size, i, score) in self.automaton.iter(text):
            while at < end:  # unknown characters that end before
                if text[at] not in singles and best[at] + unknown > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + unknown, (at, -1)
                at += 1
            begin = end + 1 - size
            score += best[begin]
            if score > best[end + 1]:
                best[end + 1], back[end + 1] = score, (begin, i)
        for at in range(at, n):
            if text[at] not in singles and best[at] + unknown > best[at + 1]:
                best[at + 1], back[at + 1] = best[at] + unknown, (at, -1)
        out: list[int] = []
        while n:
            begin, i = back[n]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.byte[b] for b in reversed(text[begin:n].encode("utf-8", "surrogatepass")))
            n = begin
        out.reverse()
        return out

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.viterbi(chunk), "<u4").tobytes()
        return self.keep(chunk, ids, len(chunk) + len(ids) + 90)

    def encode(self, text: str) -> bytes:
        """ids as little-endian uint32."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        if not self.chunked:
            return np.array(self.viterbi(marked), "<u4").tobytes()
        return b"".join(map(self.__getitem__, _CHUNK.findall(marked)))

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each model and Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>), a row for each row of ``docs``."""
    path = path or model_path()

    def run(it):
        c = codec(path)
        for b in slices(it):
            ids = [np.frombuffer(c.encode(t), "<i4") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(task(run), "doc_id bigint, n_tokens bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of what ``encode_documents`` gave; null ids decode to an empty text."""
    path = path or model_path()

    def run(it):
        c = codec(path)
        for b in slices(it):
            texts = [c.decode(np.array(x.values, "<u4").tobytes() if x.is_valid else b"") for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task(run), "doc_id bigint, text string")


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip (equal, but for marks)."""
    path = path or model_path()

    def run(it):
        c = codec(path)
        for b in slices(it):
            n, crc, sha, same = [], [], [], []
            for t in b.column("text").to_pylist():
                ids = c.encode(t)
                back = c.decode(ids)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == t.replace(MARK, " "))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"]
            )

    return texts(docs).mapInArrow(task(run), "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"))
