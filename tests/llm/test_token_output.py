import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinlake.llm import token_output as t

from .helpers import docs, noise


def whole(texts):
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(t.tokenizer_path())
    return [e.ids for e in k.encode_batch(texts, add_special_tokens=False)]


CODER = t.ChunkEncoder(t.tokenizer_path(), limit=9000)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'’sat1é \u0085 \x1c<|"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_chunks_encode_as_whole_texts(texts):
    assert [np.frombuffer(x, CODER.dtype).tolist() for x in CODER.encode(texts)] == whole(texts)


def test_plain_chunks_encode_as_whole_texts():
    texts = noise(5, 50, ("to.\nErtion", "don't", "été,", "ɏß", "x", "--", "a--b", "THE!!", "ab\n", "\nab", "ab\n\ncd", "7", "'s", "ab's'"), 30)
    assert [np.frombuffer(x, CODER.dtype).tolist() for x in CODER.encode(texts)] == whole(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(0, 70000), max_size=50))
def test_code_round_trip(ranks):
    x = np.array(ranks, np.uint32)
    control, data = t.pack(x)
    assert len(control) == -(-len(x) // 4)
    assert (t.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(x)) == x).all()


def test_files_hold_all_documents_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "BLOCK_IDS", 100)
    texts = [*noise(1, 40), None, "", "  two  spaces \n\n<|endoftext|>", "é" * 5000, "ab cd"]
    rows = [(7 * k % 101, x) for k, x in enumerate(texts)] + [(None, "last"), (None, "last"), (3, "again"), (3, "again"), (2**63 - 1, "last"), (2**63 - 1, "more")]
    t.write_tokens(docs(spark, rows), f"file://{tmp_path}/out")
    got = t.read_tokens(spark, f"file://{tmp_path}/out").orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows if i is not None) + [None, None]
    ids = {}
    for (i, _), x in zip(rows, whole([x or "" for _, x in rows]), strict=True):
        ids.setdefault(i, []).append(tuple(x) + (2,))
    at = 0
    for r in got:
        own = tuple(np.frombuffer(r.ids, "<u4").tolist())
        ids[r.doc_id].remove(own)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    assert not any(ids.values())


def test_special_tokens_are_those_of_the_plain_call():
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", " <|endoftext|>\n"]
    assert [np.frombuffer(x, CODER.dtype).tolist() for x in CODER.encode(texts)] == whole(texts)
    assert len(whole(texts)[0]) == 4 and whole(["<|endoftext|>"]) == [[50256]]


def test_empty_table(spark, tmp_path):
    t.write_tokens(docs(spark, []), f"file://{tmp_path}/none")
    assert t.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


def test_common_chunks_are_never_forgotten(monkeypatch):
    coder = t.ChunkEncoder(t.tokenizer_path(), limit=20_000)
    seen = []
    part = coder.part
    monkeypatch.setattr(coder, "part", lambda x: seen.append(x) or part(x))
    for k in range(40):
        texts = [f"a common w{k}x{j} word" for j in range(10)]
        assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)] == whole(texts)
    assert seen.count("common") == seen.count("word") == 1
    assert len(coder.after) + len(coder.old) < 200


def test_texts_of_all_kinds_in_one_call():
    odd = ["", " ", "  a b", "a  b c", "a b ", "a b\n", "\na b", "a \nb c", "b\n c d", "x <|endoftext|> y", "\x1c a\x1c b", "　a b　 c", " ", "éa 表 b, b", "b,"]
    texts = [*noise(3, 30, ("ab", "cd,", "ef.\nGh", "b", "b\nb", "é")), *odd, *(f"{x} {y}" for x in odd for y in odd)]
    for _ in range(2):  # the second time from memory
        got = CODER.encode(texts)
        assert [np.frombuffer(x, CODER.dtype).tolist() for x in got] == whole(texts)
    with_end = CODER.encode_array(pa.array(["skipped", *texts]).slice(1), b"\2\0")
    assert with_end.to_pylist() == [x + b"\2\0" for x in got]
    assert CODER.encode_array(pa.array([], pa.string())).to_pylist() == []


def test_batches_are_cut_by_bytes():
    texts = ["a" * n for n in (3, 0, 4, 20, 1, 1, 0)]
    b = pa.RecordBatch.from_arrays([pa.array(["zzzz", *texts]).slice(1)], names=["text"])
    assert [x.column(0).to_pylist() for x in t.by_bytes(b, "text", 7)] == [texts[:3], texts[3:4], texts[4:]]
    assert not [*t.by_bytes(b.slice(0, 0), "text", 7)]


def test_tasks_count_the_ids_that_they_encode(spark):
    texts = [*noise(7, 60), None, "", "a  b", "<|endoftext|> ab"]
    ids = np.concatenate([np.array([*x, 2]) for x in whole([x or "" for x in texts])])
    counts = np.bincount(ids)
    tokens = t.encoded(docs(spark, texts).repartition(5), t.tokenizer_path())
    want = sorted(np.unique(ids).tolist(), key=lambda x: (-counts[x], x))
    assert [(r.id, r.n) for r in t.rank_table(tokens).collect()] == [(x, counts[x]) for x in want]
