import random

import pytest

import corpus_pipeline
from skeinlake.llm import language_id

from .helpers import docs, noise


def _text(r, letters, n=60):
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(n))


def test_few_calibrating_documents_reject_nothing(spark):
    r = random.Random(2)
    texts = ["aaaa aaaa aaaa"] * 1 + [_text(r, "abcdefgh") for _ in range(60)]
    got = language_id.accepted(docs(spark, texts))
    assert got.count() == len(texts)
    # beside a language with many: the few are judged by limits of all
    many = [_text(r, "klmnopqrs") for _ in range(700)]
    langs = {k: "xx" for k in range(len(texts))}
    out = language_id.accepted(docs(spark, [*texts, *many, "1234 ..."], langs))
    assert out.count() == len(texts) + len(many) and {x.lang for x in out.select("lang").distinct().collect()} == {"xx", "en"}


@pytest.mark.parametrize("rows", [[], [(1, None), (2, None)], [(1, "same words for all of them here\n" * 3)] * 4 + [(None, "x"), (None, None)]])
def test_stages_on_odd_tables_with_odd_columns(spark, tmp_path, rows):
    names = ["_", "my col", "a.b", "row", "left", "_node", "kept", "extra0"]
    d = docs(spark, rows or noise(3, 0))
    for k, x in enumerate(names):
        from pyspark.sql import functions as F

        d = d.withColumn(x.replace(".", "") + "_", F.lit(k))
    d = d.toDF(*[*d.columns[:-8], *names])
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "words of a benchmark item that is ten words long at least")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, own = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, at)
        assert out.columns == d.columns
        rows_out = out.collect()
        assert all(list(x)[-8:] == list(range(8)) for x in rows_out)
    assert corpus_pipeline.run(spark, at).count() <= max(1, len(rows))
