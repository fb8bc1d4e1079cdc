import os
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from skeinlake.model import schemas as s
from skeinlake.operators import instance
from skeinlake.plans import catalogue
from skeinlake.session import checkpointed, passing_checkpoints, shared_folder

DATA = "/root/testdata/sf0.001"


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(folder) for x in names)


def test_texts_are_in_no_checkpoint(spark, tmp_path):
    made, total = random.Random(7), 0
    for k in range(4):
        (tmp_path / f"work/inbox/trip/{k}.txt").parent.mkdir(parents=True, exist_ok=True)
        total += (tmp_path / f"work/inbox/trip/{k}.txt").write_text(made.randbytes(500_000).hex())
    folder = shared_folder(spark).removeprefix("file:")
    before = _bytes(folder)
    (unit,) = instance.run_ingest(spark, str(tmp_path), spark.createDataFrame([("txt", None, "reader", 1)], s.ROUTES), "linux").collect()
    assert unit.state == "done" and _bytes(folder) - before < total / 4
    records = {p.read_text().split("---\n\n")[1] for p in (tmp_path / "work/assets").glob("record-*.md")}
    assert records == {p.read_text() for p in (tmp_path / "work/inbox/archive/trip").iterdir()} and len(records) == 4


def test_a_capture_that_gives_no_text_again_stops_the_run(spark, tmp_path):
    (tmp_path / "work/inbox").mkdir(parents=True)
    (tmp_path / "work/inbox/a.txt").write_text("a")
    flag = str(tmp_path / ".flag")

    def once(content):
        with open(flag, "x"):
            return content.decode()

    with pytest.raises(Exception, match="changed while it was ingested: work/inbox/a.txt"):
        instance.run_ingest(spark, str(tmp_path), spark.createDataFrame([("txt", None, "reader", 1)], s.ROUTES), "linux", known={"txt": once})
    assert {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()} == {"work/inbox/a.txt", ".flag"}


def test_turns_hold_each_batch_once_and_no_more_than_their_share(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "TURN", 100 * 8192)
    rows = spark.range(1030).select(F.when(F.col("id") < 1000, F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("source"), F.lit(b"text").alias("content"), "id")
    turns = [[tuple(r) for r in rows.where(x).select("source", "id").collect()] for x in catalogue._turns(rows)]
    assert sorted(k for x in turns for _, k in x) == list(range(1030))
    assert len(turns) >= 10 and max(map(len, turns)) <= 100
    batches = [{b for b, _ in x} for x in turns]
    assert sum(map(len, batches)) == len(set().union(*batches)) == 51


def test_roundtrip_in_turns_equals_its_sql_and_leaves_no_files(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "TURN", 1 << 20)
    folder, held, remove = shared_folder(spark).removeprefix("file:"), [], catalogue.file_sink.remove

    def seen(address):
        if "/instance-" in address and address.rpartition("/")[2].startswith("instance-"):
            held.append(sum(p.is_file() for p in Path(address.removeprefix("file:")).rglob("*.txt")))
        remove(address)

    monkeypatch.setattr(catalogue.file_sink, "remove", seen)
    got = sorted(map(tuple, catalogue.ingest_roundtrip(spark, DATA).collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert got == sorted(duck.execute(catalogue.oracle_sql()["ingest_roundtrip"]).fetchall())
    assert len(held) > 1 and sum(held) == len(got) and max(held) < len(got)  # no folder ever held all of it
    assert not list(Path(folder).parent.glob("*/roundtrip-*")) and not list(Path(folder).glob("roundtrip-*"))


def test_checkpoints_pass(spark):
    files = lambda: {p for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if p.is_file()}
    before = files()
    with passing_checkpoints(spark):
        assert checkpointed(spark.range(9)).count() == 9 and files() > before
    assert files() == before and checkpointed(spark.range(9)).count() == 9 and files() > before
