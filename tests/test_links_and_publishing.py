import os

from pyspark.sql import functions as F

from skeinlake.model import schemas as s
from skeinlake.operators import links, sync


def _note(spark, rows):
    return spark.createDataFrame(rows, "domain string, path string, text string")


def _domains(spark):
    return spark.createDataFrame([("personal", "private", "Personal"), ("side-projects", "restricted", None)], s.DOMAINS)


def test_links_lead_to_the_targets_vault(spark):
    go = "obsidian://open?vault="
    text = f"é [a]({go}side-projects&file=plan) b {go}PERSONAL c ({go}x&file=side-projects%2Fplan.md) {go}y&file=plan#top {go}z&file=none {go}Side%20Projects&file=gone obsidian://open?file=plan."
    notes = _note(spark, [("personal", "personal/a.md", text), ("side-projects", "side-projects/plan.md", "no link"), ("personal", "personal/none.txt", None)])
    got = links.resolved(links.extracted(notes), notes, _domains(spark)).orderBy("k").collect()
    assert [(r.to, r.found) for r in got] == [("Side Projects", True), ("Personal", None), ("Side Projects", True), ("Side Projects", True), (None, False), ("Side Projects", False), (None, False)]
    assert all(text[r.place :].startswith(r.link) for r in got) and {r.path for r in got} == {"personal/a.md"}
    assert {r.detail.split(" ", 1)[1] for r in links.unresolved(links.resolved(links.extracted(notes), notes, _domains(spark))).collect()} == {f"{go}z&file=none", f"{go}Side%20Projects&file=gone", "obsidian://open?file=plan."}
    pages = {(r.vault_name, r.path): r.text for r in sync.compiled(notes, _domains(spark)).collect()}
    new = text.replace("vault=side-projects", "vault=Side%20Projects").replace("vault=PERSONAL", "vault=Personal").replace("vault=x", "vault=Side%20Projects").replace("vault=y", "vault=Side%20Projects").replace("vault=z", "vault=Personal")
    assert pages == {("Personal", "a.md"): new, ("Side Projects", "plan.md"): "no link", ("Personal", "none.txt"): None}


def test_publishing_writes_what_changed(spark, tmp_path):
    none, vault = spark.createDataFrame([], s.VIOLATION), str(tmp_path / "v")
    pages = lambda **texts: sync.compiled(_note(spark, [("personal", f"personal/{k}.md", t) for k, t in texts.items()]), _domains(spark))
    (tmp_path / "v/Personal/inbox").mkdir(parents=True)
    (tmp_path / "v/Personal/inbox/photo.txt").write_text("from the phone")
    read = lambda: {str(p.relative_to(tmp_path / "v")): (p.read_text(errors="replace"), os.stat(p).st_mtime_ns) for p in (tmp_path / "v").rglob("*") if p.is_file()}
    sync.publish(none, pages(a="1", b="2", c="3"), [vault])
    one = read()
    sync.publish(none, pages(a="1", b="2", c="3"), [vault])
    assert read() == one  # nothing is written
    sync.publish(none, pages(a="1", b="new", d="4"), [vault])
    two = {k: v for k, v in read().items() if ".skein" not in k}
    assert {k: v[0] for k, v in two.items()} == {"Personal/a.md": "1", "Personal/b.md": "new", "Personal/d.md": "4", "Personal/inbox/photo.txt": "from the phone"}
    assert two["Personal/a.md"] == one["Personal/a.md"]


def test_mirrors_follow_deletions(spark, tmp_path):
    top = tmp_path / "mine"
    for path, text in {"work/a.md": "1", "work/.hidden": "h", "b.txt": "", ".skein/config.json": "{}"}.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    read = lambda at: {str(p.relative_to(at)): p.read_text() for p in at.rglob("*") if p.is_file()}
    at = sync.mirror(str(top), str(tmp_path / "backup"))
    assert at == str(tmp_path / "backup/mine") and read(tmp_path / "backup/mine") == read(top)
    before = {p: os.stat(p).st_mtime_ns for p in (tmp_path / "backup").rglob("*") if p.is_file()}
    sync.mirror(str(top), str(tmp_path / "backup"))
    assert {p: os.stat(p).st_mtime_ns for p in (tmp_path / "backup").rglob("*") if p.is_file()} == before
    (top / "work/a.md").unlink()
    (top / "b.txt").write_text("more")
    sync.mirror(str(top), str(tmp_path / "backup"))
    assert read(tmp_path / "backup/mine") == read(top) and "work/a.md" not in read(top)
    assert sync.synced(spark.createDataFrame([], s.VIOLATION), spark.createDataFrame([], "vault_name string, path string, text string"), str(top), {"mirrors": [str(tmp_path / "second")]})["mirrors"] == [str(tmp_path / "second/mine")]
    assert sync.changes(*(spark.createDataFrame(x, "path string, sha256 string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("b", "2"), ("c", "0"), ("d", "4")]))).where(F.col("action") != "same").count() == 3
