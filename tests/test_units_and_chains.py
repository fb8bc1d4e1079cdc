import io
import zipfile

import pytest

from skeinlake.model import schemas as s
from skeinlake.operators import graph, instance, sensors, units


def _book(sheet='<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="4"><c r="B4" t="inlineStr"><is><t>in</t></is></c><c r="C4" t="b"><v>1</v></c></row><row r="5"/>'):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/><sheet name="None" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><r><t>sha</t></r><r><t>red</t></r></si></sst>")
        z.writestr("xl/worksheets/a.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/worksheets/b.xml", f"<worksheet {main}><sheetData/></worksheet>")
    return out.getvalue()


def test_units_of_all_kinds(spark):
    rows = [
        ("a.txt", "txt", "é one\n\n  \ntwo".encode()), ("t", "turns", b'{"turn": 0, "role": "user", "text": "hi"}\n{"turn": 1}\n'), ("p.html", "html", b"<title>T</title><ul><li>a &amp; b<li>c</ul><p>x<b>y</b></p>"),
        ("c.csv", "csv", b'a,"b,c"\n'), ("m.py", "py", b"class A:\n    def f(self): pass\n"), ("w.xlsx", "xlsx", _book()), ("bad.xlsx", "xlsx", b"no zip"), ("bad.txt", "txt", b"\xff"), ("x", "mp4", b"1"), ("none", "txt", None), ("empty", "txt", b""),
    ]
    got: dict = {}
    for r in units.units(spark.createDataFrame(rows, "path string, detected_type string, content binary")).collect():
        got.setdefault(r.path, []).append((r.unit, r.kind, r.locator.toPython(), r.text))
    assert got["a.txt"] == [(1, "span", {"start": 0, "end": 5}, "é one"), (2, "span", {"start": 10, "end": 13}, "two")]
    assert got["t"] == [(1, "turn", {"turn": 0, "role": "user"}, "hi"), (2, "turn", {"turn": 1, "role": None}, "")]
    assert [(x[2]["tag"], x[2]["index"], x[3]) for x in got["p.html"]] == [("title", 1, "T"), ("li", 1, "a & b"), ("li", 2, "c"), ("p", 1, "xy")]
    assert got["c.csv"] == [(1, "row", {"row": 1}, "a\tb,c")] and [x[2]["symbol"] for x in got["m.py"]] == ["A", "f"]
    assert got["w.xlsx"] == [(1, "row", {"sheet": "One", "row": 1}, "shared\t\t2.5"), (2, "row", {"sheet": "One", "row": 4}, "\tin\ttrue"), (3, "row", {"sheet": "One", "row": 5}, "")]
    assert [x[1] for x in got["bad.xlsx"]] == ["failed"] and [x[1] for x in got["bad.txt"]] == ["failed"] and not {"x", "none", "empty"} & got.keys()


def test_workbooks_are_ingested_and_broken_ones_stay(spark, tmp_path):
    (tmp_path / "work/inbox").mkdir(parents=True)
    (tmp_path / "work/inbox/w.xlsx").write_bytes(_book())
    (tmp_path / "work/inbox/broken.xlsx").write_bytes(_book()[:200])
    routes = spark.createDataFrame([("xlsx", None, "sheets", 1)], s.ROUTES)
    assert {(r.unit, r.state) for r in instance.run_ingest(spark, str(tmp_path), routes, "linux").collect()} == {("work/inbox/w.xlsx", "done"), ("work/inbox/broken.xlsx", "kept")}
    (record,) = (tmp_path / "work/assets").glob("record-*.md")
    assert record.read_text().endswith("\nOne\t1\tshared\t\t2.5\nOne\t4\t\tin\ttrue\nOne\t5\t\n")
    assert "xlsx" in sensors.registry()


def test_companions_of_a_trace(spark):
    nodes = spark.createDataFrame([("n:1", ["a", "gone"]), ("n:2", []), ("n:3", ["b"])], "id string, source_links array<string>")
    assets = spark.createDataFrame([("a", "raw/a"), ("b", None)], "path string, archive_path string")
    of = units.units(spark.createDataFrame([("a", "txt", b"x\ny"), ("other", "txt", b"z")], "path string, detected_type string, content binary"))
    got = {(r.id, r.kind, r.place, r.unit, r.state) for r in units.companions(graph.trace(nodes, assets, spark.createDataFrame([("raw/a",)], "path string")), of).collect()}
    assert got == {("n:1", "record", "a", None, "whole"), ("n:1", "span", "a", 1, "whole"), ("n:1", "span", "a", 2, "whole"), ("n:1", "raw", "raw/a", None, "whole"), ("n:1", "record", "gone", None, "no record"), ("n:3", "record", "b", None, "no archive")}


def test_ancestors_by_doubling(spark, monkeypatch):
    rounds = []
    real = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: rounds.append(1) or real(df))
    n = 1_000
    chain = spark.createDataFrame([(k, k + 1) for k in range(n)], "id long, parent long").selectExpr("cast(id as string) id", "cast(parent as string) parent")
    got = graph.ancestors(chain)
    assert got.count() == n * (n + 1) // 2 and len(rounds) <= 12 and got.where("cast(ancestor as int) - cast(id as int) <> level").count() == 0
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "e"), ("f", None), ("a", "b")]
    got = {(r.id, r.ancestor): r.level for r in graph.ancestors(spark.createDataFrame(edges, "id string, parent string")).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2, ("d", "b"): 1, ("d", "c"): 1, ("d", "a"): 2}
    with pytest.raises(ValueError):
        graph.ancestors(chain, most=100)
