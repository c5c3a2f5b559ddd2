from __future__ import annotations

import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from claimloom.operators import guidance, validate
from claimloom.sources import ooxml, readers


def test_checks(spark):
    df = spark.createDataFrame([("a", "x", {"k": "1"}), ("a", " ", None), ("b", None, {}), ("c", "y", {"k": "1", "l": "2"})], "id string, v string, m map<string,string>")
    rows = lambda issues: sorted((r.check, r.key, r.column, r.value) for r in issues.collect())
    assert rows(validate.duplicated(df, "id")) == [("duplicated", "a", "id", "2")]
    assert rows(validate.outside(df, "id", "v", ["x", " "])) == [("outside", "c", "v", "y")]
    assert [r[:3] for r in rows(validate.blank(df, "id", "v"))] == [("blank", "a", "v"), ("blank", "b", "v")]
    assert rows(validate.absent(df, "id", "m", ["k", "l"])) == [("absent", "a", "m", "k"), ("absent", "a", "m", "l"), ("absent", "a", "m", "l"), ("absent", "b", "m", "k"), ("absent", "b", "m", "l")]
    other = spark.createDataFrame([("a", "x"), ("c", "z"), (None, "q")], "id string, v string")
    assert rows(validate.unknown(df, "id", "id", other, "id")) == [("unknown", "b", "id", "b")]
    assert rows(validate.unequal(df.where("v is not null"), "id", "v", other, "id", "v")) == [("unequal", "a", "v", "  x"), ("unequal", "c", "v", "y z")]
    validate.strict(validate.outside(df.limit(0), "id", "v", ["x"]))
    with pytest.raises(ValueError, match="duplicated"):
        validate.strict(validate.all_issues(validate.duplicated(df, "id"), validate.outside(df, "id", "v", [])))


def test_page_specifications(spark):
    specs = {"11": [11], "11,12": [11, 12], "1,3-5,12": [1, 3, 4, 5, 12], "5-3": [], " 2 , 2-3 ,": [2, 3], "0-2": [1, 2], "99": [], "10-40": [10, 11, 12], "": []}
    df = spark.createDataFrame([(s,) for s in specs], "s string").select("s", validate.pages(F.col("s"), F.lit(12)).alias("p"))
    assert {r.s: r.p for r in df.collect()} == specs


def test_front_matter(spark):
    text = '---\nsource_id: a1\n# note\ntitle: "quoted: text"\ncross_refs:\n  - source_id: b\n    relation: r\n  - source_id: c\n    relation: s\n---\nBody\n---\nmore'
    fields, items, body = guidance.front_matter(text)
    assert fields == {"source_id": "a1", "title": "quoted: text"} and items == [{"source_id": "b", "relation": "r"}, {"source_id": "c", "relation": "s"}] and body == "Body\n---\nmore"
    assert guidance.front_matter(guidance.with_front_matter(fields, items, body)) == (fields, items, body)
    rows = spark.createDataFrame([("x", text), ("y", "no block"), ("z", None), ("w", "---\nno colon\n---\nb")], "id string, t string")
    found = {r.key: r for r in guidance.front_matters(rows, "id", "t").collect()}
    assert found["x"].fields["source_id"] == "a1" and [found[k].well_formed for k in "xyzw"] == [True, False, False, False] and found["y"].body == "no block"


def test_written_books_read_back():
    book = ooxml.workbook({"One": (["a", "b"], [("x & <y>", 3), (None, "two\nlines")]), "Two": (["n"], [])})
    assert book == ooxml.workbook({"One": (["a", "b"], [("x & <y>", 3), (None, "two\nlines")]), "Two": (["n"], [])})
    spans, _ = readers.read_xlsx(book)
    assert [(s[2], s[4]) for s in spans] == [("One:A1", "a"), ("One:B1", "b"), ("One:A2", "x & <y>"), ("One:B2", "3"), ("One:B3", "two\nlines"), ("Two:A1", "n")]
    page = ooxml.document([("h1", "Title"), ("p", "text"), ("table", [("a", 1), (None, "c")])])
    spans, _ = readers.read_docx(page)
    assert [(s[0], s[3], s[4]) for s in spans] == [("paragraph", "Title", "Title"), ("paragraph", "Title", "text"), ("table_cell", "Title", "a"), ("table_cell", "Title", "1"), ("table_cell", "Title", "c")]
    assert {i.date_time for i in zipfile.ZipFile(BytesIO(page)).infolist()} == {(1980, 1, 1, 0, 0, 0)} and ooxml.column(703) == "AAA"


def test_long_sheets_go_on(monkeypatch):
    monkeypatch.setattr(ooxml, "SHEET_ROWS", 3)
    spans, _ = readers.read_xlsx(ooxml.workbook({"F": (["h"], [(str(k),) for k in range(5)])}))
    assert [s[4] for s in spans if s[4] != "h"] == [str(k) for k in range(5)] and len({s[2].split(":")[0] for s in spans}) == 3
