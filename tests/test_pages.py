"""Page matching, lists and HWPX files against cases by hand."""

import zipfile

from pyspark.sql import functions as F

from fieldloom.functions import texts
from fieldloom.operators import layout, matching
from fieldloom.sources import hwpx


def test_greedy_match(spark):
    scores = [(1, 0, 0, "a", 0.5), (1, 1, 0, "a", 0.9), (1, 1, 1, "b", 0.8), (1, 0, 1, "b", 0.3), (1, 2, 1, "b", 0.4), (2, 0, 1, "b", 0.34)]
    df = spark.createDataFrame(scores, "doc long, page long, rank int, unit string, ratio double")
    assert sorted(map(tuple, matching.matched_pages(df, "doc", "page").collect())) == [(1, "a", 1), (1, "b", 2)]


def test_titles(spark):
    pairs = [("Form 1", "form 1 ", 0.8), ("A 1", "A 2", -1.0), ("A", "A 2", 0.9), (None, "x", 0.0), ("a b", "ab", 1.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in df.withColumn("got", matching.title_match(F.col("a"), F.col("b"))).collect():
        assert abs(r["got"] - r["want"]) < 1e-9, r


def test_numbered_lists(spark):
    at = lambda t, row, col, text: (t, row, col, row * 10 + col, 1, 1, text)
    rows = [at(1, 0, 0, "No."), at(1, 0, 1, "종명"), at(1, 0, 2, "개체수"), at(1, 0, 3, "종명")]
    rows += [at(1, 1, 0, "1"), at(1, 1, 1, "carp"), at(1, 1, 2, " 3 "), at(1, 3, 0, "2"), at(1, 3, 1, "lost: row 2 has no number")]
    rows += [at(2, 0, 1, "종명"), at(2, 1, 0, "x"), at(2, 2, 0, "7"), at(2, 2, 1, "eel")]
    df = spark.createDataFrame(rows, "tbl int, row int, col int, cell int, row_span int, col_span int, text string")
    got = layout.numbered_lists(df, "tbl", "종명", "개체수", ("no.", "no")).select("tbl", "r", "name", "count").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "carp", "3"), (2, 2, "eel", "")]


def test_shift(spark):
    words = spark.createDataFrame([(1, i, w, 10.0, 20.0, y, y + 10) for i, (w, y) in enumerate([("aa", 5.0), ("bb", 25.0), ("cc", 46.0), ("dd", 99.0)])], "page int, pos int, word string, x0 double, x1 double, y0 double, y1 double")
    boxes = spark.createDataFrame([(i, w, 50.0, y, y + 10) for i, (w, y) in enumerate([("aa", 0.0), ("bb", 20.0), ("cc", 40.0), ("dd", 60.0)])], "box_id int, label string, x1 double, y0 double, y1 double")
    assert [tuple(r) for r in layout.page_shifts(words, boxes, "page", "pos").collect()] == [(1, 5.0)]


def test_names(spark):
    df = spark.createDataFrame([("2024-01-31T23:30:00Z", "2024-02-01 08:30"), ("2024-01-31", "2024-01-31 09:00"), ("2024-99-31", "2024-99-31"), (None, "")], "t string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", texts.local_time(F.col("t"), "Asia/Seoul")).collect())


def test_hwpx(spark, tmp_path):
    cell = '<hp:tc><hp:subList><hp:p><hp:run charPrIDRef="{b}"><hp:t>{a}</hp:t></hp:run><hp:run charPrIDRef="0"><hp:t> {a}2</hp:t></hp:run></hp:p><hp:p><hp:run><hp:t>next</hp:t></hp:run></hp:p></hp:subList><hp:cellAddr colAddr="{c}" rowAddr="1"/><hp:cellSpan colSpan="2" rowSpan="1"/><hp:cellSz width="70" height="9"/></hp:tc>'
    body = '<s xmlns:hp="urn:p"><hp:p><hp:run><hp:t>Top</hp:t></hp:run></hp:p><hp:tbl><hp:tr>' + cell.format(a="name", b=7, c=0) + cell.format(a="x", b=0, c=2) + "</hp:tr></hp:tbl></s>"
    head = '<h xmlns:hh="urn:h"><hh:charPr id="7"><hh:bold/></hh:charPr><hh:charPr id="0"/></h>'
    with zipfile.ZipFile(tmp_path / "a.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", body)
        z.writestr("Contents/header.xml", head)
    (tmp_path / "b.hwpx").write_bytes(b"no zip")
    docs = hwpx.documents(spark, f"{tmp_path}/*.hwpx").orderBy("path")
    assert [(r["ok"], r["text"]) for r in docs.collect()] == [(True, "Top name name2 next x x2 next"), (False, "")]
    got = hwpx.cells(docs).orderBy("cell").drop("path").collect()
    assert tuple(got[0]) == (0, 0, 1, 0, 1, 2, 70, 9, "name name2\nnext", "name name2 next", "name")
    assert [(r["col"], r["bold_text"]) for r in got] == [(0, "name"), (2, "")]
