"""Labels, values beside them, columns and lines of hand-made pages."""

import pytest

from fieldloom.operators import columns, labels

WORD = "page int, pos int, word string, x0 double, x1 double, y0 double, y1 double"


def page(spark, *rows):
    """Rows of (page, word, x, y[, width]); words are ten high."""
    return spark.createDataFrame([(r[0], i, r[1], float(r[2]), float(r[2] + (r[4] if len(r) > 4 else 20)), float(r[3]), float(r[3] + 10)) for i, r in enumerate(rows)], WORD)


def search(spark, words, *wanted):
    return {(r["page"], r["label"]): (r["kind"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in labels.label_words(words, spark.createDataFrame([(x,) for x in wanted], "label string"), "page", "pos").collect()}


def test_exact_before_joined_before_inside(spark):
    words = page(spark, (1, "관리기관명", 0, 0), (1, "관리", 0, 20), (1, "기관", 30, 21), (1, "x관리기관", 0, 40), (2, "관리", 0, 0), (2, "기관", 30, 0), (2, "관리 기관", 0, 50), (3, "앞관리기관", 5, 5))
    got = search(spark, words, "관리기관", "없음", " ", "")
    assert got == {(1, "관리기관"): (2, 0, 20, 50, 31), (2, "관리기관"): (1, 0, 50, 20, 60), (3, "관리기관"): (3, 5, 5, 25, 15)}


def test_joined_words(spark):
    """Up to five words, in the order of places and not of the page, over one line only; the first in reading order wins."""
    six = [(1, c, 20 * i, 0, 15) for i, c in enumerate("abcdef")]
    got = search(spark, page(spark, *six[::-1]), "abcde", "abcdef", "bcd", "fa")
    assert {k[1]: v[1:] for k, v in got.items()} == {"abcde": (0, 0, 95, 10), "bcd": (20, 0, 75, 10)}
    lines = page(spark, (1, "a", 0, 0), (1, "b", 0, 20), (1, "b", 30, 0.5), (1, "a", 60, 20), (1, "b", 90, 20))
    assert search(spark, lines, "ab") == {(1, "ab"): (2, 0, 0, 50, 10.5)}


def test_labels_of_blank_words_and_composed_ones(spark):
    words = page(spark, (1, None, 0, 0), (1, "", 5, 0), (1, "　", 9, 0), (1, "ét", 30, 0), (1, "é", 60, 0))
    assert search(spark, words, "ét", "é")[(1, "ét")][0] == 1
    assert search(spark, words.where("false"), "a") == {} == search(spark, words)


def values(spark, words, label, relation):
    found = labels.label_words(words, spark.createDataFrame([(label,)], "label string"), "page", "pos")
    return [(r["n_words"], r["value"]) for r in labels.label_values(words, found, "page", "pos", relation).collect()]


def test_values(spark):
    words = page(spark, (1, "name", 0, 0), (1, "two", 45, 1), (1, "one", 21, 0), (1, "far", 120, 0), (1, "other", 45, 30), (1, "under", 5, 12), (1, "line", 30, 13), (1, "later", 5, 40))
    assert values(spark, words, "name", "right") == [(2, "one two")]
    assert values(spark, words, "name", "below") == [(2, "under line")]
    assert values(spark, words, "name", "self") == [(1, "name")]
    assert values(spark, words, "later", "right") == [(0, "")] == values(spark, words, "later", "below") and values(spark, words, "none", "right") == []
    # the first word may lie far from its label: only gaps between words count
    assert values(spark, page(spark, (1, "a", 0, 0), (1, "b", 300, 0), (1, "c", 330, 0)), "a", "right") == [(2, "b c")]
    with pytest.raises(ValueError):
        values(spark, words, "name", "left")


def two_columns(n, x, page=1):
    return [(page, f"w{i}", (0, 30, 60, x, x + 30, x + 60)[i % 6], 14 * (i // 6), 20) for i in range(n)]


def split(spark, rows, width=200.0):
    from pyspark.sql import functions as F

    words = page(spark, *rows).withColumn("width", F.lit(width))
    return [(r["n_words"], r["split"]) for r in columns.column_split(words, "page").collect()], words


def test_two_columns(spark):
    (got,), words = split(spark, two_columns(36, 110))
    assert got[0] == 36 and 80 < got[1] < 110
    lines = [" ".join(w["word"] for w in r["words"]) for r in columns.ordered_lines(words, "page", "pos").orderBy("line_no").collect()]
    assert lines[:2] == ["w0 w1 w2", "w6 w7 w8"] and lines[6] == "w3 w4 w5" and len(lines) == 12


@pytest.mark.parametrize("rows", [two_columns(18, 110), [(1, f"w{i}", 30 * (i % 6), 14 * (i // 6), 29) for i in range(36)], two_columns(12, 110) + [(1, "", 0, 0)] * 9, [(1, "w", 5 * i % 60, 14 * (i // 6)) for i in range(30)] + [(1, "x", 150, 0)] * 6])
def test_one_column(spark, rows):
    """Too few words, a narrow band, two lines with blanks, a right side in one line."""
    (got,), words = split(spark, rows)
    assert got[1] is None
    assert columns.ordered_lines(words, "page", "pos").count() >= 2


def even(spark, *xs):
    df = spark.createDataFrame([("k", float(x)) for x in xs] + [("k", None)], "k string, x double")
    return [(r["column"], r["x"], r["given"]) for r in columns.even_columns(df, ["k"], "x").orderBy("column").collect()]


def test_even_columns(spark):
    assert even(spark, 300, 340, 420) == [(1, 300, True), (2, 340, True), (3, 380, False), (4, 420, True)]
    assert even(spark, 459, 300, 341) == [(1, 300, True), (2, 341, True), (3, pytest.approx(341 + 118 / 3), False), (4, pytest.approx(341 + 236 / 3), False), (5, 459, True)]
    assert even(spark, 300, 340, 400) == [] == even(spark, 300, 340) == even(spark, 300, 300, 340) == even(spark)
