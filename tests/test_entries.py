"""Entries as sheet rows, case by case."""

import json

import pytest

from fieldloom.operators import entries
from fieldloom.operators.entries import Field

FIELDS = [Field("제목", "title", value="조사표"), Field("이름"), Field("깊이", "number"), Field("맑음", "check", label="예"), Field("사진", "image"), Field("종", "table", columns=("이름", "수")), Field("물", "table", columns=("수", "값")), Field("빈", "table"), Field("it's")]
NAMES = ["_파일명", "기록일시", "제목", "이름", "깊이", "맑음", "사진", "종_이름", "수", "물_수", "값", "빈_값", "it's"]


def rows(spark, fields, *made, gps=False):
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    df = spark.createDataFrame([(i, c, *map(text, rest)) for i, (c, *rest) in enumerate(made)], "seq long, created string, values string, meta string, photos string")
    out = entries.entry_rows(df, fields, gps)
    return out.columns[2:], [tuple(r)[2:] for r in out.orderBy("seq", "line").collect()]


def test_tables_side_by_side(spark):
    values = {"이름": " 강 ", "깊이": 2.0, "맑음": True, "종": [{"이름": "붕어", "수": 3}, "x", {"이름": "잉어"}], "물": [{"수": 1.5}], "it's": False}
    names, got = rows(spark, FIELDS, ("2024-01-31T23:30:00Z", values, None, {"사진": "a.jpg"}))
    assert names == NAMES
    assert got == [("기록 0", "2024-02-01 08:30", "조사표", "강", "2", "예", "a.jpg", "붕어", "3", "1.5", "", "", ""), ("기록 0", "2024-02-01 08:30", "조사표", "강", "2", "예", "", "잉어", "", "", "", "", "")]


@pytest.mark.parametrize("value, want", [(True, "√"), (False, ""), (None, ""), (3, "3"), (3.0, "3"), (3.25, "3.25"), (-0.5, "-0.5"), ("\t x ", "x"), ("3.0", "3.0"), ([1, "a"], '[1,"a"]'), ({"k": None}, '{"k":null}'), ("", "")])
def test_texts(spark, value, want):
    assert rows(spark, [Field("f")], ("", {"f": value}, None, None))[1] == [("기록 0", "", want)]


@pytest.mark.parametrize("value, want", [(True, "맑음"), ("TRUE", "맑음"), (1, "맑음"), ("1", "맑음"), (False, ""), ("예", ""), (None, ""), (2, "")])
def test_checks(spark, value, want):
    assert rows(spark, [Field("맑음", "check")], ("", {"맑음": value}, None, None))[1][0][2] == want


def test_places_broken_and_empty(spark):
    names, got = rows(spark, [Field("f"), Field("t", "table", columns=("위도",))], ("soon", "{broken", {"gps": {"lat": 37.5, "lon": None}}, None), (None, None, "[]", None), ("", {"t": "no list"}, None, None), gps=True)
    assert names == ["_파일명", "기록일시", "위도", "경도", "위치오차m", "f", "t_위도"]
    assert got == [("기록 0", "soon", "37.5", "", "", "", ""), ("기록 1", "", "", "", "", "", ""), ("기록 2", "", "", "", "", "", "")]
    assert rows(spark, [Field("f")])[1] == []
    with pytest.raises(ValueError):
        Field("f", "video")
