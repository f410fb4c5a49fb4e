"""Packet times of laced blocks."""

import pytest

from fieldloom.llm import matroska

UNIT = matroska.FRAME * 1_000_000_000 // matroska.RATE


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
@pytest.mark.parametrize("frames", [1, 2, 8, 9, 1500])
def test_times_of_laced_frames(lacing, frames):
    found, _, _ = matroska.parse(matroska.write(b"x" * (matroska.FRAME * frames), lacing))
    assert [t for _, t, *_ in found] == [i * UNIT for i in range(frames)]


def test_without_default_duration(monkeypatch):
    file = matroska.write(b"x" * (matroska.FRAME * 9))
    monkeypatch.setattr(matroska, "FRAME_TIME", 0x23E384)
    assert [t for _, t, *_ in matroska.parse(file)[0]] == [0] * 8 + [8 * UNIT]


def test_end_in_feature(spark):
    row = matroska.media_column(spark.createDataFrame([(1, "x" * matroska.FRAME * 3)], "doc_id bigint, text string")).first()
    assert f"packets=3;clusters=1;end_ns={2 * UNIT};" in row["feature"]
