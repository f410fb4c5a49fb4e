"""Outlier rules: columns on both sides of each rule, with expected rows worked out from the rule."""

import pytest

from fieldloom.operators import quality

STEADY = [float(40 + i % 7) for i in range(28)]

#: name -> (values, places of outliers); the fences are quartiles -+ 3 IQR unless said otherwise
CASES = {
    # no spread: median -+ 3 max(1, |median|)
    "constant, one above the fence": ([8.0] * 11 + [32.5], [11]),
    "constant, one on the fence": ([8.0] * 11 + [32.0], []),
    "constant near zero, fence of 3": ([0.2] * 9 + [3.1], []),
    "constant near zero, beyond 3": ([0.2] * 9 + [3.3], [9]),
    "negative constant": ([-6.0] * 8 + [-24.5], [8]),
    # zeros leave from 30 % on
    "three of ten are zeros": ([0.0, 0.0, 0.0, 20.0, 21.0, 22.0, 23.0, 24.0, 25.0, 90.0], [9]),
    "two of nine are zeros, which stay and are far": ([0.0, 0.0, 20.0, 21.0, 22.0, 23.0, 24.0, 25.0, 26.0], [0, 1]),
    # at most max(2, a tenth) of the rows
    "two of a small column": ([*STEADY[:9], 700.0, -1.0, 800.0][:9] + [700.0, 800.0], [9, 10]),
    "three of a small column": (STEADY[:14] + [700.0, 800.0, 900.0], []),
    "three of thirty-one": (STEADY + [700.0, 800.0, 900.0], [28, 29, 30]),
    "three values": ([3.0, 3.0, 900.0], []),
}


@pytest.fixture(scope="module")
def flagged(spark):
    rows = [("f", i, name, v) for name, (values, _) in CASES.items() for i, v in enumerate(values)]
    return quality.outliers(spark.createDataFrame(rows, "form string, record_key int, field string, value double")).collect()


@pytest.mark.parametrize("name", CASES)
def test_flags(flagged, name):
    assert sorted(r["record_key"] for r in flagged if r["field"] == name and r["is_outlier"]) == CASES[name][1]


def test_fences(flagged):
    fences = lambda name: {(r["lo"], r["hi"]) for r in flagged if r["field"] == name}
    # a column without negative values has no fence below 0
    assert fences("constant, one above the fence") == {(0.0, 32.0)}
    assert fences("negative constant") == {(-24.0, 12.0)}
