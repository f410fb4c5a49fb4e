"""Table specs, ticked options, records, blocks and bundles, case by case."""

import random

import pytest

from fieldloom.operators import matching, specs
from fieldloom.operators.specs import Spec

CELL = "tbl int, cell int, row int, col int, row_span int, col_span int, text string"


def table(spark, *tables):
    return spark.createDataFrame([(k, i, *(c if len(c) == 5 else (*c[:2], 1, 1, c[2]))) for k, t in enumerate(tables) for i, c in enumerate(t)], CELL)


def fields(spark, cells, *some):
    return {(r["tbl"], r["field"]): (r["value"], r["status"]) for r in specs.applied_specs(cells, ["tbl"], list(some)).collect()}


def test_neighbours(spark):
    """An equal label wins over an earlier cell that has it inside; spans are stepped over; later cells cover earlier ones."""
    cells = table(spark, [(0, 0, "길이(m)"), (0, 1, "no"), (1, 0, 2, 2, "길 이"), (1, 2, " 12 m "), (3, 0, "아래"), (4, 0, "x"), (1, 2, None), (3, 0, "나중 -7.5")])
    got = fields(spark, cells, Spec("r", "right", "길이"), Spec("b", "below", "길이"), Spec("n", "number_below", "길이"), Spec("i", "right", "(m)"), Spec("edge", "right", "x"), Spec("none", "right", "없음"))
    assert got == {(0, "r"): ("", "empty"), (0, "b"): ("나중 -7.5", "ok"), (0, "n"): ("-7.5", "ok"), (0, "i"): ("no", "ok"), (0, "edge"): ("", "empty"), (0, "none"): ("", "anchor_missing")}


@pytest.mark.parametrize("text, want", [("약 12.5 m", "12.5"), ("-3", "-3"), (".5", "5"), ("※ 3", ""), ("지침 2", ""), ("없음", ""), (None, "")])
def test_numbers_beside_hints(spark, text, want):
    got = fields(spark, table(spark, [(0, 0, "폭"), (0, 1, text)]), Spec("f", "number_right", "폭"))
    assert got == {(0, "f"): (want, "ok" if want else "empty")}


BOXES = {
    "right": ([(0, 0, "가"), (0, 1, "√"), (0, 2, "나"), (0, 3, "")], "가"),
    "not beyond the next option": ([(0, 0, "가"), (0, 1, ""), (0, 2, "나"), (0, 3, "√")], "나"),
    "below": ([(0, 0, "가"), (0, 1, "나"), (1, 0, ""), (1, 1, "x ✓")], "가"),
    "below, far right": ([(0, 0, "가"), (0, 3, "나"), (1, 0, ""), (1, 3, "✓")], "나"),
    "not below in another option's row": ([(0, 0, "가"), (1, 0, "나"), (1, 1, "■")], "나"),
    "own": ([(0, 0, "가 ( √ )"), (0, 1, "나")], "가"),
    "too far": ([(0, 0, "가"), (0, 9, "√"), (0, 10, "z")], ""),
    "far enough": ([(0, 0, "가"), (0, 8, "√")], "가"),
    "the first that is ticked": ([(0, 0, "나"), (0, 1, "√"), (1, 0, "가"), (1, 1, "√")], "가"),
    "none ticked": ([(0, 0, "가"), (0, 1, "□")], ""),
    "no option": ([(0, 0, "다"), (0, 1, "√")], None),
}


def test_boxes(spark):
    got = fields(spark, table(spark, *[t for t, _ in BOXES.values()]), Spec("c", "checkbox", options=("가", "나")))
    for k, (name, (_, want)) in enumerate(BOXES.items()):
        assert got[k, "c"] == ((want, "ok") if want else ("", "anchor_missing" if want is None else "empty")), name


def test_records(spark):
    cells = table(spark, [(0, 0, "a"), (0, 1, "1"), (1, 0, "b")], [(0, 0, "z")])
    some = [Spec("a", "right", "a"), Spec("b", "right", "b"), Spec("c", "right", "c"), Spec("d", "right", "d", required=False)]
    rows = {r["tbl"]: r for r in specs.mapped_records(specs.applied_specs(cells, ["tbl"], some), ["tbl"]).collect()}
    assert (rows[0]["values"], rows[0]["flags"], rows[0]["misaligned"], rows[0]["completeness"]) == ({"a": "1"}, {"b": "empty", "c": "anchor_missing"}, ["c"], 0.33)
    assert (rows[1]["values"], rows[1]["completeness"]) == ({}, 0.0)
    only = specs.mapped_records(specs.applied_specs(cells, ["tbl"], some[3:]), ["tbl"]).first()
    assert (only["values"], only["flags"], only["completeness"]) == ({}, {}, 0.0)
    assert specs.applied_specs(cells.where("false"), ["tbl"], some).count() == 0
    with pytest.raises(ValueError):
        Spec("x", "left", "a")


def test_blocks(spark):
    cells = table(spark, [(0, 0, "보 길이"), (0, 1, "콘크리트 (보명칭) 남와리1 "), (1, 0, "(보명칭) 둘째 (보코드) 5220-A"), (2, 0, "하천명"), (2, 1, "한강")], [(0, 0, "상류방향"), (0, 1, "하류방향")], [(0, 0, "아무것도")], [(0, 0, "콘크리트")])
    signals = [("a", ["보길이", "콘크리트", "재질"]), ("photo", ["상류방향", "하류방향"])]
    got = sorted(map(tuple, specs.form_blocks(cells, ["tbl"], signals, ("photo",)).collect()))
    assert got == [(0, "a", 1.0, "남와리1", "5220-A", "한강"), (3, "a", 0.5, "", "", "")]


def slow_bundles(pairs, threshold=0.35):
    """Greedy matching on the pages that are left, again and again."""
    found, used = [], set()
    while len(found) < 200:
        took = {}
        for ratio, rank, page in sorted(((r, k, p) for k, p, r in pairs), key=lambda x: (-x[0], x[1], x[2])):
            if ratio >= threshold and page not in used and rank not in took and page not in took.values():
                took[rank] = page
        if not took or found and len(took) < max(1, round(len(found[0]) * 0.5)):
            break
        found.append(took)
        used |= set(took.values())
    return sorted((min(b.values()), sorted(b.items())) for b in found)


def test_bundles_against_a_loop(spark):
    rnd = random.Random(8)
    files = {f: [(k, p, rnd.choice([0.2, 0.4, 0.5, 0.5, 0.9])) for k in range(rnd.randrange(1, 5)) for p in range(rnd.randrange(1, 12))] for f in range(60)}
    df = spark.createDataFrame([(f, p, k, f"u{k}", r) for f, pairs in files.items() for k, p, r in pairs], "doc int, page int, rank int, unit string, ratio double")
    got = {}
    for r in matching.matched_bundles(df, "doc", "page").collect():
        got.setdefault(r["doc"], {}).setdefault(r["bundle"], []).append((int(r["unit"][1:]), r["page"]))
    for f, pairs in files.items():
        assert [sorted(b) for _, b in sorted(got.get(f, {}).items())] == [b for _, b in slow_bundles(pairs)], f
    assert max(map(len, got.values())) > 3
