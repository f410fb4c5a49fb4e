"""Ink marks of choices and scale rows, and names that collide, against the rules case by case."""

import statistics

import pytest

from fieldloom.operators import layout, records, stores

CHOICES = {
    "ratio is 1.4": ([0.1, 0.1, 0.1, 0.145], [3], ""),
    "two choices: the least is the base": ([0.2, 0.3], [1], ""),
    "faint": ([0.02, 0.02, 0.02, 0.036], [3], "faint"),
    "several": ([0.1, 0.1, 0.3, 0.1, 0.3], [2, 4], "several"),
    "unclear": ([0.05, 0.05, 0.064], [], "unclear"),
    "none": ([0.05, 0.05, 0.055], [], ""),
    "one choice": ([0.3], [], ""),
}


@pytest.mark.parametrize("name", CHOICES)
def test_choices(spark, name):
    scores, marked, flag = CHOICES[name]
    df = spark.createDataFrame([("q", i, s) for i, s in enumerate(scores)], "q string, choice int, score double")
    got = layout.choice_marks(df, ["q"], "choice").collect()
    assert sorted(r["choice"] for r in got if r["marked"]) == marked and {r["flag"] for r in got} == {flag}


def test_marks_already_set_stay(spark):
    df = spark.createDataFrame([("q", i, s, i == 0) for i, s in enumerate([0.1, 0.1, 0.1])] + [("q", 9, None, True)], "q string, choice int, score double, own boolean")
    got = layout.choice_marks(df, ["q"], "choice", "own").collect()
    assert [r["choice"] for r in got if r["marked"]] == [0] and {r["flag"] for r in got} == {"faint"} and len(got) == 3


def slow_scale(scores):
    base, top = statistics.median(scores), max(scores)
    others = sorted(scores)[:-1] if len(scores) > 2 else scores
    delta = max(0.010, 2.5 * statistics.median(abs(v - base) for v in others))
    above = [k for k, v in enumerate(scores) if v >= base + delta]
    if len(above) == 1:
        return above[0] + 1, "faint" if top - base < delta * 1.6 else ""
    if above:
        return scores.index(top) + 1, "several"
    return None, "unclear" if top - base >= delta * 0.6 else ""


def test_scales(spark):
    import random

    rnd = random.Random(3)
    rows = {i: [rnd.choice([0.05, 0.06, 0.07, 0.1, 0.2, 0.4]) for _ in range(rnd.randrange(1, 8))] for i in range(300)}
    # two tied maxima: only one is left out of the spread
    rows |= {1000: [0.1, 0.1, 0.3, 0.3], 1001: [0.2], 1002: [0.1, 0.2]}
    df = spark.createDataFrame([(i, k, s) for i, r in rows.items() for k, s in enumerate(r)], "row int, col int, score double")
    got = {r["row"]: (r["answer"], r["flag"]) for r in layout.scale_answers(df, ["row"], "col").collect()}
    assert got == {i: slow_scale(r) for i, r in rows.items()}
    assert {f for _, f in got.values()} == {"", "faint", "several", "unclear"}


def slow_names(names):
    out = []
    for k in names:
        if k in out:
            n = 2
            while f"{k} ({n})" in out:
                n += 1
            k = f"{k} ({n})"
        out.append(k)
    return out


def test_item_names_stay_unique(spark):
    import random

    rnd = random.Random(1)
    made = {r: [rnd.choice(["a", "a (2)", "a (3)", "b", "b (2)"][: 5 if r % 2 else 1] + ["c"]) for _ in range(rnd.randrange(1, 9))] for r in range(60)}
    made[99] = ["a", "a (2)", "a"]
    df = spark.createDataFrame([(r, i, f"\t{k} ") for r, ks in made.items() for i, k in enumerate(ks)] + [(99, 50, " \u00a0")], "rec int, at int, name string")
    got = {}
    for r in sorted(records.unique_items(df, "rec", "name", "at").collect(), key=lambda r: r["at"]):
        got.setdefault(r["rec"], []).append(r["item"])
    assert got == {r: slow_names(ks) for r, ks in made.items()} and got[99] == ["a", "a (2)", "a (3)"]


def test_corrections_touch_known_records_only(spark):
    rows = spark.createDataFrame([(1, "f", "x", "check"), (2, "f", "y", "check")], "rec int, field string, value string, flag string")
    fixed = spark.createDataFrame([(1, "f", 1, "old"), (1, "f", 2, "new"), (1, "g", 1, "more"), (3, "f", 1, "lost")], "rec int, field string, at int, new_value string")
    got = stores.corrected(rows, fixed, ["rec"], "field", "at").select("rec", "field", "value", "flag")
    assert sorted(map(tuple, got.collect())) == [(1, "f", "new", ""), (1, "g", "more", ""), (2, "f", "y", "check")]


def test_upsert_takes_one_row_whole(spark):
    rows = spark.createDataFrame([("k", 1, "a", "z"), ("k", 5, "b", "x"), ("k", 5, "c", "a")], "k string, at int, p string, q string")
    assert [tuple(r) for r in stores.upsert_last(rows, "k", "at", ["p", "q"]).collect()] == [("k", 1, "c", "a")]


def test_score_report(spark):
    df = spark.createDataFrame([("a", True, 3, 2), ("a", None, 1, 1), (None, False, 4, 0), ("b", True, 0, 0)], "form string, verified boolean, total int, correct int")
    got = {r["form"]: tuple(r)[1:] for r in records.score_report(df, "form", "verified").collect()}
    assert got == {"a": (2, 4, 3, 0.75, 1), "b": (1, 0, 0, 0.0, 0), None: (4, 8, 3, 0.375, 2)}
    assert [tuple(r) for r in records.score_report(df.where("false"), "form", "verified").collect()] == [(None, 0, 0, 0, 0.0, 0)]
