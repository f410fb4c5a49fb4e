"""Layout fingerprints and text repair: invariance, and rules against a plain search."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import fingerprints, repair

WORD = "page int, pos int, word string, x0 double, x1 double, y0 double, y1 double"


def words(spark, *pages):
    rows = [(k, i, w, float(x), x + 10.0, float(y), y + 10.0) for k, page in enumerate(pages) for i, (w, x, y) in enumerate(page)]
    return spark.createDataFrame(rows, WORD)


PAGE = [("조사표 제목", 0, 0), ("수심", 10, 10), ("12.5", 60, 10), ("유속", 110, 10), ("폭", 10, 60), ("수심", 110, 60), ("재 질", 110, 110)]


def test_same_layout_whatever_shift_and_scale(spark):
    moved = [(w, 40 + 3 * x, 7 + 2 * y) for w, x, y in PAGE]
    other = [(w, 110 - x, y) for w, x, y in PAGE]
    prints = fingerprints.word_prints(words(spark, PAGE, moved, other, [("abc", 0, 0)]), "page", "pos")
    one = [(r["rank"], r["key"], r["nx"], r["ny"]) for r in prints.where("page = 0").orderBy("rank").collect()]
    assert one == [(1, "수심", 0, 0), (2, "유속", 1, 0), (3, "폭", 0, 0.5), (4, "재질", 1, 1)]
    boxes = spark.createDataFrame([("t", i, w if i % 2 else "", w, float(x), x + 9.0, float(y), y + 9.0) for i, (w, x, y) in enumerate(PAGE[1:2] + PAGE[3:5] + PAGE[6:] + [("칸", 999, 999), (" ", 5, 5)])], "name string, ord int, label string, field string, x0 double, x1 double, y0 double, y1 double")
    scores = fingerprints.layout_scores(prints, fingerprints.box_prints(boxes, "name", "ord"), "page", "name")
    got = {r["page"]: (r["pairs"], r["score"]) for r in scores.collect()}
    assert got[0] == got[1] == (4, 1.0) and got[2][0] == 4 and got[2][1] < 0.6 and 3 not in got
    assert [tuple(r) for r in fingerprints.best_pages(scores, "page", "name").collect()] == [("t", 0, 1.0)]
    assert fingerprints.best_pages(scores, "page", "name", 1.0).count() == 0


def test_one_place_has_no_extent(spark):
    prints = fingerprints.word_prints(words(spark, [("수심", 5, 5)], []), "page", "pos")
    assert [(r["nx"], r["ny"]) for r in prints.collect()] == [(0.0, 0.0)]
    assert fingerprints.word_prints(words(spark, PAGE).where("false"), "page", "pos").count() == 0


def test_greedy_in_the_templates_order(spark):
    """The first label takes the first key that matches, also where a later label would need it."""
    page = words(spark, [("가나", 0, 0), ("가나다", 100, 0), ("라", 0, 100)])
    boxes = spark.createDataFrame([("t", 0, "가", 0.0), ("t", 1, "가나", 50.0), ("t", 2, "가나다라마", 100.0)], "name string, ord int, label string, x0 double").selectExpr("*", "label AS field", "x0 AS x1", "x0 AS y0", "x0 AS y1")
    got = fingerprints.layout_scores(fingerprints.word_prints(page, "page", "pos"), fingerprints.box_prints(boxes, "name", "ord"), "page", "name").collect()
    assert [r["pairs"] for r in got] == [3]


def test_fuzzy_keys_against_all_pairs(spark):
    rnd = random.Random(2)
    stems = ["".join(rnd.choice("가나다라마바") for _ in range(rnd.randrange(1, 12))) for _ in range(60)]
    near = ["".join(c for c in s if rnd.random() > 0.1) + "".join(rnd.choice("가나") for _ in range(rnd.randrange(2))) for s in stems]
    a, b = sorted({*stems[:40], *near} - {""}), sorted({*stems})
    want = {(x, y) for x in a for y in b if x in y or y in x or difflib.SequenceMatcher(None, y, x).ratio() >= 0.85}
    got = fingerprints.matching_keys(*(spark.createDataFrame([(k,) for k in ks], "key string") for ks in (a, b)))
    assert {tuple(r) for r in got.collect()} == want and any(x not in y and y not in x for x, y in want)


def slow_repair(span, labels, terms):
    """One span by the rules, over all known words."""
    big, two = {w for w in {*labels, *terms} if len(w) >= 3}, {w for w in labels if len(w) == 2}

    def parts(c):
        n = ord(c) - 0xAC00
        return n // 588, n // 28 % 21, n % 28

    def near(s):
        found = set()
        for w in big if len(s) > 2 else two:
            apart = [(x, y) for x, y in zip(s, w) if x != y] if len(w) == len(s) else []
            if len(apart) == 1:
                x, y = map(parts, apart[0])
                d = sum(p != q for p, q in zip(x, y))
                if d == 1 or d == 2 and x[2] == y[2] and len(s) > 2:
                    found.add(w)
        return found

    for n in [len(span), *range(len(span) - 1, 2, -1)]:
        if n < 2 or span[:n] in big | two | set(terms):
            return span
        if len(near(span[:n])) == 1:
            return near(span[:n]).pop() + span[n:]
    return span


def test_words_against_a_search(spark):
    rnd = random.Random(4)
    labels, terms = ["둥지", "실패", "개체수"], ["조사시간", "조사시각", "번식지", "흰물떼새", "원앙", "매"]
    spans = {*labels, *terms, "실제", "둥치", "조사시간에", "조사시긴", "개체슈는", "나무", "매"}
    for _ in range(400):
        w = list(rnd.choice([*labels, *terms]) + rnd.choice(["", "", "가", "에서"]))
        at = rnd.randrange(len(w))
        w[at] = chr(max(0xAC00, min(0xD7A3, ord(w[at]) + rnd.choice([0, 1, -1, 28, -28, 56, 588, -588, 616, 29]))))
        spans.add("".join(w))
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    fixed = {r["span"]: r["fixed"] for r in repair.repaired_words(frame(spans).withColumnRenamed("word", "span"), frame(labels), frame(terms)).collect()}
    assert {s: fixed.get(s, s) for s in spans} == {s: slow_repair(s, labels, terms) for s in spans} and len(fixed) > 80


@pytest.mark.parametrize("text, want", [("TOO N60 T00 3OK", "T00 N60 T00 30K"), ("TOO N60", "TOO N60"), ("T00 N60 GOOD F6O", "T00 N60 GOOD F60"), ("T00,N60,NGO,lIA,XBB", "T00,N60,N60,11A,X88"), ("A12 B34 xTOO TOOx", "A12 B34 xTOO TOOx"), ("", ""), (None, None)])
def test_codes(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(repair.fixed_codes(F.col("t"))).first()[0] == want


def test_texts(spark):
    rows = [(1, "노광부리백로가 TOO N60 A12\n둥지합게", "x"), (1, "노광부리백로가 TOO N60 A12\n둥지합게", "y"), (1, "other", "z"), (2, None, "x"), (3, " \t", "x"), (None, "홍길둥 포관", "x"), (4, "둥치", "x")]
    df = spark.createDataFrame(rows, "id int, text string, fixed string")
    labels = spark.createDataFrame([("둥지 (수)",), (None,)], "label string")
    got = repair.repaired(df, "id", "text", labels, pairs=[("홍길둥", "홍길동")])
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "노랑부리백로가 T00 N60 A12\n둥지합계", "x"), (1, "노랑부리백로가 T00 N60 A12\n둥지합계", "y"), (1, "other", "z"), (2, None, "x"), (3, " \t", "x"), (None, "홍길동 포란", "x"), (4, "둥지", "x")], key=repr)
    assert repair.repaired(df.where("false"), "id", "text", labels).count() == 0
