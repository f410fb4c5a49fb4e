"""Survey pages line by line: numbers that go on or restart, several marks, boxes, damaged numbers, answers in words."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import columns, surveys

#: name -> (lines, questions as (no, id, text, choices with stars, free))
CASES = {
    "another prefix begins anew": (["문1. 성함은?", "문2. 나이는?", "1. 만족도는?", "2. 이유는?"], [(1, "문1", "성함은?", "", ""), (2, "문2", "나이는?", "", ""), (1, "1", "만족도는?", "", ""), (2, "2", "이유는?", "", "")]),
    "a page may begin anywhere, a number without a point may not": (["12 이용 현황", "11. 어떻습니까?", "12 편리성은 어떤가", "14. 추천?", "18. 아님"], [(11, "11", "어떻습니까?", "", ""), (12, "12", "편리성은 어떤가", "", ""), (14, "14", "추천?", "", "18. 아님")]),
    "several answers": (["1. 모두 고르시오.", "✓① 봄 ② 여름 ■③ 가을", "■ ④ 겨울"], [(1, "1", "모두 고르시오.", "1:봄*;2:여름;3:가을*;4:겨울*", "")]),
    "answers in words": (["1. 의견을 적으시오.", "좋은 의견 하나", "둘째 줄 의견"], [(1, "1", "의견을 적으시오.", "", "좋은 의견 하나|둘째 줄 의견")]),
    "a question goes on": (["1. 지난 한 해 동안의", "이용 횟수는 몇 번입니까?", "(1) 없음 (2) 한번"], [(1, "1", "지난 한 해 동안의 이용 횟수는 몇 번입니까?", "1:없음;2:한번", "")]),
    "part of a question": (["5. 문제?", "5-1.(5에서 답한 분) 왜?", "6-1 다음", "9-1 아님"], [(5, "5", "문제?", "", ""), (None, "5-1", "(5에서 답한 분) 왜?", "", ""), (None, "6-1", "다음 9-1 아님", "", "")]),
    "a list inside a question is no question": (["1. 고르시오?", "2) 나 3) 다", "1) 가 2) 나"], [(1, "1", "고르시오?", "1:가;2:나", "2) 나 3) 다")]),
    "names beside, below and above": (["연 령 ① 20대 ② 30대", "① 학생 ② 직장인", "직 업", "거주지", "① 시내 ② 시외"], [(None, "연령", "연령", "1:20대;2:30대", ""), (None, "직업", "직업", "1:학생;2:직장인", ""), (None, "거주지", "거주지", "1:시내;2:시외", "")]),
    "a name of two lines": (["성별 ① 남 ② 여", "최근1년간", "① 있다 ② 없다", "방문횟수"], [(None, "성별", "성별", "1:남;2:여", ""), (None, "최근1년간 방문횟수", "최근1년간 방문횟수", "1:있다;2:없다", "")]),
    "choices without a name": (["① 남 ② 여"], [(None, "항목1", "", "1:남;2:여", "")]),
    "boxes before and after names": (["성별 남 □ 여 ☑", "□ 예 □ 아니오"], [(None, "성별", "성별", "1:남;2:여*", ""), (None, "항목2", "", "1:예;2:아니오", "")]),
    "damaged numbers": (["1. 고르시오?", "1) 매우 2y그렇다 3V보통 4) 아니다 5x끝"], [(1, "1", "고르시오?", "1:매우;2:그렇다;3:보통;4:아니다 5x끝", "")]),
    "loose numbers": (["1. 나이?", "25", "3 2 1", "1 2 3 4 5"], [(1, "1", "나이?", "1:;2:;3:;4:;5:", "25|3 2 1")]),
    "a hint is no group": (["1. 예?", "위 ④번과 ⑤번은 아래로", "① 네 ② 아니오"], [(1, "1", "예?", "1:네;2:아니오", "위 ④번과 ⑤번은 아래로")]),
    "nothing": (["※ 안내", "- 3 -", "본문 한 줄"], []),
}


def page_words(spark, cases):
    rows = []
    for k, lines in enumerate(cases):
        for i, line in enumerate(lines):
            rows += [(k, 100 * i + j, w, 50.0 * j, 50.0 * j + 30, 14.0 * i, 14.0 * i + 10) for j, w in enumerate(line.split(" "))]
    return spark.createDataFrame(rows, "page int, pos int, word string, x0 double, x1 double, y0 double, y1 double").withColumn("width", F.lit(700.0))


@pytest.fixture(scope="module")
def parsed(spark):
    words = page_words(spark, [lines for lines, _ in CASES.values()])
    return surveys.parsed_surveys(words, "page", "pos").cache(), words


@pytest.mark.parametrize("name", CASES)
def test_questions(parsed, name):
    rows = [r for r in parsed[0].collect() if r["page"] == list(CASES).index(name)]
    told = lambda cs: ";".join(f"{c['no']}:{c['text']}{'*' * c['marked']}" for c in cs)
    assert [(r["no"], r["qid"], r["text"], told(r["choices"]), "|".join(r["free"])) for r in sorted(rows, key=lambda r: r["nth"])] == CASES[name][1]


def test_answers_and_pages(parsed):
    questions, words = parsed
    at = list(CASES).index
    answers = {(r["page"], r["nth"]): (r["key"], r["answer"]) for r in surveys.survey_answers(questions, "page").collect()}
    assert answers[at("several answers"), 1] == ("1_모두 고르시오", "1:봄;3:가을;4:겨울")
    assert answers[at("answers in words"), 1] == ("1_의견을 적으시오", "좋은 의견 하나 둘째 줄 의견")
    assert answers[at("choices without a name"), 1] == ("항목1", "")
    pages = {r["page"]: r for r in surveys.survey_pages(questions, columns.ordered_lines(words, "page", "pos"), "page").collect()}
    assert len(pages) == len(CASES)
    first = pages[at("another prefix begins anew")]
    assert (first["first_no"], first["last_no"], first["is_survey"]) == (1, 2, False)
    nothing = pages[at("nothing")]
    assert (nothing["n_lines"], nothing["numbered"], nothing["first_no"]) == (3, 0, None)


def test_nulls_and_empty(spark):
    words = page_words(spark, [["1. 예?", "① 가 ② 나"]])
    odd = words.unionByName(words.withColumn("page", F.lit(None).cast("int"))).unionByName(words.withColumn("word", F.lit(None).cast("string")).withColumn("page", F.lit(7)))
    assert [(r["page"], r["qid"]) for r in surveys.parsed_surveys(odd, "page", "pos").collect()] == [(0, "1")]
    assert surveys.parsed_surveys(words.where("false"), "page", "pos").count() == 0
