"""Queries of survey pages: every customer is a page of one of three kinds, so that the SQL can name what each page must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns, surveys
from ..operators.gathered import gathered
from .forms import read

#: lines of a page by its kind; {} is the customer's segment
PAGES = [
    ["1. {} 만족하십니까?", "① 예 ② 아니오 ✓③ 모름", "2. 다음 중 고르시오", "1) 가 2) 나", "3) 다", "성별 ① 남 ② 여"],
    ["문1. {} ① 남 ② 여", "문2. 의견을 적어 주십시오.", "{} 좋은 답변", "2-1. 그 이유는", "무엇입니까?", "문4. 이용 횟수?", "□ 있다 ■ 없다"],
    ["12 {} 현황", "Q3) {}?", "1 2 3 4", "※ 안내", "① 매우 2y그렇다 ③ 보통", "직 업"],
]
#: (kind, place, number, id, text, choices, free) that these pages give; choices as no:text, marked ones with a star
GIVEN = [
    (0, 1, 1, "1", "{} 만족하십니까?", "1:예;2:아니오;3:모름*", ""), (0, 2, 2, "2", "다음 중 고르시오", "1:가;2:나;3:다", ""), (0, 3, None, "성별", "성별", "1:남;2:여", ""),
    (1, 1, 1, "문1", "{}", "1:남;2:여", ""), (1, 2, 2, "문2", "의견을 적어 주십시오.", "", "{} 좋은 답변"), (1, 3, None, "2-1", "그 이유는 무엇입니까?", "", ""), (1, 4, 4, "문4", "이용 횟수?", "1:있다;2:없다*", ""),
    (2, 1, 3, "Q3", "{}?", "1:;2:;3:;4:", ""), (2, 2, None, "직업", "직업", "1:매우;2:그렇다;3:보통", ""),
]


def page_words(s, d):
    lines = F.array(*[F.array(*[F.replace(F.lit(line), F.lit("{}"), F.col("c_mktsegment")) for line in page]) for page in PAGES])
    page = gathered(read(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("c_custkey", F.posexplode(F.get(lines, (F.col("c_custkey") % len(PAGES)).cast("int"))).alias("line", "text"))
    w = page.select("c_custkey", "line", F.posexplode(F.split("text", " ")).alias("nth", "word"))
    x0, y0 = F.col("nth") * 40.0, F.col("line") * 14.0
    return w.select("c_custkey", (F.col("line") * 100 + F.col("nth")).alias("pos"), "word", x0.alias("x0"), (x0 + 30).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1"), F.lit(640.0).alias("width"))


def parsed(s, d):
    return surveys.parsed_surveys(page_words(s, d), "c_custkey", "pos", together=True)


def queries() -> dict:
    told = lambda: F.array_join(F.transform("choices", lambda c: F.concat(c["no"].cast("string"), F.lit(":"), c["text"], F.when(c["marked"], "*").otherwise(""))), ";")
    return {
        "parse_survey": lambda s, d: parsed(s, d).select("c_custkey", "nth", "no", "qid", "text", told().alias("choices"), F.array_join("free", "|").alias("free")),
        "survey_answers": lambda s, d: surveys.survey_answers(parsed(s, d), "c_custkey"),
        "survey_pages": lambda s, d: surveys.survey_pages(parsed(s, d), columns.ordered_lines(page_words(s, d), "c_custkey", "pos", together=True), "c_custkey"),
    }


def oracle_sql() -> dict[str, str]:
    null = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    rows = ", ".join("(" + ", ".join(map(null, g)) + ")" for g in GIVEN)
    put = lambda c: f"replace({c}, '{{}}', c_mktsegment)"
    given = f"SELECT c_custkey, nth, no::INT AS no, {put('qid')} AS qid, {put('t')} AS text, c AS choices, {put('f')} AS free FROM customer JOIN (VALUES {rows}) AS g(kind, nth, no, qid, t, c, f) ON c_custkey % {len(PAGES)} = kind"
    marked = "list_transform(list_filter(string_split(choices, ';'), lambda c: suffix(c, '*')), lambda c: replace(c, '*', ''))"
    lines = ", ".join(f"({k}, {len(p)})" for k, p in enumerate(PAGES))
    return {
        "parse_survey": given,
        "survey_answers": f"SELECT c_custkey, nth, CASE WHEN qid = text THEN qid ELSE qid || '_' || rtrim(substr(text, 1, 18), '?？. ') END AS key, CASE WHEN choices <> '' THEN array_to_string({marked}, ';') ELSE free END AS answer FROM ({given})",
        "survey_pages": f"""WITH q AS ({given}), p AS (SELECT c_custkey, count(no) AS numbered, count(*) FILTER (WHERE choices LIKE '1:%;2:%') AS good, min(no) AS first_no, max(no) AS last_no FROM q GROUP BY 1)
SELECT c_custkey, n::BIGINT AS n_lines, numbered, good, numbered >= 1 AND good >= 2 AND good >= 0.2 * n AS is_survey, first_no, last_no FROM p JOIN (VALUES {lines}) AS l(kind, n) ON c_custkey % {len(PAGES)} = kind""",
    }
