"""Queries of labels, columns and lines among placed words, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import columns, labels
from ..operators.gathered import gathered
from .forms import BLANKS, WORDS, read

#: a page of twelve words a line; every fifth document has a wider gap in the middle
X0 = "(pos % 12) * 45.0 + (pos % 5) * 4 + CASE WHEN pos % 12 >= 6 THEN (doc_id % 5) * 14 ELSE 0 END"
LINE = "floor(pos / 12)"
WIDTH = 640.0
PLACE = f"doc_id, word, pos, {X0} AS x0, {X0} + 4 * length(word) AS x1, {LINE} * 14.0 AS y0, {LINE} * 14.0 + 10 AS y1, {WIDTH} AS width"


def laid(s, d, together=False):
    """Words of documents on pages; `together`: one page after another."""
    docs = read(s, d, "documents").select("doc_id", "text")
    w = (gathered(docs, "doc_id") if together else docs).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).where("word <> ''")
    return w.selectExpr(*[f"CAST({e.strip().split(' AS ')[0]} AS DOUBLE) AS {e.strip().split(' AS ')[1]}" if " AS " in e else e.strip() for e in PLACE.split(", ")])


def dictionary(s, d):
    """Labels: of each passage its first word, the first two joined, the next three as they are, and five letters of the longest start."""
    w = F.split("text", " ")
    some = F.array(F.get(w, F.lit(0)), F.concat(F.get(w, F.lit(0)), F.get(w, F.lit(1))), F.array_join(F.slice(w, 3, 3), " "), F.substring(F.get(w, F.lit(5)), 2, 5))
    return read(s, d, "benchmark").select(F.explode(some).alias("label")).where("label is not null").distinct()


def marks(s, d):
    """Score heads of users: places at even distances, some missing, some a little off, some at odd places."""
    e = read(s, d, "events").where("event_id % 10 < 7")
    return e.selectExpr("user_id", "floor(event_id / 100) AS head", "300.0 + 40 * (event_id % 10) + CASE WHEN user_id % 7 = 0 THEN event_id % 4 ELSE event_id % 3 END * CASE WHEN user_id % 5 = 0 THEN 6 ELSE 2 END AS x")


def queries() -> dict:
    value = lambda relation: lambda s, d: labels.labelled_values(laid(s, d, True), dictionary(s, d), "doc_id", "pos", relation, together=True)
    return {
        "label_words": lambda s, d: labels.label_words(laid(s, d, True), dictionary(s, d), "doc_id", "pos", together=True),
        "label_value_right": value("right"),
        "label_value_below": value("below"),
        "column_split": lambda s, d: columns.column_split(laid(s, d), "doc_id").withColumn("split", F.round("split", 6)),
        "survey_lines": lambda s, d: columns.ordered_lines(laid(s, d, True), "doc_id", "pos", together=True).select("doc_id", "line_no", F.md5(F.array_join(F.transform("words", lambda w: w["word"]), " ")).alias("digest")),
        "even_columns": lambda s, d: columns.even_columns(marks(s, d), ["user_id", "head"], "x").withColumn("x", F.round("x", 6)),
    }


def oracle_sql() -> dict[str, str]:
    key = lambda x: f"replace(trim(regexp_replace(nfc_normalize(coalesce({x}, '')), '{BLANKS}', ' ', 'g')), ' ', '')"
    strip = lambda x: f"trim({x}, '{texts.STRIPPED}')"
    words = f"SELECT doc_id, w AS word, pos, ({X0})::DOUBLE AS x0, ({X0} + 4 * length(w))::DOUBLE AS x1, (pos // 12 * 14.0)::DOUBLE AS y0, (pos // 12 * 14.0 + 10)::DOUBLE AS y1, {WIDTH}::DOUBLE AS width {WORDS}"
    dictionary_sql = "SELECT DISTINCT unnest([p[1], p[1] || p[2], array_to_string(p[3:5], ' '), substring(p[6], 2, 5)]) AS label FROM (SELECT string_split(text, ' ') AS p FROM benchmark WHERE text IS NOT NULL)"
    row = "PARTITION BY doc_id, line ORDER BY x0, pos"
    near = " UNION ALL ".join(f"SELECT doc_id, 2 AS kind, first AS a, nth AS b, {j} AS c, k || {' || '.join(f'k{i}' for i in range(1, j + 1))} AS text, x0, least(y0, b{j}.y0) AS y0, b{j}.x1 AS x1, greatest(y1, b{j}.y1) AS y1 FROM r WHERE b{j} IS NOT NULL" for j in range(1, 5))
    leads = ", ".join(f"lead(k, {j}) OVER w AS k{j}, lead({{'y0': y0, 'x1': x1, 'y1': y1}}, {j}) OVER w AS b{j}" for j in range(1, 5))
    found = f"""WITH p AS ({words}), k AS (SELECT *, {key('word')} AS k, round_even((y0 + y1) / 2 / 4, 0) AS line FROM p),
r AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, line) AS first, row_number() OVER w AS nth, {leads} FROM k WINDOW w AS ({row})),
l AS (SELECT label, {key('label')} AS text FROM ({dictionary_sql}) WHERE label IS NOT NULL AND {key('label')} <> ''), d AS (SELECT DISTINCT k FROM k), c AS (SELECT d.k, l.label FROM d JOIN l ON contains(d.k, l.text) AND d.k <> l.text),
m AS (SELECT doc_id, label, 1 AS kind, pos AS a, 0 AS b, 0 AS c, x0, y0, x1, y1 FROM k JOIN l ON k = text
UNION ALL SELECT doc_id, label, kind, a, b, c, x0, y0, x1, y1 FROM ({near}) JOIN l USING (text)
UNION ALL SELECT doc_id, label, 3, pos, 0, 0, x0, y0, x1, y1 FROM k JOIN c USING (k)),
f AS (SELECT doc_id, label, kind, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY kind, a, b, c) AS n FROM m) WHERE n = 1)"""
    normal = lambda x: f"trim(regexp_replace(nfc_normalize({x}), '{BLANKS}', ' ', 'g'))"
    beside = lambda at: f"SELECT f.doc_id, f.label, count(v.word) AS n_words, coalesce({normal(f"string_agg(v.word, ' ' ORDER BY {at})")}, '') AS value FROM f LEFT JOIN v ON f.doc_id = v.doc_id AND f.label = v.label GROUP BY 1, 2"
    right = f"""{found}, b AS (SELECT f.label, p.*, CASE WHEN p.x0 - lag(p.x1) OVER w > 45 THEN 1 ELSE 0 END AS far FROM f JOIN p USING (doc_id)
WHERE p.x0 >= f.x1 - 1 AND abs((p.y0 + p.y1) / 2 - (f.y0 + f.y1) / 2) < greatest(p.y1 - p.y0, f.y1 - f.y0) * 0.6 WINDOW w AS (PARTITION BY doc_id, f.label ORDER BY p.x0, p.pos)),
v AS (SELECT * FROM (SELECT *, sum(far) OVER (PARTITION BY doc_id, label ORDER BY x0, pos ROWS UNBOUNDED PRECEDING) AS runs FROM b) WHERE runs = 0) {beside('v.x0, v.pos')}"""
    below = f"""{found}, b AS (SELECT f.label, p.*, min((p.y0 + p.y1) / 2) OVER (PARTITION BY doc_id, f.label) AS top FROM f JOIN p USING (doc_id)
WHERE p.y0 >= f.y1 - 1 AND abs((p.x0 + p.x1) / 2 - (f.x0 + f.x1) / 2) < f.x1 - f.x0 + 30), v AS (SELECT * FROM b WHERE abs((y0 + y1) / 2 - top) < 6) {beside('(v.y0 + v.y1) / 2, (v.x0 + v.x1) / 2, v.pos')}"""
    split = f"""WITH w AS (SELECT * FROM ({words}) WHERE {strip('word')} <> ''), g AS (SELECT DISTINCT doc_id, unnest(range(greatest(0, least(199, floor(x0 / width * 200)))::BIGINT, greatest(0, least(199, floor(x1 / width * 200)))::BIGINT + 1)) AS bin FROM w),
e AS (SELECT doc_id, b AS bin FROM (SELECT DISTINCT doc_id FROM w), range(60, 200) r(b) EXCEPT SELECT doc_id, bin FROM g), i AS (SELECT doc_id, min(bin) AS s, count(*) AS n FROM (SELECT *, bin - row_number() OVER (PARTITION BY doc_id ORDER BY bin) AS island FROM e) GROUP BY doc_id, island),
b AS (SELECT doc_id, (s + n / 2.0) / 200 AS share FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) AS k FROM i WHERE n >= 6 AND s < 140) WHERE k = 1),
o AS (SELECT w.*, share * width AS split, (x0 + x1) / 2 >= share * width AS side FROM w JOIN b USING (doc_id)), h AS (SELECT doc_id, side, greatest(3.0, 0.6 * median(y1 - y0)) AS step FROM o GROUP BY ALL),
c AS (SELECT doc_id, side, count(*) AS n, count(DISTINCT round_even((y0 + y1) / 2 / step, 0)) AS lines, max(split) AS split FROM o JOIN h USING (doc_id, side) GROUP BY ALL),
t AS (SELECT doc_id, max(split) AS split FROM c GROUP BY 1 HAVING count(*) = 2 AND sum(n) >= 20 AND min(n) >= 0.15 * sum(n) AND min(lines) >= 3)"""
    return {
        "label_words": f"{found} SELECT * FROM f",
        "label_value_right": right,
        "label_value_below": below,
        "column_split": f"{split} SELECT doc_id, count(*) AS n_words, round(max(split), 6) AS split FROM w LEFT JOIN t USING (doc_id) GROUP BY 1",
        "survey_lines": f"""{split}, q AS (SELECT w.*, coalesce(((x0 + x1) / 2 >= t.split)::INT, 0) AS right_side FROM w LEFT JOIN t USING (doc_id)), z AS (SELECT doc_id, right_side, greatest(3.0, 0.6 * median(y1 - y0)) AS step FROM q GROUP BY ALL),
y AS (SELECT doc_id, right_side, round_even((y0 + y1) / 2 / step, 0) AS line, string_agg(word, ' ' ORDER BY x0, pos) AS text FROM q JOIN z USING (doc_id, right_side) GROUP BY ALL) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY right_side, line))::INT AS line_no, md5(text) AS digest FROM y""",
        "even_columns": """WITH m AS (SELECT user_id, event_id // 100 AS head, (300.0 + 40 * (event_id % 10) + CASE WHEN user_id % 7 = 0 THEN event_id % 4 ELSE event_id % 3 END * CASE WHEN user_id % 5 = 0 THEN 6 ELSE 2 END)::DOUBLE AS x FROM events WHERE event_id % 10 < 7),
p AS (SELECT *, lead(x) OVER (PARTITION BY user_id, head ORDER BY x) AS y, row_number() OVER (PARTITION BY user_id, head ORDER BY x) AS nth, count(*) OVER (PARTITION BY user_id, head) AS n FROM m),
s AS (SELECT *, min(y - x) OVER (PARTITION BY user_id, head) AS step FROM p), f AS (SELECT *, (y - x) / step AS times FROM s WHERE step > 0 AND n >= 3),
g AS (SELECT user_id, head FROM f GROUP BY 1, 2 HAVING coalesce(max(abs(times - round_even(times, 0))), 0) <= 0.25),
e AS (SELECT f.*, unnest(range(0, coalesce(round_even(times, 0), 1)::BIGINT)) AS i FROM f SEMI JOIN g USING (user_id, head)), c AS (SELECT user_id, head, CASE WHEN i = 0 THEN x ELSE x + (y - x) * i / round_even(times, 0) END AS x, i = 0 AS given FROM e)
SELECT user_id, head, (row_number() OVER (PARTITION BY user_id, head ORDER BY x))::INT AS "column", round(x, 6) AS x, given FROM c""",
    }
