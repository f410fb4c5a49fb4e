"""Queries of the form operators: texts, layout and records, each with its DuckDB equivalent.

Inputs are made from the tables by expressions that both engines read, so that
every branch of a rule has rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, texts
from ..operators import layout, quality, records
from ..streaming import entries

#: event_id -> a field's text: units, signs, full-width digits, marks, blanks of several kinds, tokens
NOISY = """CASE event_id % 18 WHEN 0 THEN concat('약 ', cast(event_id AS STRING), '.5 m') WHEN 1 THEN concat('+', cast(event_id AS STRING)) WHEN 2 THEN '.5'
 WHEN 3 THEN '-.25 m' WHEN 4 THEN '１，２３４．５' WHEN 5 THEN concat('  ', cast(event_id AS STRING), ' 　 x') WHEN 6 THEN '' WHEN 7 THEN NULL
 WHEN 8 THEN concat('√ ', event_type) WHEN 9 THEN '□ no x é' WHEN 10 THEN concat(event_type, ' # ', cast(event_id % 5 AS STRING)) WHEN 11 THEN concat('1,', cast(100 + event_id % 900 AS STRING))
 WHEN 12 THEN concat('-', cast(event_id AS STRING), '.0 m 7') WHEN 13 THEN concat('\t', cast(event_id AS STRING), '\n') WHEN 14 THEN concat('\u00a0', cast(event_id AS STRING), '.25\u3000') WHEN 15 THEN '\t' WHEN 16 THEN concat('\u2003', event_type, '\u00a0') ELSE concat(upper(event_type), '_', cast(event_id AS STRING), '′’') END"""
NAMES = """CASE p_partkey % 8 WHEN 0 THEN '수심(m)' WHEN 1 THEN '위도' WHEN 2 THEN concat(p_name, ' (cm)') WHEN 3 THEN '연락처 번호' WHEN 4 THEN '수온' WHEN 5 THEN concat(p_name, ' %') WHEN 6 THEN '' ELSE p_name END"""
SIGNALS = [("garden", ["tree", "flower", "soil"]), ("page", ["the", "and", "ing", "ion"]), ("roman", ["que", "ción"]), ("other", ["ß"])]
BLANKS = texts.BLANKS
WORDS = "FROM (SELECT doc_id, w, pos FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents)) WHERE w <> ''"
PLACED = f"SELECT doc_id, w AS word, pos // 12 AS line, (pos % 12) * 50.0::DOUBLE + (pos % 5) * 9 AS x0, (pos % 12) * 50.0::DOUBLE + (pos % 5) * 9 + 4 * length(w) AS x1, (pos // 12) * 14.0::DOUBLE AS y0, (pos // 12) * 14.0::DOUBLE + 10 AS y1 {WORDS}"


def read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def noisy(s, d):
    return read(s, d, "events").selectExpr("event_id", "event_type", f"{NOISY} AS t")


def placed(s, d):
    """Words of documents on a page of lines with twelve words."""
    w = read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).where("word <> ''")
    x0 = (F.col("pos") % 12) * F.lit(50.0) + (F.col("pos") % 5) * 9
    line = F.floor(F.col("pos") / 12)
    return w.select("doc_id", "word", line.alias("line"), x0.alias("x0"), (x0 + 4 * F.length("word")).alias("x1"), (line * 14.0).alias("y0"), (line * 14.0 + 10).alias("y1"))


def boxes(s, d):
    k = F.col("n_nationkey")
    return read(s, d, "nation").select(k.alias("box_id"), (k % 5 * 110.0).alias("x0"), (k % 5 * 110.0 + 130).alias("x1"), (F.floor(k / 5) * 45.0).alias("y0"), (F.floor(k / 5) * 45.0 + 60).alias("y1"))


def spans(s, d):
    """Nations as table cells: a region is a table, some cells span two rows or columns."""
    k = F.col("n_nationkey")
    return read(s, d, "nation").select(F.col("n_regionkey").alias("tbl"), k.alias("cell"), (k % 4).alias("row"), (k % 3).alias("col"), (k % 2 + 1).alias("row_span"), (F.floor(k / 3) % 2 + 1).alias("col_span"), F.col("n_name").alias("text"))


SPANS = "SELECT n_regionkey AS tbl, n_nationkey AS cell, n_nationkey % 4 AS row, n_nationkey % 3 AS col, n_nationkey % 2 + 1 AS row_span, (n_nationkey // 3) % 2 + 1 AS col_span, n_name AS text FROM nation"
GRID = f"SELECT tbl, r, c, max(cell) AS cell, max_by(text, cell) AS text FROM (SELECT *, unnest(range(row, row + row_span)) AS r FROM ({SPANS})), range(0, 6) g(c) WHERE c >= col AND c < col + col_span GROUP BY ALL"
CHOICES = "SELECT vec_id, dim // {0} AS question, dim % {0} AS choice, round(abs(raw), 4) AS score, dim % 7 = 0 AND raw > 0.2 AS own FROM (SELECT vec_id, (unnest(embedding))::DOUBLE AS raw, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"
ORDERS_LONG = "SELECT o_custkey, 'status' AS field, max(o_orderstatus) AS value FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'orders', count(*)::VARCHAR FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'other', max(CASE WHEN o_orderkey % 9 = 0 THEN 'x' END) FROM orders GROUP BY 1"


def choices(s, d, size):
    """Components of vectors as the darkness of choices, so many a question; four places keep ties and sums exact."""
    e = read(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "raw"))
    raw = F.col("raw").cast("double")
    return e.select("vec_id", F.floor(F.col("dim") / size).alias("question"), (F.col("dim") % size).alias("choice"), F.round(F.abs(raw), 4).alias("score"), ((F.col("dim") % 7 == 0) & (raw > 0.2)).alias("own"))


def orders_wide(s, d):
    return read(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("status"), F.count("*").cast("string").alias("orders"), F.max(F.when(F.col("o_orderkey") % 9 == 0, "x")).alias("other"))


def stream_dedup(s, d):
    """Events sent twice, read as a stream of files, each counted once."""
    events = s.readStream.schema(read(s, d, "events").schema).parquet(f"{d}/[e]vents.parquet")
    twice = events.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("times"), "event_id", "event_type")
    return entries.drained(entries.first_entries(twice, "event_id").select("event_id", "event_type"), "entries")


def queries() -> dict:
    scalar = lambda **rules: lambda s, d: noisy(s, d).select("event_id", *[rule(F.col("t")).alias(n) for n, rule in rules.items()])
    gold = lambda s, d: noisy(s, d).select("event_id", F.lit("f").alias("field"), F.col("t").alias("value"))
    return {
        "normalize": scalar(normal=texts.normalized, key=texts.normalized_key),
        "check_marks": scalar(checked=texts.has_check_mark, unchecked=texts.has_uncheck_box),
        "plain_digits": scalar(digits=texts.plain_digits),
        "first_number_noisy": scalar(number=numbers.first_number),
        "as_number": scalar(number=texts.as_number),
        "leading_number": scalar(number=texts.leading_number, degrees=texts.degrees),
        "coerce": scalar(number=texts.coerced),
        "split_token": scalar(name=texts.token_name, idx=texts.token_index),
        "title_key": scalar(title=texts.title_key),
        "form_ids": lambda s, d: read(s, d, "part").select("p_partkey", texts.is_form_id(F.replace("p_name", F.lit(" "), F.lit(""))).alias("ok")),
        "flags_empty_format": scalar(flag=lambda t: texts.value_flag(t, F.col("event_id") % 2 == 0)),
        "numeric_field_names": lambda s, d: read(s, d, "part").selectExpr("p_partkey", f"{NAMES} AS name").select("p_partkey", texts.is_numeric_name(F.col("name")).alias("is_numeric")),
        "coord_range": lambda s, d: records.coordinate_flags(read(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.concat(F.round(F.col("value") % 50, 2).cast("string"), F.lit("° N"))).alias("value")), 32.0, 40.0).select("event_id", "degrees", "is_outlier"),
        "merge_flags": lambda s, d: records.merged_flags(noisy(s, d).select("event_id", texts.value_flag(F.col("t"), F.lit(True)).alias("flag")), noisy(s, d).where("event_id % 3 = 0").select("event_id"), ["event_id"], "outlier"),
        "eval_score": lambda s, d: records.scores(gold(s, d), noisy(s, d).where("event_id % 5 > 0").select((F.col("event_id") - F.col("event_id") % 2).alias("event_id"), F.lit("f").alias("field"), F.col("t").alias("value")).groupBy("event_id", "field").agg(F.max("value").alias("value")), "event_id", "field"),
        "eval_report": lambda s, d: records.score_report(read(s, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("form"), (F.col("o_orderkey") % 3 > 0).alias("verified"), (F.col("o_orderkey") % 9).alias("total"), F.least(F.col("o_orderkey") % 9, F.col("o_custkey") % 7).alias("correct")), "form", "verified"),
        "detect_form": lambda s, d: records.detected_forms(read(s, d, "documents"), "doc_id", "text", SIGNALS),
        "dedup_boxes": lambda s, d: quality.unique_boxes(noisy(s, d).select("event_type", "event_id", F.coalesce("t", F.lit(" ")).alias("field")), "field", "event_id", ["event_type"]),
        "group_union": lambda s, d: records.grouped_fields(read(s, d, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.concat(F.lit("f"), F.length("text") % 7).alias("field")), "role", "ord", "field"),
        "explode_zip": lambda s, d: records.zipped_rows(read(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", F.length("text").cast("string").alias("v"))))), lambda x: x["v"]).alias("asked"), F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.length("text").cast("string").alias("v"))))), lambda x: x["v"]).alias("said")), ["conv_id"], "asked", "said"),
        "items_to_map": lambda s, d: records.unique_items(read(s, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit("\u00a0"))).alias("name")), "user_id", "name", "event_id").select("event_id", "item"),
        "merged_cells": lambda s, d: layout.covered_cells(spans(s, d), "tbl"),
        "label_neighbour": lambda s, d: layout.right_neighbours(spans(s, d), layout.covered_cells(spans(s, d), "tbl"), "tbl"),
        "words_in_box": lambda s, d: layout.words_in_boxes(placed(s, d), boxes(s, d), "doc_id"),
        "value_right_gap": lambda s, d: layout.value_runs(placed(s, d), "doc_id", "line", 25.0).groupBy("doc_id", "line", "run").agg(F.count("*").alias("n"), F.max("x1").alias("x1")),
        "cluster_1d": lambda s, d: layout.clustered(read(s, d, "events").select("user_id", "event_id", "value"), ["user_id"], "value", 4.0),
        "survey_merge": lambda s, d: layout.renumbered(read(s, d, "conversations").select("conv_id", "turn", (F.length("text") % 5).alias("n_questions")), "conv_id", "turn"),
        "ink_marks": lambda s, d: layout.choice_marks(choices(s, d, 3), ["vec_id", "question"], "choice", "own").withColumn("thr", F.round("thr", 9)),
        "likert_mad": lambda s, d: layout.scale_answers(choices(s, d, 5), ["vec_id", "question"], "choice").withColumn("thr", F.round("thr", 9)),
        "stream_dedup": stream_dedup,
        "entry_rows": lambda s, d: read(s, d, "events").select("event_id", F.date_format(F.col("ts") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd HH:mm").alias("local"), F.get_json_object("props", "$.k").alias("k")),
        "report_fill": lambda s, d: records.filled_tokens(read(s, d, "events").select("event_id", (F.col("event_id") % 30 + 1).alias("cur"), F.when(F.col("event_id") % 3 == 0, "name").when(F.col("event_id") % 3 == 1, F.concat(F.lit("name#"), (F.col("event_id") % 40).cast("string"))).otherwise("missing").alias("token")), read(s, d, "nation").select((F.col("n_nationkey") + 1).alias("idx"), F.lit("name").alias("field"), F.col("n_name").alias("value")), "token").select("event_id", "value"),
        "ocr_pairs": lambda s, d: read(s, d, "documents").select("doc_id", F.md5(texts.replaced_pairs(F.col("text"), [("th", "TH"), ("the", "THE!"), ("ion", "10n")])).alias("digest")),
        "wide_sheet": lambda s, d: records.wide_sheet(records.long_sheet(orders_wide(s, d), ["o_custkey"], ["status", "orders", "other"]), ["o_custkey"], ["status", "orders", "other"]),
        "vertical_sheet": lambda s, d: records.long_sheet(orders_wide(s, d), ["o_custkey"], ["status", "orders", "other"]),
        "record_keys": lambda s, d: read(s, d, "documents").select("doc_id", records.record_key(F.concat(F.col("source"), F.lit(".hwpx")), F.col("lang"), F.col("doc_id")).alias("record_key")),
    }


def oracle_sql() -> dict[str, str]:
    noisy_sql = f"(SELECT event_id, event_type, {NOISY} AS t FROM events)"
    normal = lambda x: f"trim(regexp_replace(nfc_normalize(coalesce({x}, '')), '{BLANKS}', ' ', 'g'))"
    key = lambda x: f"replace({normal(x)}, ' ', '')"
    wide = f"translate(coalesce(t, ''), '{texts.WIDE[0]}', '{texts.WIDE[1]}')"
    quotes = texts.QUOTES[1].replace("'", "''")
    canon = lambda x: f"translate({key(x)}, '{texts.QUOTES[0]}', '{quotes}')"
    pure = lambda x: f"CASE WHEN regexp_matches({strip(x)}, '^[0-9.\\-]+$') THEN try_cast({strip(x)} AS DOUBLE) END"
    flag = lambda num: f"CASE WHEN {strip("coalesce(t, '')")} = '' THEN 'empty' WHEN {num} AND regexp_matches(t, '[^0-9.+\\- ]') THEN 'format' ELSE '' END"
    scored = ", ".join(f"(SELECT count(*) FILTER (WHERE contains(b, w)) FROM (VALUES {', '.join(f'({chr(39)}{w}{chr(39)})' for w in ws)}) v(w)) AS n{i}" for i, (_, ws) in enumerate(SIGNALS))
    strong = " ".join(f"WHEN n{i} >= 2 THEN {i}" for i in range(len(SIGNALS)))
    part = lambda i: f"least(1.0, n{i} / {max(2, 0.5 * len(SIGNALS[i][1]))})"
    best = f"greatest({', '.join(part(i) for i in range(len(SIGNALS)))})"
    weak = " ".join(f"WHEN n{i} > 0 AND {part(i)} = {best} THEN {i}" for i in range(len(SIGNALS)))
    form = " ".join(f"WHEN {i} THEN '{f}'" for i, (f, _) in enumerate(SIGNALS))
    conf = " ".join(f"WHEN {i} THEN round_even({part(i)}, 2)" for i in range(len(SIGNALS)))
    strip = lambda x: f"trim({x}, '{texts.STRIPPED}')"
    middle = lambda a: f"(list_sort({a})[(len({a}) + 1) // 2] + list_sort({a})[len({a}) // 2 + 1]) * 0.5"
    return {
        "normalize": f"SELECT event_id, {normal('t')} AS normal, {key('t')} AS key FROM {noisy_sql}",
        "check_marks": f"SELECT event_id, coalesce(regexp_matches(t, '{texts.CHECKED}'), false) AS checked, coalesce(regexp_matches(t, '{texts.UNCHECKED}'), false) AS unchecked FROM {noisy_sql}",
        "plain_digits": f"SELECT event_id, {wide} AS digits FROM {noisy_sql}",
        "as_number": f"SELECT event_id, CASE WHEN regexp_matches({strip(wide)}, '^[-+]?([0-9][0-9,]*(\\.[0-9]+)?|\\.[0-9]+)$') THEN try_cast(ltrim(replace({strip(wide)}, ',', ''), '+') AS DOUBLE) END AS number FROM {noisy_sql}",
        "leading_number": f"SELECT event_id, try_cast(nullif(regexp_extract({strip('t')}, '^(-?[0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) AS number, try_cast(nullif(regexp_extract(t, '(-?[0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) AS degrees FROM {noisy_sql}",
        "coerce": f"SELECT event_id, try_cast(ltrim(replace({strip('t')}, ',', ''), '+') AS DOUBLE) AS number FROM {noisy_sql}",
        "split_token": f"SELECT event_id, trim(CASE WHEN regexp_matches(t, '#\\s*[0-9]+\\s*$') THEN regexp_replace(t, '#\\s*[0-9]+\\s*$', '') ELSE t END, '{texts.STRIPPED}') AS name, try_cast(nullif(regexp_extract(t, '#\\s*([0-9]+)\\s*$', 1), '') AS BIGINT) AS idx FROM {noisy_sql}",
        "title_key": f"SELECT event_id, lower(regexp_replace(coalesce(t, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS title FROM {noisy_sql}",
        "form_ids": "SELECT p_partkey, regexp_matches(replace(p_name, ' ', ''), '^[a-z0-9]{6,32}$') AS ok FROM part",
        "flags_empty_format": f"SELECT event_id, {flag('event_id % 2 = 0')} AS flag FROM {noisy_sql}",
        "numeric_field_names": f"SELECT p_partkey, trim(name) <> '' AND NOT regexp_matches(name, '{texts.OTHER_WORDS}') AND (regexp_matches(name, '{texts.NUMERIC_WORDS}') OR regexp_matches(name, '{texts.NUMERIC_UNITS}')) AS is_numeric FROM (SELECT p_partkey, {NAMES} AS name FROM part)",
        "coord_range": "SELECT event_id, CASE WHEN event_id % 10 > 0 THEN round(value % 50, 2) END AS degrees, coalesce(event_id % 10 > 0 AND NOT round(value % 50, 2) BETWEEN 32 AND 40, false) AS is_outlier FROM events",
        "merge_flags": f"SELECT event_id, CASE WHEN f <> '' THEN f WHEN event_id % 3 = 0 THEN 'outlier' END AS flag, f = '' AND event_id % 3 = 0 AS added FROM (SELECT event_id, {flag('true')} AS f FROM {noisy_sql})",
        "eval_score": f"""WITH p AS (SELECT event_id - event_id % 2 AS event_id, max(t) AS v FROM {noisy_sql} WHERE event_id % 5 > 0 GROUP BY 1),
j AS (SELECT event_id, coalesce(t, '') AS g, coalesce(v, '') AS p FROM {noisy_sql} LEFT JOIN p USING (event_id)),
m AS (SELECT event_id, CASE WHEN ({pure('g')}) IS NOT NULL AND ({pure('p')}) IS NOT NULL THEN ({pure('g')}) = ({pure('p')}) ELSE {canon('g')} = {canon('p')} END AS ok FROM j)
SELECT event_id, count(*) AS total, count(*) FILTER (WHERE ok) AS correct, round_even(count(*) FILTER (WHERE ok) / count(*), 4) AS accuracy FROM m GROUP BY 1""",
        "eval_report": """WITH s AS (SELECT nullif(o_orderstatus, 'P') AS form, o_orderkey % 3 > 0 AS verified, o_orderkey % 9 AS total, least(o_orderkey % 9, o_custkey % 7) AS correct FROM orders),
g AS (SELECT form, grouping(form) AS whole, count(*) AS records, sum(total)::BIGINT AS total, sum(correct)::BIGINT AS correct, count(*) FILTER (WHERE NOT verified) AS unverified FROM s GROUP BY GROUPING SETS ((form), ()))
SELECT form, records, total, correct, round_even(correct / total, 4) AS accuracy, unverified FROM g WHERE whole = 1 OR form IS NOT NULL""",
        "detect_form": f"""WITH b AS (SELECT doc_id, {key('text')} AS b FROM documents), n AS (SELECT doc_id, {scored} FROM b), r AS (SELECT *, CASE {strong} {weak} END AS i FROM n)
SELECT doc_id, CASE i {form} END AS form, coalesce(CASE i {conf} END, 0)::DOUBLE AS confidence FROM r""",
        "dedup_boxes": f"""WITH n AS (SELECT event_type, event_id, coalesce(t, ' ') AS field, coalesce(nullif({strip("coalesce(t, ' ')")}, ''), '항목') AS name FROM {noisy_sql}),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, name ORDER BY event_id) AS k FROM n) SELECT event_type, event_id, field, CASE WHEN k = 1 THEN name ELSE name || ' (' || k || ')' END AS unique_name FROM r""",
        "group_union": "WITH f AS (SELECT role, 'f' || length(text) % 7 AS field, min(conv_id * 1000 + turn) AS o FROM conversations GROUP BY ALL) SELECT role, min(o) AS first_order, string_agg(field, ',' ORDER BY o, field) AS fields FROM f GROUP BY 1",
        "explode_zip": """WITH n AS (SELECT conv_id, role, length(text)::VARCHAR AS v, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos FROM conversations),
u AS (SELECT * FROM n WHERE role = 'user'), a AS (SELECT * FROM n WHERE role = 'assistant'),
z AS (SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.pos, a.pos)::INTEGER AS pos, coalesce(u.v, '') AS asked, coalesce(a.v, '') AS said FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.pos = a.pos)
SELECT * FROM z UNION ALL SELECT DISTINCT conv_id, 0, '', '' FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM z)""",
        "items_to_map": "WITH n AS (SELECT event_id, event_type AS name, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_id % 11 > 0) SELECT event_id, CASE WHEN k = 1 THEN name ELSE name || ' (' || k || ')' END AS item FROM n",
        "merged_cells": GRID,
        "label_neighbour": f"SELECT s.tbl, s.cell, g.text AS right_text FROM ({SPANS}) s LEFT JOIN ({GRID}) g ON s.tbl = g.tbl AND s.row = g.r AND s.col + s.col_span = g.c",
        "words_in_box": f"""WITH p AS (SELECT doc_id, word, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM ({PLACED})),
b AS (SELECT n_nationkey AS box_id, n_nationkey % 5 * 110.0 AS x0, n_nationkey % 5 * 110.0 + 130 AS x1, n_nationkey // 5 * 45.0 AS y0, n_nationkey // 5 * 45.0 + 60 AS y1 FROM nation)
SELECT doc_id, box_id, count(*) AS n_words, string_agg(word, ' ' ORDER BY round_even(cy / 5, 0), cx, word) AS text FROM p JOIN b ON cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY ALL""",
        "value_right_gap": f"""WITH p AS ({PLACED}), f AS (SELECT *, coalesce((x0 - lag(x1) OVER w > 25)::INT, 0) AS far FROM p WINDOW w AS (PARTITION BY doc_id, line ORDER BY x0, word)),
r AS (SELECT *, (sum(far) OVER (PARTITION BY doc_id, line ORDER BY x0, word ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM f) SELECT doc_id, line, run, count(*) AS n, max(x1) AS x1 FROM r GROUP BY ALL""",
        "cluster_1d": """WITH f AS (SELECT user_id, value, coalesce((value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 4.0)::INT, 0) AS new FROM events),
c AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING))::BIGINT AS cluster FROM f)
SELECT user_id, cluster, list_sort(list(value))[count(*) // 2 + 1] AS centre, count(*) AS n FROM c GROUP BY ALL""",
        "survey_merge": "SELECT conv_id, turn, length(text) % 5 AS n_questions, (coalesce(sum(length(text) % 5) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS first_no FROM conversations",
        "ink_marks": f"""WITH s AS ({CHOICES.format(3)}), q AS (SELECT *, list(score) OVER w AS l FROM s WINDOW w AS (PARTITION BY vec_id, question)),
b AS (SELECT *, CASE WHEN len(l) <= 2 THEN list_min(l) ELSE {middle('l')} END AS base FROM q), t AS (SELECT *, greatest(base + 0.015, base * 1.4) AS thr, list_max(l) - base AS over FROM b), m AS (SELECT *, own OR score >= thr AS marked FROM t),
n AS (SELECT *, count(*) FILTER (WHERE marked) OVER (PARTITION BY vec_id, question) AS hits FROM m)
SELECT vec_id, question, choice, score, round(thr, 9) AS thr, marked, CASE WHEN hits > 0 AND over < 0.015 * 1.5 THEN 'faint' WHEN hits >= 2 AND len(l) >= 3 THEN 'several' WHEN hits = 0 AND over >= 0.015 * 0.6 THEN 'unclear' ELSE '' END AS flag FROM n""",
        "likert_mad": f"""WITH s AS ({CHOICES.format(5)}), q AS (SELECT vec_id, question, list(score ORDER BY choice) AS l FROM s GROUP BY ALL), b AS (SELECT *, {middle('l')} AS base, CASE WHEN len(l) > 2 THEN list_sort(l)[1:len(l) - 1] ELSE l END AS others FROM q),
a AS (SELECT *, list_transform(others, lambda v: abs(v - base)) AS far FROM b), e AS (SELECT *, greatest(0.010, 2.5 * ({middle('far')})) AS delta, list_max(l) - base AS over FROM a), t AS (SELECT *, base + delta AS thr, len(list_filter(l, lambda v: v >= base + delta)) AS hits FROM e)
SELECT vec_id, question, round(thr, 9) AS thr, CASE WHEN hits > 0 THEN list_position(l, list_max(l)) END::BIGINT AS answer, CASE WHEN hits = 1 AND over < delta * 1.6 THEN 'faint' WHEN hits > 1 THEN 'several' WHEN hits = 0 AND over >= delta * 0.6 THEN 'unclear' ELSE '' END AS flag FROM t""",
        "first_number_noisy": f"""SELECT event_id, regexp_replace(regexp_replace(replace(regexp_extract({wide}, '[-+]?([0-9][0-9,]*(\\.[0-9]+)?|\\.[0-9]+)'), ',', ''), '^([-+]?)\\.', '\\10.'), '^\\+', '') AS number FROM {noisy_sql}""",
        "entry_rows": "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS local, props ->> '$.k' AS k FROM events",
        "report_fill": """WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 1 THEN event_id % 40 ELSE event_id % 30 + 1 END AS idx, CASE WHEN event_id % 3 = 2 THEN 'missing' ELSE 'name' END AS field FROM events)
SELECT event_id, coalesce(n_name, '') AS value FROM t LEFT JOIN nation ON n_nationkey + 1 = idx AND field = 'name'""",
        "stream_dedup": "SELECT event_id, event_type FROM events",
        "ocr_pairs": "SELECT doc_id, md5(replace(replace(replace(text, 'the', 'THE!'), 'ion', '10n'), 'th', 'TH')) AS digest FROM documents",
        "wide_sheet": f"SELECT o_custkey, max(value) FILTER (WHERE field = 'status') AS status, max(value) FILTER (WHERE field = 'orders') AS orders, max(value) FILTER (WHERE field = 'other') AS other FROM ({ORDERS_LONG}) GROUP BY 1",
        "vertical_sheet": ORDERS_LONG,
        "record_keys": "SELECT doc_id, concat_ws('::', source || '.hwpx', coalesce(nullif(trim(lang), ''), 'tbl' || doc_id)) AS record_key FROM documents",
    }
