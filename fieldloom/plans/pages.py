"""Queries of page matching, anchored layout and names, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import layout, matching
from .forms import BLANKS, PLACED, WORDS, placed, read

UNITS = [("first", "Survey 1", ["the", "of"]), ("second", "Survey 2", ["de", "in", "der"]), ("loose", "", ["zzz", "and"])]
TITLES = "CASE doc_id % 6 WHEN 0 THEN 'Survey 1' WHEN 1 THEN ' Survey  2' WHEN 2 THEN 'River Survey 1' WHEN 3 THEN '' WHEN 4 THEN 'Survey' ELSE NULL END"
LABELS = [(0, "the"), (1, "of"), (2, "and"), (3, "de"), (4, "to"), (5, "in"), (6, "der"), (7, "it")]
ANCHORS = [("a", "the", 100, 50, "right"), ("b", "and", 300, 200, "below"), ("c", "tion", 0, 0, "right"), ("d", "zzz", 0, 0, "right")]
NAMES = r"CASE event_id % 7 WHEN 0 THEN concat('P', cast(event_id AS STRING), '_', event_type) WHEN 1 THEN 'a/b: *c?  d' WHEN 2 THEN NULL WHEN 3 THEN ' _ ' WHEN 4 THEN concat(event_type, ' 　', repeat('x', 50)) WHEN 5 THEN 'P7_' ELSE event_type END"
TIMES = "CASE event_id % 5 WHEN 0 THEN concat(cast(ts AS STRING), '+02:00') WHEN 1 THEN 'soon' WHEN 2 THEN NULL WHEN 3 THEN substring(cast(ts AS STRING), 1, 10) ELSE concat(substring(cast(ts AS STRING), 1, 19), 'Z') END"


def titled(s, d):
    return read(s, d, "documents").selectExpr("doc_id", "text", f"{TITLES} AS title")


def labels(s):
    at = [(k, label, 620.0, 70.0 * k + 2, 70.0 * k + 2) for k, label in LABELS]
    return s.createDataFrame(at, "box_id int, label string, x1 double, y0 double, y1 double")


def cells(s, d):
    """Words of documents as the cells of a table of twelve columns."""
    w = read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("cell", "text")).where("text <> ''")
    x0, y0 = (F.col("cell") % 12) * F.lit(50.0), F.floor(F.col("cell") / 12) * F.lit(14.0)
    return w.select("doc_id", "cell", "text", x0.alias("x0"), y0.alias("y0"), (x0 + 50).alias("x1"), (y0 + 14).alias("y1"))


def lists(s, d):
    """Forty events as a table: a header, then rows whose numbers stop at places that differ."""
    e = read(s, d, "events").select(F.expr("event_id div 40").alias("tbl"), (F.col("event_id") % 40).alias("i"), "event_type", F.col("value").cast("string").alias("v"))
    head = F.col("i") == 0
    stop = 10 + F.col("tbl") % 25
    no = F.when(head, "No.").when((F.col("i") > 2) & (F.col("i") != stop), F.col("i").cast("string")).otherwise("-")
    name = F.when(head, "종 명").when(F.col("i") % 6 == 5, " ").otherwise(F.col("event_type"))
    amount = F.when(head, "개체수").otherwise(F.col("v"))
    parts = F.array(*[F.struct(F.lit(i).alias("col"), text.alias("text")) for i, text in enumerate((no, name, amount))])
    rows = e.select("tbl", F.col("i").cast("int").alias("row"), F.explode(parts).alias("p"))
    return rows.select("tbl", "row", "p.col", (F.col("row") * 3 + F.col("p.col")).alias("cell"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), "p.text")


def queries() -> dict:
    page = lambda s, d: read(s, d, "documents").select(F.expr("doc_id div 4").alias("file"), (F.col("doc_id") % 4).alias("page"), "text")
    titles = lambda s, d: titled(s, d).crossJoin(F.broadcast(s.createDataFrame([u[:2] for u in UNITS], "unit string, unit_title string")))
    return {
        "label_hit_ratio": lambda s, d: matching.label_scores(read(s, d, "documents"), ["doc_id"], "text", UNITS).select("doc_id", "unit", "hits", F.round("ratio", 6).alias("ratio")),
        "title_rules": lambda s, d: titles(s, d).select("doc_id", "unit", matching.title_match(F.col("title"), F.col("unit_title")).alias("title_score")),
        "title_fuzzy": lambda s, d: read(s, d, "pages").select("page_id", F.round(matching.title_match(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("Survey of rivers")), 6).alias("title_score")),
        "page_assign": lambda s, d: matching.assigned_pages(titled(s, d), ["doc_id"], "title", "text", UNITS),
        "greedy_match": lambda s, d: matching.matched_pages(matching.label_scores(page(s, d), ["file", "page"], "text", UNITS), "file", "page"),
        "line_buckets": lambda s, d: layout.line_buckets(placed(s, d), "doc_id"),
        "offset_median": lambda s, d: layout.page_shifts(cells(s, d).withColumnRenamed("text", "word"), labels(s), "doc_id", "cell"),
        "nearest_label": lambda s, d: layout.anchored_values(cells(s, d), "doc_id", ANCHORS),
        "numbered_lists": lambda s, d: layout.numbered_lists(lists(s, d), "tbl", "종명", "개체수", ("no.", "no")).select("tbl", "r", "name", "count"),
        "safe_names": lambda s, d: read(s, d, "events").selectExpr("event_id", f"{NAMES} AS t").select("event_id", texts.safe_name(F.col("t")).alias("name")),
        "field_labels": lambda s, d: read(s, d, "events").selectExpr("event_id", "event_type", f"{NAMES} AS t").select("event_id", texts.field_label(F.col("t"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).otherwise(" "), F.col("event_id") % 3 == 0).alias("label")),
        "local_times": lambda s, d: read(s, d, "events").selectExpr("event_id", f"{TIMES} AS t").select("event_id", texts.local_time(F.col("t"), "Asia/Seoul").alias("seen")),
    }


def oracle_sql() -> dict[str, str]:
    blanks = BLANKS.replace("'", "''")
    key = lambda c: f"replace(trim(regexp_replace(nfc_normalize(coalesce({c}, '')), '{blanks}', ' ', 'g')), ' ', '')"
    names = NAMES.replace("AS STRING", "AS VARCHAR")
    units = "(VALUES " + ", ".join(f"({i}, '{u}', '{t}', {labels})" for i, (u, t, labels) in enumerate(UNITS)) + ") AS u(rank, unit, unit_title, labels)"
    keyed = f"SELECT doc_id, {key('text')} AS k, {key(TITLES)} AS pt FROM documents"
    hit = "len(list_filter(labels, lambda l: contains(k, l)))"
    rules = "CASE WHEN pt <> '' AND ut <> '' AND regexp_extract(pt, '[0-9]+$') <> '' AND regexp_extract(ut, '[0-9]+$') <> '' AND regexp_extract(pt, '[0-9]+$') <> regexp_extract(ut, '[0-9]+$') THEN -1.0 WHEN pt = '' OR ut = '' THEN 0.0 WHEN pt = ut THEN 1.0 WHEN contains(pt, ut) OR contains(ut, pt) THEN 0.9 END::DOUBLE"
    scored = f"SELECT *, {rules} AS title_score, {hit} AS hits, {hit} / len(labels)::DOUBLE AS ratio FROM (SELECT *, {key('unit_title')} AS ut FROM ({keyed}), {units})"
    chosen = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (title_score >= 0) DESC, 0.6 * title_score + 0.4 * ratio DESC, rank) AS nth FROM ({scored})"
    cell = f"SELECT doc_id, pos AS cell, w AS text, {key('w')} AS k, (pos % 12) * 50.0::DOUBLE AS x0, (pos // 12) * 14.0::DOUBLE AS y0, (pos % 12) * 50.0::DOUBLE + 50 AS x1, (pos // 12) * 14.0::DOUBLE + 14 AS y1 {WORDS}"
    wanted = "(VALUES " + ", ".join(f"('{f}', '{label}', {x}.0::DOUBLE, {y}.0::DOUBLE, '{rel}')" for f, label, x, y, rel in ANCHORS) + ") AS b(field, label, tx, ty, rel)"
    at = "(VALUES " + ", ".join(f"({i}, '{label}', {70.0 * i + 2}::DOUBLE)" for i, label in LABELS) + ") AS b(box_id, label, ty)"
    item = "SELECT event_id // 40 AS tbl, event_id % 40 AS r, CASE WHEN (event_id % 40) % 6 = 5 THEN '' ELSE event_type END AS name, value::VARCHAR AS count, event_id % 40 > 2 AND event_id % 40 <> 10 + (event_id // 40) % 25 AS is_no FROM events WHERE event_id % 40 > 0"
    return {
        "label_hit_ratio": f"SELECT doc_id, unit, hits::INT AS hits, round(ratio, 6) AS ratio FROM ({scored})",
        "title_rules": f"SELECT doc_id, unit, title_score FROM ({scored})",
        "page_assign": f"SELECT doc_id, CASE WHEN title_score >= 0.85 OR (title_score >= 0.7 AND ratio >= 0.25) OR (ratio >= 0.35 AND (ut = '' OR pt = '')) THEN unit END AS unit, round(0.6 * title_score + 0.4 * ratio, 6) AS score FROM ({chosen}) WHERE nth = 1",
        "line_buckets": f"WITH w AS ({PLACED}), g AS (SELECT doc_id, greatest(3.0, 0.6 * quantile_cont(y1 - y0, 0.5)) AS step FROM w GROUP BY 1) SELECT doc_id, round_even((y0 + y1) / 2 / step, 0)::BIGINT AS bucket, count(*) AS n_words, string_agg(word, ' ' ORDER BY x0, word) AS text FROM w JOIN g USING (doc_id) WHERE trim(word) <> '' GROUP BY doc_id, bucket",
        "offset_median": f"WITH f AS (SELECT doc_id, box_id, arg_min(y0 + 7 - ty, row(abs(y0 + 7 - ty), cell)) AS dy FROM ({cell}), {at} WHERE k = label AND length(k) >= 2 AND abs(y0 + 7 - ty) <= 60 AND x1 <= 620 GROUP BY 1, 2), m AS (SELECT doc_id, median(dy) AS mid FROM f GROUP BY 1 HAVING count(*) >= 3 AND abs(median(dy)) > 2) SELECT doc_id, median(dy) AS shift FROM f JOIN m USING (doc_id) WHERE abs(dy - mid) <= 4 GROUP BY 1 HAVING count(*) >= 3",
        "nearest_label": f"WITH c AS MATERIALIZED ({cell}), b AS (SELECT d.k, b.* FROM (SELECT DISTINCT k FROM c) d, {wanted} WHERE contains(d.k, label)), l AS (SELECT * FROM (SELECT c.*, field, rel, row_number() OVER (PARTITION BY doc_id, field ORDER BY k <> label, (x0 - tx) ** 2 + (y0 - ty) ** 2, cell) AS nth FROM c JOIN b USING (k)) WHERE nth = 1) SELECT l.doc_id, field, trim(regexp_replace(nfc_normalize(c.text), '{blanks}', ' ', 'g')) AS value FROM l JOIN c ON c.doc_id = l.doc_id AND c.cell = l.cell + CASE rel WHEN 'right' THEN 1 ELSE 12 END AND (rel = 'below' OR l.cell % 12 < 11)",
        "numbered_lists": f"WITH i AS ({item}), s AS (SELECT *, min(CASE WHEN is_no THEN r END) OVER (PARTITION BY tbl) AS first FROM i), e AS (SELECT *, min(CASE WHEN r > first AND NOT is_no THEN r END) OVER (PARTITION BY tbl) AS stop FROM s) SELECT tbl, r::INT AS r, name, count FROM e WHERE r >= first AND r < coalesce(stop, 99) AND name <> ''",
        "safe_names": f"""SELECT event_id, coalesce(nullif(substring(trim(regexp_replace(coalesce({names}, ''), '[\\\\/:*?"<>|\\s\\x{{3000}}]+', '_', 'g'), '_'), 1, 40), ''), '양식') AS name FROM events""",
        "field_labels": f"SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN nullif(trim(CASE WHEN event_id % 4 > 0 THEN event_type ELSE ' ' END), '') END, nullif(regexp_replace(trim(coalesce({names}, '')), '^P[0-9]+_', ''), ''), '항목') AS label FROM events",
        "local_times": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M') WHEN 1 THEN 'soon' WHEN 2 THEN '' WHEN 3 THEN strftime(ts::DATE + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') ELSE strftime(date_trunc('second', ts) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') END AS seen FROM events",
    }
