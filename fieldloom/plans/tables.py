"""Queries of table specs, form blocks and bundles; every event is a table of one of three kinds, so that the SQL can name what each must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entries as sheets
from ..operators import matching, specs
from ..streaming import entries
from .forms import read
from .pages import UNITS

#: cells of a table by its kind: (row, col, row span, column span, text); {} is the event's type
TABLES = [
    [(0, 0, 1, 1, "하천명"), (0, 1, 1, 1, "{} 천"), (0, 2, 1, 1, "보 길이"), (0, 3, 1, 1, "재 질 (보명칭) {} 보 "), (1, 0, 1, 1, "위도"), (1, 1, 1, 1, "\t"), (1, 2, 1, 1, "약 12.5 m"), (1, 3, 1, 1, "콘크리트"), (1, 4, 1, 1, "√"), (1, 5, 1, 1, "돌"), (1, 6, 1, 1, "")],
    [(0, 0, 1, 2, "하천명 (주)"), (0, 2, 1, 1, "{}"), (1, 0, 1, 1, "보 길이"), (1, 1, 1, 1, "여 가"), (2, 0, 1, 1, "※ 3 이상"), (2, 1, 1, 1, "√"), (3, 0, 1, 3, "(보코드) A-7 / 사진 상류방향")],
    [(0, 0, 2, 1, "재질"), (0, 1, 1, 1, "콘크리트"), (0, 2, 1, 1, ""), (1, 1, 1, 1, "돌"), (1, 2, 1, 1, "✓"), (2, 0, 1, 1, "이동 ☑"), (2, 1, 1, 1, "위도"), (2, 2, 1, 1, "37.5"), (3, 1, 1, 1, "보길이"), (4, 0, 1, 3, "-3.25 (하단)")],
]
SPECS = [specs.Spec("하천", "right", "하천명"), specs.Spec("보길이", "number_below", "보 길이"), specs.Spec("위도", "right", "위도"), specs.Spec("재질", "checkbox", options=("콘크리트", "돌", "복합")), specs.Spec("용도", "checkbox", options=("여가", "이동"), required=False)]
#: (kind, field, value, status) that these tables give
GIVEN = [
    (0, "하천", "{} 천", "ok"), (0, "보길이", "12.5", "ok"), (0, "위도", "", "empty"), (0, "재질", "콘크리트", "ok"), (0, "용도", "", "anchor_missing"),
    (1, "하천", "{}", "ok"), (1, "보길이", "", "empty"), (1, "위도", "", "anchor_missing"), (1, "재질", "", "anchor_missing"), (1, "용도", "여가", "ok"),
    (2, "하천", "", "anchor_missing"), (2, "보길이", "-3.25", "ok"), (2, "위도", "37.5", "ok"), (2, "재질", "돌", "ok"), (2, "용도", "이동", "ok"),
]
SIGNALS = [("structure", ["보길이", "콘크리트", "재질"]), ("photo", ["상류방향", "하류방향"]), ("other", ["여가"])]


def cells(s, d):
    tables = F.array(*[F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("row", "col", "row_span", "col_span"), c)], F.replace(F.lit(c[4]), F.lit("{}"), F.col("event_type")).alias("text")) for c in t]) for t in TABLES])
    return read(s, d, "events").select("event_id", F.posexplode(F.get(tables, (F.col("event_id") % len(TABLES)).cast("int"))).alias("cell", "c")).select("event_id", "cell", "c.*")


def fields(s, d):
    return specs.applied_specs(cells(s, d), ["event_id"], SPECS)


#: entries by their kind: values, meta, photos; {} is the event's type
ENTRIES = [
    ('{"이름": " {} ", "깊이": 2.0, "맑음": true, "종": [{"이름": "붕어", "수": 3}, "x", {"이름": "{}"}], "물": [{"수": 1.5}]}', '{"gps": {"lat": 37.5}}', '{"사진": "{}.jpg"}'),
    ('{"이름": false, "깊이": "1,2", "맑음": "0", "물": []}', "{}", None),
    ("no json", None, "[]"),
]
SHEET = [sheets.Field("제목", "title", value="조사표"), sheets.Field("이름"), sheets.Field("깊이", "number"), sheets.Field("맑음", "check", label="예"), sheets.Field("사진", "image"), sheets.Field("종", "table", columns=("이름", "수")), sheets.Field("물", "table", columns=("수",))]
#: (kind, line, then 위도 to 물_수) that these entries give
SHEET_ROWS = [(0, 0, "37.5", "", "", "조사표", "{}", "2", "예", "{}.jpg", "붕어", "3", "1.5"), (0, 1, "37.5", "", "", "조사표", "{}", "2", "예", "", "{}", "", ""), (1, 0, "", "", "", "조사표", "", "1,2", "", "", "", "", ""), (2, 0, "", "", "", "조사표", "", "", "", "", "", "", "")]

KIND = "CASE event_id % 50 WHEN 11 THEN 'close' WHEN 23 THEN 'open' ELSE 'entry' END"
ENTRY = "CASE WHEN event_id % 17 = 0 THEN 'bad id' ELSE concat('entry-', CAST(1000000 + event_id - event_id % 3 AS STRING)) END"


def sheet_rows(s, d):
    put = lambda t: F.lit(None).cast("string") if t is None else F.replace(F.lit(t), F.lit("{}"), F.col("event_type")) if t != "{}" else F.lit("{}")
    made = F.get(F.array(*[F.struct(*[put(t).alias(n) for n, t in zip(("values", "meta", "photos"), e)]) for e in ENTRIES]), (F.col("event_id") % len(ENTRIES)).cast("int"))
    e = read(s, d, "events").select(F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"), made.alias("e")).select("seq", "created", "e.*")
    return sheets.entry_rows(e, SHEET, gps=True)


def entries_received(s, d):
    """Events as a stream of entries, of which some close and open their form again."""
    events = s.readStream.schema(read(s, d, "events").schema).parquet(f"{d}/[e]vents.parquet")
    return entries.drained(entries.received(events.selectExpr("event_type", "event_id AS at", f"{KIND} AS kind", f"{ENTRY} AS id"), "event_type"), "receipts")


def queries() -> dict:
    page = lambda s, d: read(s, d, "documents").select(F.expr("doc_id div 12").alias("file"), (F.col("doc_id") % 12).alias("page"), "text")
    told = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return {
        "spec_fields": fields,
        "spec_records": lambda s, d: specs.mapped_records(fields(s, d), ["event_id"]).select("event_id", told("values").alias("values"), told("flags").alias("flags"), F.array_join("misaligned", ";").alias("misaligned"), "completeness"),
        "form_blocks": lambda s, d: specs.form_blocks(cells(s, d), ["event_id"], SIGNALS, ("photo",)),
        "entries_received": entries_received,
        "entry_sheet": sheet_rows,
        "bundle_match": lambda s, d: matching.matched_bundles(matching.label_scores(page(s, d), ["file", "page"], "text", UNITS), "file", "page"),
    }


def oracle_sql() -> dict[str, str]:
    rows = ", ".join(f"({k}, '{f}', '{v}', '{st}', {str(next(s.required for s in SPECS if s.name == f)).lower()})" for k, f, v, st in GIVEN)
    given = f"SELECT event_id, field, replace(v, '{{}}', event_type) AS value, status, required FROM events JOIN (VALUES {rows}) AS g(kind, field, v, status, required) ON event_id % {len(TABLES)} = kind"
    told = lambda what, cond: f"coalesce(string_agg(field || '=' || {what}, ';' ORDER BY field) FILTER (WHERE {cond}), '')"
    flagged = "required AND status <> 'ok'"
    names = [name for name, *_ in sheets.sheet_columns(SHEET, gps=True)][2:]
    lines = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in SHEET_ROWS)
    cells_of = ", ".join(f"""replace(c{i}, '{{}}', event_type) AS "{name}\"""" for i, name in enumerate(names))
    return {
        "entry_sheet": f"""SELECT event_id AS seq, line::INT AS line, '기록 ' || event_id AS "_파일명", strftime(date_trunc('second', ts) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS "기록일시", {cells_of}
FROM events JOIN (VALUES {lines}) AS g(kind, line, {", ".join(f"c{i}" for i in range(len(names)))}) ON event_id % {len(ENTRIES)} = kind""",
        "spec_fields": given,
        "spec_records": f"""SELECT event_id, {told('value', "status = 'ok'")} AS "values", {told('status', flagged)} AS flags, coalesce(string_agg(field, ';' ORDER BY field) FILTER (WHERE {flagged} AND status = 'anchor_missing'), '') AS misaligned,
round_even(count(*) FILTER (WHERE status = 'ok') / count(*) FILTER (WHERE status = 'ok' OR ({flagged})), 2) AS completeness FROM ({given}) GROUP BY 1""",
        "entries_received": f"""WITH e AS (SELECT event_type, event_id AS "at", {KIND} AS kind, {ENTRY.replace('AS STRING', 'AS VARCHAR')} AS id FROM events), c AS (SELECT *, coalesce(last_value(CASE kind WHEN 'close' THEN true WHEN 'open' THEN false END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY "at" ROWS UNBOUNDED PRECEDING), false) AS closed FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type, id, kind = 'entry' AND NOT closed AND id <> 'bad id' ORDER BY "at") AS nth FROM c), r AS (SELECT *, CASE WHEN closed THEN 'closed' WHEN id = 'bad id' THEN 'invalid' WHEN nth = 1 THEN 'taken' ELSE 'duplicate' END AS status FROM f WHERE kind = 'entry'),
n AS (SELECT *, CASE WHEN status = 'taken' THEN count(*) FILTER (WHERE status = 'taken') OVER (PARTITION BY event_type ORDER BY "at") END AS seq FROM r)
SELECT event_type, "at", id, status, CASE WHEN status IN ('taken', 'duplicate') THEN max(seq) FILTER (WHERE status = 'taken') OVER (PARTITION BY event_type, id) END AS seq FROM n""",
        # kind 0 has three signals of the first form, kind 1 one of each and the photo's share is the largest, kind 2 three
        "form_blocks": "SELECT event_id, 'structure' AS form, 1.0::DOUBLE AS confidence, CASE event_id % 3 WHEN 0 THEN event_type || ' 보' ELSE '' END AS name, '' AS code, CASE event_id % 3 WHEN 0 THEN event_type || ' 천' ELSE '' END AS river FROM events WHERE event_id % 3 <> 1 UNION ALL SELECT event_id, 'structure', 0.5, '', 'A-7', '' FROM events WHERE event_id % 3 = 1",
    }
