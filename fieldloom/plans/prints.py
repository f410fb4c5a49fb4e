"""Queries of layout fingerprints and of text repair, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fingerprints, repair
from .forms import BLANKS, read
from .words import X0, LINE

#: labels of pages here: words that begin with a capital
CAPITAL = "^[A-ZÄÖÜÉÈÇ]"
#: words as they are read; the first ones are right, the others misread or followed by more
READ = ["노랑부리백로", "괭이갈매기", "개체수", "둥지", "실패", "노광부리백로", "광이갈매기가", "둥지합게", "개체슈", "둥치", "실제", "조사시관", "저여새의", "해오라가", "갈매기", "마도요는", "포관", "멀다"]
LABELS = ["둥지 현황 (둥지수)", "실패 원인", "관찰 개체수", "x"]
CODES = ["T00 N60 3OK", "F6O", "30K 3lK", "TOO A12 B34", "OIl word", "Z9B"]


def words(s, d):
    w = read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).where("word <> ''")
    x0, y0 = F.expr(f"CAST({X0} AS DOUBLE)"), F.expr(f"CAST({LINE} * 14.0 AS DOUBLE)")
    return w.select("doc_id", "pos", "word", x0.alias("x0"), (x0 + 4 * F.length("word")).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1"))


def boxes(s, d):
    """A template for each passage: its words as boxes, moved and half as large again."""
    w = read(s, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).where(F.col("word").rlike(CAPITAL))
    x0, y0 = (F.col("pos") % 12) * 67.5 + 40, F.floor(F.col("pos") / 12) * 21.0 + 100
    return w.select("item_id", "pos", F.when(F.col("pos") % 4 > 0, F.col("word")).otherwise("").alias("label"), F.col("word").alias("field"), x0.alias("x0"), (x0 + 30).alias("x1"), y0.alias("y0"), (y0 + 15).alias("y1"))


def scores(s, d, ratio):
    return fingerprints.layout_scores(fingerprints.word_prints(words(s, d), "doc_id", "pos", CAPITAL, 30), fingerprints.box_prints(boxes(s, d), "item_id", "pos"), "doc_id", "item_id", ratio)


def misread(s, d):
    pick = lambda a, n: F.get(F.array(*map(F.lit, a)), (n % len(a)).cast("int"))
    i = F.col("event_id")
    text = F.when(i % 9 == 0, None).when(i % 9 == 1, " ").otherwise(F.concat(pick(READ, i), F.lit(", "), pick(CODES, F.floor(i / 3)), F.lit(" "), pick(READ, F.floor(i / 7)), F.col("event_type")))
    return read(s, d, "events").select("event_id", text.alias("t"))


def queries() -> dict:
    label = lambda s: s.createDataFrame([(x,) for x in LABELS], "label string")
    return {
        "layout_match": lambda s, d: scores(s, d, 1.0),
        "layout_best": lambda s, d: fingerprints.best_pages(scores(s, d, 1.0), "doc_id", "item_id"),
        "layout_match_fuzzy": lambda s, d: scores(s, d, 0.85),
        "word_repair": lambda s, d: repair.repaired(misread(s, d), "event_id", "t", label(s)),
        "code_repair": lambda s, d: misread(s, d).select("event_id", repair.fixed_codes(F.col("t")).alias("t")),
    }


def oracle_sql() -> dict[str, str]:
    key = lambda x: f"replace(trim(regexp_replace(nfc_normalize(coalesce({x}, '')), '{BLANKS}', ' ', 'g')), ' ', '')"
    split = lambda t, k: f"SELECT {k}, w, pos FROM (SELECT {k}, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM {t})"
    placed = lambda name, k: f"{name}f AS (SELECT {k}, key, arg_min({{'x': x, 'y': y, 'pos': pos}}, pos) AS f FROM {name} WHERE key <> '' GROUP BY ALL), {name}n AS (SELECT {k}, key, row_number() OVER (PARTITION BY {k} ORDER BY f.pos, key)::INT AS rank, (f.x - min(f.x) OVER w) / coalesce(nullif(max(f.x) OVER w - min(f.x) OVER w, 0), 1) AS nx, (f.y - min(f.y) OVER w) / coalesce(nullif(max(f.y) OVER w - min(f.y) OVER w, 0), 1) AS ny FROM {name}f WINDOW w AS (PARTITION BY {k}))"
    score = f"""WITH p AS (SELECT doc_id, pos, {key('w')} AS key, (({X0}) + 2 * length(w))::DOUBLE AS x, (pos // 12 * 14.0 + 5)::DOUBLE AS y FROM ({split('documents', 'doc_id')}) WHERE regexp_matches(w, '{CAPITAL}') AND length(w) <= 30), {placed('p', 'doc_id')},
t AS (SELECT item_id, pos, {key('w')} AS key, ((pos % 12) * 67.5 + 55)::DOUBLE AS x, (pos // 12 * 21.0 + 107.5)::DOUBLE AS y FROM ({split('benchmark', 'item_id')}) WHERE regexp_matches(w, '{CAPITAL}')), {placed('t', 'item_id')},
k AS (SELECT p.key AS pk, t.key AS tk FROM (SELECT DISTINCT key FROM pn) p JOIN (SELECT DISTINCT key FROM tn) t ON contains(p.key, t.key) OR contains(t.key, p.key)),
m AS (SELECT doc_id, item_id, list({{'used': [p.rank], 't': t.rank, 'd': sqrt((p.nx - t.nx) * (p.nx - t.nx) + (p.ny - t.ny) * (p.ny - t.ny))}} ORDER BY t.rank, p.rank) AS pairs FROM pn p JOIN k ON p.key = pk JOIN tn t ON t.key = tk GROUP BY ALL),
g AS (SELECT doc_id, item_id, list_reduce(pairs, lambda a, x: CASE WHEN x.t = a.t OR list_contains(a.used, x.used[1]) THEN a ELSE {{'used': list_concat(a.used, x.used), 't': x.t, 'd': a.d + x.d}} END) AS r FROM m), n AS (SELECT item_id, count(*) AS labels FROM tn GROUP BY 1),
s AS (SELECT doc_id, item_id, len(r.used)::INT AS pairs, round_even(len(r.used) / labels * (0.5 + 0.5 * greatest(0.0, 1.0 - r.d / len(r.used))), 3) AS score FROM g JOIN n USING (item_id))"""
    array = lambda a: "[" + ", ".join(f"'{x}'" for x in a) + "]"
    text = f"SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN ' ' ELSE concat({array(READ)}[event_id % {len(READ)} + 1], ', ', {array(CODES)}[(event_id // 3) % {len(CODES)} + 1], ' ', {array(READ)}[(event_id // 7) % {len(READ)} + 1], event_type) END AS t FROM events"
    two, words_of = array(["둥지", "현황", "실패", "원인", "관찰"]), array(sorted({"둥지수", "개체수", *repair.TERMS}))
    # each word that is read, by brute force over all known words
    part = lambda c: f"[(unicode({c}) - 44032) // 588, ((unicode({c}) - 44032) // 28) % 21, (unicode({c}) - 44032) % 28]"
    fixes = f"""d AS (SELECT unnest(list_distinct(list_concat({two}, list_filter({words_of}, lambda w: length(w) >= 3)))) AS word), s AS (SELECT unnest({array(sorted(set(READ)))}) AS span), h AS (SELECT span, n, substring(span, 1, n) AS head FROM s, range(2, 9) r(n) WHERE n <= length(span) AND (n >= 3 OR length(span) = 2)),
c AS (SELECT span, n, head, word, list_filter(range(1, n + 1), lambda i: substring(head, i, 1) <> substring(word, i, 1)) AS spot FROM h JOIN d ON length(word) = n), e AS (SELECT *, {part('substring(head, spot[1], 1)')} AS a, {part('substring(word, spot[1], 1)')} AS b FROM c WHERE len(spot) = 1),
o AS (SELECT span, n, min(word) AS word FROM (SELECT *, (a[1] <> b[1])::INT + (a[2] <> b[2])::INT + (a[3] <> b[3])::INT AS differ FROM e) WHERE differ = 1 OR (differ = 2 AND a[3] = b[3] AND n >= 3) GROUP BY ALL HAVING count(DISTINCT word) = 1),
j AS (SELECT h.span, h.n, word, list_contains(list_concat({two}, {words_of}), head) AS known FROM h LEFT JOIN o ON h.span = o.span AND h.n = o.n), b AS (SELECT span, arg_max({{'n': n, 'known': known, 'word': word}}, n) AS x FROM j WHERE known OR word IS NOT NULL GROUP BY 1),
f AS (SELECT span, x.word || substring(span, x.n + 1) AS fixed FROM b WHERE NOT x.known)"""
    # the codes of these texts, worked out one by one: two are read well in "T00 N60 3OK" and "TOO A12 B34" only
    code = "replace(replace(t, 'T00 N60 3OK', 'T00 N60 30K'), 'TOO A12 B34', 'T00 A12 B34')"
    return {
        "layout_match": f"{score} SELECT * FROM s",
        "layout_best": f"{score} SELECT item_id, -max({{'score': score, 'first': -doc_id}}).first AS doc_id, max({{'score': score, 'first': -doc_id}}).score AS score FROM s WHERE score > 0.4 GROUP BY 1",
        "code_repair": f"SELECT event_id, {code} AS t FROM ({text})",
        "word_repair": f"""WITH t AS (SELECT event_id, replace({code}, '포관', '포란') AS t FROM ({text})), {fixes}, p AS (SELECT event_id, unnest(regexp_extract_all(t, '[가-힣]+|[^가-힣]+')) AS span, generate_subscripts(regexp_extract_all(t, '[가-힣]+|[^가-힣]+'), 1) AS spot FROM t)
SELECT event_id, CASE WHEN any_value(t.t) IS NOT NULL THEN coalesce(string_agg(coalesce(fixed, span), '' ORDER BY spot), any_value(t.t)) END AS t FROM t LEFT JOIN p USING (event_id) LEFT JOIN f USING (span) GROUP BY 1""",
    }
