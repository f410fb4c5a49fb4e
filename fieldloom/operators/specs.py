"""Fields of form tables by declared specs: where a field's label stands, its neighbour right or below, and ticked options.

All specs become columns of one plan: the cells of a table are gathered once, and a scan of the
cells gives every field, however many specs there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from . import records

KINDS = ("right", "below", "number_right", "number_below", "checkbox")
OK, EMPTY, MISSING = "ok", "empty", "anchor_missing"
# Words of hints beside which a number is not trusted, and the marks that lead to a block's name and code.
HINTS = "※|붙임|참고|방법|기재|지침"
NAME, CODE, RIVER = r"\(보명칭\)\s*(.+)", r"\(보코드\)\s*([0-9A-Za-z\-]+)", "하천명"
REACH = 8


@dataclass(frozen=True)
class Spec:
    """A field: its name, kind (one of KINDS), label, or the options of a checkbox; required ones are flagged where they lack."""

    name: str
    kind: str
    label: str = ""
    options: Sequence[str] = field(default_factory=tuple)
    required: bool = True

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind of {self.name} is none of {', '.join(KINDS)}: {self.kind}")


def gathered(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cells, n_cols): the cells (cell, row, col, row_span, col_span, text) of each table in their order; spans are 1 at least."""
    span = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(1))).cast("int")
    one = F.struct("cell", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), span("row_span").alias("rows"), span("col_span").alias("cols"), F.coalesce("text", F.lit("")).alias("text"), texts.normalized_key(F.col("text")).alias("key"))
    return cells.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("cells")).withColumn("n_cols", F.array_max(F.transform("cells", lambda c: c["col"] + c["cols"])))


def cell_at(cells: Column, row: Column, col: Column) -> Column:
    """The cell that covers a place, of several the last; null without one."""
    return F.try_element_at(F.filter(cells, lambda c: (c["row"] <= row) & (row < c["row"] + c["rows"]) & (c["col"] <= col) & (col < c["col"] + c["cols"])), F.lit(-1))


def label_cell(cells: Column, label: Column) -> Column:
    """The first cell whose key is the label's, else the first that has it inside; null without one."""
    equal, inside = (F.get(F.filter(cells, test), F.lit(0)) for test in (lambda c: c["key"] == label, lambda c: (label != "") & c["key"].contains(label)))
    return F.coalesce(equal, inside)


def neighbour(cells: Column, cell: Column, side: str) -> Column:
    return cell_at(cells, cell["row"], cell["col"] + cell["cols"]) if side == "right" else cell_at(cells, cell["row"] + cell["rows"], cell["col"])


def trusted_number(text: Column) -> Column:
    """The first number of a text, '' without one or beside a hint."""
    return F.when(text.rlike(HINTS), "").otherwise(F.regexp_extract(text, r"(-?\p{Nd}+(?:\.\p{Nd}+)?)", 1))


def ticked(cells: Column, n_cols: Column, options: Column) -> Column:
    """struct(value, found): the first of the options (keys with their texts) that is ticked, and whether any has a cell.

    A tick stands in the option's cell, right of it within REACH places and before the next option
    of its row, or under it, unless that row has an option too.
    """
    marked = lambda c: texts.has_check_mark(c["text"])
    found = F.filter(F.transform(options, lambda o: F.struct(o["text"].alias("text"), label_cell(cells, o["key"]).alias("c"))), lambda o: o["c"].isNotNull())

    def judge(b):
        others, cells_, last = b["found"], b["cells"], b["n_cols"]
        tick = lambda row, lo, hi: F.exists(F.filter(F.sequence(lo, F.greatest(lo, hi)), lambda c: c < hi), lambda c: F.coalesce(marked(cell_at(cells_, row, c)), F.lit(False)))

        def has(o):
            c = o["c"]
            after = F.array_min(F.transform(F.filter(others, lambda x: (x["c"]["row"] == c["row"]) & (x["c"]["col"] > c["col"])), lambda x: x["c"]["col"]))
            under = c["row"] + c["rows"]
            free = ~F.exists(others, lambda x: x["c"]["row"] == under)
            return marked(c) | tick(c["row"], c["col"] + 1, F.least(F.coalesce(after, last), c["col"] + 1 + REACH)) | (free & tick(under, c["col"], c["col"] + c["cols"] + 1))

        return F.struct(F.coalesce(F.get(F.filter(others, has), F.lit(0))["text"], F.lit("")).alias("value"), (F.size(others) > 0).alias("found"))

    return F.transform(F.array(F.struct(found.alias("found"), cells.alias("cells"), n_cols.alias("n_cols"))), judge)[0]


def applied_specs(cells: DataFrame, keys: list[str], specs: list[Spec]) -> DataFrame:
    """(keys, field, value, status, required): each spec on each table of cells; status is ok, empty or anchor_missing (neither label nor option has a cell)."""
    t = gathered(cells, keys)
    all_cells, n = F.col("cells"), F.col("n_cols")
    key_of = lambda s: F.lit(texts.plain_key(s))
    out = []
    for s in specs:
        if s.kind == "checkbox":
            box = ticked(all_cells, n, F.array(*[F.struct(F.lit(o).alias("text"), key_of(o).alias("key")) for o in s.options]))
            found = F.transform(F.array(box), lambda b: F.struct(b["found"].alias("there"), b["value"].alias("value")))[0]
        else:
            side = "right" if s.kind.endswith("right") else "below"
            raw = lambda c, side=side, s=s: F.coalesce(neighbour(F.col("cells"), c, side)["text"], F.lit(""))
            value = (lambda c: trusted_number(raw(c))) if s.kind.startswith("number") else raw  # noqa: B023
            found = spec_value(label_cell(all_cells, key_of(s.label)), value)
        out.append(F.struct(F.lit(s.name).alias("field"), found.alias("f"), F.lit(s.required).alias("required")))
    rows = t.select(*keys, F.explode(F.array(*out)).alias("s"))
    value = texts.stripped(F.col("s.f.value"))
    status = F.when(~F.col("s.f.there"), MISSING).when(value == "", EMPTY).otherwise(OK)
    return rows.select(*keys, "s.field", value.alias("value"), status.alias("status"), "s.required")


def spec_value(label: Column, value) -> Column:
    """struct(there, value) of a label's cell."""
    one = lambda c: F.struct(c.isNotNull().alias("there"), F.when(c.isNotNull(), value(c)).otherwise("").alias("value"))
    return F.transform(F.array(label), lambda c: one(c))[0]


def mapped_records(fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, values, flags, misaligned, completeness): one record per table of applied specs.

    values has what is ok, flags the status of required fields that are not; misaligned are flagged
    fields without a label. completeness is the share of values among both, to two places, 0 without any.
    """
    entry = lambda value: F.struct("field", value.alias("value"))
    some = lambda cond, value: F.map_from_entries(F.sort_array(F.collect_list(F.when(cond, entry(value)))))
    ok = F.col("status") == OK
    flagged = F.col("required") & ~ok
    out = fields.groupBy(*keys).agg(some(ok, F.col("value")).alias("values"), some(flagged, F.col("status")).alias("flags"), F.sort_array(F.collect_list(F.when(flagged & (F.col("status") == MISSING), F.col("field")))).alias("misaligned"))
    n = F.size("values") + F.size("flags")
    return out.withColumn("completeness", F.when(n == 0, 0.0).otherwise(F.bround(F.size("values") / n, 2)))


def form_blocks(cells: DataFrame, keys: list[str], signals: list[tuple[str, list[str]]], others: tuple[str, ...] = ()) -> DataFrame:
    """(keys, form, confidence, name, code, river): the tables that are forms by the signals in their cells, but for the `others`.

    Name and code are what the first cell with their mark has after it, the river is the text right of
    its label; '' without them.
    """
    t = gathered(cells, keys)
    row = F.struct(*keys)
    forms = records.detected_forms(t.select(row.alias("_row"), F.array_join(F.transform("cells", lambda c: c["key"]), "").alias("_text")), "_row", "_text", signals)
    forms = forms.where(F.col("form").isNotNull() & ~F.col("form").isin(*others)).select("_row.*", "form", "confidence")

    def after(pattern):
        first = F.get(F.filter("cells", lambda c: c["text"].rlike(pattern)), F.lit(0))
        return F.coalesce(texts.stripped(F.regexp_extract(first["text"], pattern, 1)), F.lit(""))

    label = F.get(F.filter("cells", lambda c: c["key"] == texts.plain_key(RIVER)), F.lit(0))
    river = F.transform(F.array(label), lambda c: neighbour(F.col("cells"), c, "right")["text"])[0]
    return forms.join(t, keys).select(*keys, "form", "confidence", after(NAME).alias("name"), after(CODE).alias("code"), F.coalesce(river, F.lit("")).alias("river"))
