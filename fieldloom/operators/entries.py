"""Entries of digital forms as sheet rows: a column for each field of the definition, and a row for each line of their tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts

# The names of a sheet's first columns, the column of a table without any, and the mark of a ticked value.
FILE, CREATED, PLACE, RECORD = "_파일명", "기록일시", ("위도", "경도", "위치오차m"), "기록"
ONE_COLUMN, TICK = "값", "√"
KINDS = ("text", "number", "title", "check", "image", "table")


@dataclass(frozen=True)
class Field:
    """A field of a form: key, kind (one of KINDS), the label of a check, the value of a title, the columns of a table."""

    key: str
    kind: str = "text"
    label: str = ""
    value: str = ""
    columns: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind of {self.key} is none of {', '.join(KINDS)}: {self.kind}")


def at(value: Column, key: str, kind: str = "variant") -> Column:
    """The value under a key of a variant object; null without it. A key may hold quotes of one kind only."""
    mark = '"' if "'" in key else "'"
    if mark in key:
        raise ValueError(f"a key cannot hold both kinds of quotes: {key}")
    return F.try_variant_get(value, f"$[{mark}{key}{mark}]", kind)


def plain(value: Column) -> Column:
    """A variant as text: nothing and false are '', true a tick, whole numbers without a point, texts stripped, lists and objects JSON."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 1e18), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    return (
        F.when(value.isNull() | F.is_variant_null(value), "")
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), TICK).otherwise(""))
        .when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), whole)
        .when(kind.rlike("^(ARRAY|OBJECT)"), F.to_json(value))
        .otherwise(F.coalesce(texts.stripped(F.try_variant_get(value, "$", "string")), F.lit(""))))


def ticked(value: Column) -> Column:
    """true, or a text or number that says true or 1."""
    return F.coalesce(F.lower(F.try_variant_get(value, "$", "string")).isin("true", "1"), F.lit(False))


def sheet_columns(fields: Sequence[Field], gps: bool = False) -> list[tuple[str, Field | None, str]]:
    """(name, field, column of a table or '') of a sheet, in order; a table's column with a name that is taken is named field_column."""
    first = [CREATED, *(PLACE if gps else ())]
    taken = {FILE, *first, *(f.key for f in fields if f.kind != "table")}
    out: list[tuple[str, Field | None, str]] = [(FILE, None, ""), *((c, None, "") for c in first)]
    for f in fields:
        if f.kind != "table":
            out.append((f.key, f, ""))
            continue
        for c in f.columns or (ONE_COLUMN,):
            name = f"{f.key}_{c}" if c in taken else c
            taken.add(name)
            out.append((name, f, c))
    return out


def entry_rows(entries: DataFrame, fields: Sequence[Field], gps: bool = False, zone: str = "Asia/Seoul") -> DataFrame:
    """(seq, line, sheet columns): entries(seq, created, values, meta, photos), the last three JSON objects, as rows of texts.

    Tables lie side by side, one line a row, the shorter ones blank; an entry without lines has one row,
    and photos stand in its first row only. A table is a list, of which what is no object is left out.
    Broken JSON counts as an empty object. Null entries of any column give '' there.
    """
    v = entries.select("seq", "created", *[F.try_parse_json(c).alias(c) for c in ("values", "meta", "photos")])
    tables = [f for f in fields if f.kind == "table"]
    lines = {f.key: f"_t{i}" for i, f in enumerate(tables)}
    for f in tables:
        listed = F.coalesce(at(F.col("values"), f.key, "array<variant>"), F.expr("cast(array() as array<variant>)"))
        v = v.withColumn(lines[f.key], F.filter(listed, lambda x: F.schema_of_variant(x).startswith("OBJECT")))
    n = F.greatest(F.lit(1), F.lit(1), *[F.size(c) for c in lines.values()])
    v = v.withColumn("line", F.explode(F.sequence(F.lit(0), n - 1)))
    place = dict(zip(PLACE, ("lat", "lon", "acc")))

    def cell(name: str, f: Field | None, column: str) -> Column:
        if f is None:
            if name == FILE:
                return F.concat(F.lit(f"{RECORD} "), F.coalesce(F.col("seq").cast("string"), F.lit("")))
            return texts.local_time(F.col("created"), zone) if name == CREATED else plain(at(at(F.col("meta"), "gps"), place[name]))
        value = at(F.col("values"), f.key)
        if f.kind == "table":
            return plain(at(F.get(lines[f.key], F.col("line")), column))
        if f.kind == "title":
            return F.lit(f.value)
        if f.kind == "check":
            return F.when(ticked(value), f.label or f.key).otherwise("")
        if f.kind == "image":
            return F.when(F.col("line") == 0, F.coalesce(at(F.col("photos"), f.key, "string"), F.lit(""))).otherwise("")
        return plain(value)

    return v.select("seq", "line", *[cell(*c).alias(c[0]) for c in sheet_columns(fields, gps)])
