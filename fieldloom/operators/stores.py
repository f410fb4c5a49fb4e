"""Keyed upserts, corrections, grouped summaries and incremental reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts


def upsert_last(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last row of each key keeps the place of the first; of rows with one order value the greatest counts, whole."""
    last = F.max_by(F.struct(*columns), F.struct(order, *columns))
    return rows.groupBy(key).agg(F.min(order).alias("first_pos"), last.alias("_last")).select(key, "first_pos", *[f"_last.{c}" for c in columns])


def corrected(rows: DataFrame, corrections: DataFrame, record: list[str], field: str, order: str) -> DataFrame:
    """The last correction (record, field, order, new_value) of a field replaces value, even by null, and clears flag.

    A record that is known gets a corrected field that it lacks; corrections of unknown records do nothing.
    """
    last = corrections.groupBy(*record, field).agg(F.max_by(F.struct("new_value"), order).alias("_c"))
    last = last.join(rows.select(*record).distinct(), record, "left_semi")
    j = rows.join(last, [*record, field], "full")
    hit = F.col("_c").isNotNull()
    return j.withColumn("flag", F.when(hit, F.lit("")).otherwise(F.col("flag"))).withColumn("value", F.when(hit, F.col("_c.new_value")).otherwise(F.col("value"))).drop("_c")


def first_non_empty(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """(key, first_value): the first value that is not blank; null without one."""
    there = texts.stripped(F.col(column)) != ""
    return rows.groupBy(key).agg(F.min_by(column, F.when(there, F.col(order))).alias("_v"), F.count_if(there).alias("_n")).select(key, F.when(F.col("_n") > 0, F.col("_v")).alias("first_value"))


def incremental(rows: DataFrame, seq: str, since: int, limit: int = 500) -> DataFrame:
    """The next page of at most `limit` entries after `since`."""
    return rows.where(F.col(seq) > since).orderBy(seq).limit(limit)


def sync(rows: DataFrame, seq: str, since: int, key: str, known: DataFrame) -> DataFrame:
    """All entries after `since` with a key that is not among the known ones; of a repeated key the first."""
    new = rows.where((F.col(seq) > since) & F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti")
    first = new.groupBy(key).agg(F.min_by(F.struct(*rows.columns), seq).alias("_first"))
    return first.select("_first.*")


def idempotent(entries: DataFrame, key: str, seq: str) -> DataFrame:
    """An entry that is sent again counts once, as first sent; times_sent counts all."""
    others = [c for c in entries.columns if c not in (key, seq)]
    first = entries.groupBy(key).agg(F.min_by(F.struct(seq, *others), seq).alias("_first"), F.count("*").alias("times_sent"))
    return first.select(key, F.col(f"_first.{seq}").alias("seq"), *[f"_first.{c}" for c in others], "times_sent")


def label_counts(rows: DataFrame, columns: list[str], blank: str = "기타") -> DataFrame:
    """(label, n): rows by the first of the columns (label, title, form) that is neither null nor ''."""
    label = F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(blank))
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
