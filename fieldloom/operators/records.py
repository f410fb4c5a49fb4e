"""Records in long and wide form: flags, scores, forms, reports and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import texts


def coordinate_flags(values: DataFrame, low: float, high: float) -> DataFrame:
    """values(.., value text) with degrees and whether they lie outside the range; no number is no outlier."""
    return values.withColumn("degrees", texts.degrees(F.col("value"))).withColumn("is_outlier", F.coalesce(~F.col("degrees").between(low, high), F.lit(False)))


def merged_flags(flags: DataFrame, found: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Existing flags win; a found outlier without one gets the tag."""
    both = flags.join(found.select(*keys, F.lit(tag).alias("_tag")).distinct(), keys, "full")
    return both.withColumn("added", (F.coalesce(F.col("flag"), F.lit("")) == "") & F.col("_tag").isNotNull()).withColumn("flag", F.when(F.coalesce(F.col("flag"), F.lit("")) != "", F.col("flag")).otherwise(F.col("_tag"))).drop("_tag")


def scores(gold: DataFrame, found: DataFrame, record: str, field: str) -> DataFrame:
    """(record, total, correct, accuracy) over the gold fields; a missing prediction counts as empty."""
    j = gold.join(found.withColumnRenamed("value", "_found"), [record, field], "left")
    ok = texts.field_match(F.coalesce("value", F.lit("")), F.coalesce("_found", F.lit("")))
    return j.groupBy(record).agg(F.count("*").alias("total"), F.count_if(ok).alias("correct")).withColumn("accuracy", F.bround(F.col("correct") / F.col("total"), 4))


def score_report(scored: DataFrame, form: str, verified: str) -> DataFrame:
    """(form, records, total, correct, accuracy, unverified): the sums of scores (form, verified, total, correct) by form, and of all with a null form.

    accuracy is 0 without a field; unverified counts the records whose gold values nobody has checked.
    Records with a null form count in the whole only.
    """
    sums = [F.count("*").alias("records"), F.sum("total").alias("total"), F.sum("correct").alias("correct"), F.count_if(~F.coalesce(F.col(verified), F.lit(False))).alias("unverified")]
    both = scored.where(F.col(form).isNotNull()).groupBy(form).agg(*sums).unionByName(scored.agg(F.lit(None).cast(scored.schema[form].dataType).alias(form), *sums))
    accuracy = F.when(F.coalesce("total", F.lit(0)) > 0, F.bround(F.col("correct") / F.col("total"), 4)).otherwise(0.0)
    return both.select(form, "records", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("correct", F.lit(0)).alias("correct"), accuracy.alias("accuracy"), "unverified")


def detected_forms(pages: DataFrame, page: str, text: str, signals: list[tuple[str, list[str]]]) -> DataFrame:
    """(page, form, confidence): the first form of the list with two signals or more in the text, else the best with one; null without any."""
    def best(blob):
        found = []
        for rank, (form, words) in enumerate(signals):
            n = sum((blob.contains(w).cast("int") for w in words), F.lit(0))
            share = F.least(F.lit(1.0), n / max(2, 0.5 * len(words)))
            found.append(F.struct((n < 2).alias("weak"), F.when(n < 2, -share).otherwise(0.0).alias("order"), F.lit(rank).alias("rank"), F.lit(form).alias("form"), F.bround(share, 2).alias("confidence"), n.alias("n")))
        return F.array_min(F.filter(F.array(*found), lambda s: s["n"] > 0))

    # an array of one binds the text's key, which is then made once
    form = pages.select(page, F.transform(F.array(texts.normalized_key(F.col(text))), best)[0].alias("best"))
    return form.select(page, "best.form", F.coalesce("best.confidence", F.lit(0.0)).alias("confidence"))


def zipped_rows(tables: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Two arrays side by side, one row per place, the short side ''; empty arrays keep one row."""
    z = F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))
    return tables.select(*keys, F.posexplode_outer(z).alias("pos", "z")).select(*keys, F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("z.l", F.lit("")).alias(left), F.coalesce("z.r", F.lit("")).alias(right))


def unique_items(items: DataFrame, record: str, name: str, order: str) -> DataFrame:
    """Blank names go; a stripped name that is taken becomes 'name (n)' with the least free n from 2 on, in the order given.

    Records with a name that itself ends in '(n)' are folded name by name; in all others the n-th
    repeat gets n. The names of one record are held together.
    """
    named = items.withColumn("_name", texts.stripped(F.col(name))).where("_name <> ''")
    numbered = lambda k, n: F.concat(k, F.lit(" ("), n.cast("string"), F.lit(")"))
    clash = F.max(F.col("_name").rlike(r" \([0-9]+\)$")).over(Window.partitionBy(record))
    named = named.withColumn("_clash", clash)
    n = F.row_number().over(Window.partitionBy(record, "_name").orderBy(order))
    usual = named.where("not _clash").withColumn("item", F.when(n == 1, F.col("_name")).otherwise(numbered(F.col("_name"), n))).drop("_name", "_clash")

    def step(took, k):
        free = lambda x: ~F.array_contains(took, x)
        other = F.filter(F.sequence(F.lit(2), F.size(took) + 2), lambda n: free(numbered(k, n)))
        return F.concat(took, F.array(F.when(free(k), k).otherwise(numbered(k, F.get(other, F.lit(0))))))

    row = F.struct(F.col(order).alias("_order"), "_name", F.struct(*items.columns).alias("_row"))
    folded = named.where("_clash").groupBy(F.col(record).alias("_record")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    took = F.aggregate(F.transform("_rows", lambda r: r["_name"]), F.expr("cast(array() as array<string>)"), step)
    folded = folded.select(F.explode(F.arrays_zip(F.col("_rows").alias("r"), took.alias("item"))).alias("z"))
    return usual.unionByName(folded.select("z.r._row.*", "z.item"))


def filled_tokens(tokens: DataFrame, records: DataFrame, token: str) -> DataFrame:
    """tokens(cur, token) with value: 'field' takes the current record, 'field#N' the N-th; records(idx, field, value), idx from 1; beyond them ''."""
    t = tokens.withColumn("field", texts.token_name(F.col(token))).withColumn("idx", F.coalesce(texts.token_index(F.col(token)), F.col("cur")))
    return t.join(records, ["idx", "field"], "left").withColumn("value", F.coalesce("value", F.lit(""))).drop("field", "idx")


def wide_sheet(values: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per record with a column per field, in the order given."""
    return values.groupBy(*keys).pivot("field", fields).agg(F.first("value"))


def long_sheet(records: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, value): a row for each field of each record, in the order given."""
    return records.unpivot(keys, fields, "field", "value")


def record_key(source: Column, name: Column, place: Column) -> Column:
    """The stable key of a record: its file and its name, or its place in the file if the name is blank."""
    return F.concat_ws("::", source, F.coalesce(F.nullif(texts.stripped(name), F.lit("")), F.concat(F.lit("tbl"), place.cast("string"))))


def grouped_fields(rows: DataFrame, key: str, order: str, field: str) -> DataFrame:
    """(key, first_order, fields): the distinct fields of each group in the order first seen."""
    first = rows.groupBy(key, field).agg(F.min(order).alias("_first"))
    out = F.transform(F.sort_array(F.collect_list(F.struct("_first", field))), lambda s: s[field])
    return first.groupBy(key).agg(F.min("_first").alias("first_order"), F.array_join(out, ",").alias("fields"))
