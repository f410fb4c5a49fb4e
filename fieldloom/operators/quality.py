"""Outliers, flags and accuracy over long records (form, record_key, field, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts

KEYS = ["form", "field"]


def outliers(values: DataFrame, k: float = 3.0, least: int = 4, most: int = 2, most_share: float = 0.1) -> DataFrame:
    """Tukey fences per form and field.

    Columns with at least 30 % zeros are judged without them. Where the quartiles are
    equal, the fences are the upper median -+ k * max(1, |median|). The lower fence of
    a column without negative values is 0 at least. If more values than most and than
    most_share of the column would be flagged, none is.
    """
    v = values.where(F.col("value").isNotNull())
    zero = v.groupBy(*KEYS).agg((F.avg((F.col("value") == 0).cast("int")) >= 0.3).alias("zero_heavy"))
    used = v.join(zero, KEYS).withColumn("used", F.when(~(F.col("zero_heavy") & (F.col("value") == 0)), F.col("value")))
    q = used.groupBy(*KEYS).agg(F.percentile("used", F.lit(0.25)).alias("q1"), F.percentile("used", F.lit(0.75)).alias("q3"), F.count("used").alias("n"), F.min("used").alias("least"))
    iqr = F.col("q3") - F.col("q1")
    # with four values or more and equal quartiles, all values between them and so the upper median equal q1
    room = F.when(iqr > 0, k * iqr).otherwise(k * F.greatest(F.lit(1.0), F.abs("q1")))
    lo = F.col("q1") - room
    with_q = used.join(q, KEYS).withColumn("lo", F.when((F.col("least") >= 0) & (lo < 0), 0.0).otherwise(lo)).withColumn("hi", F.col("q3") + room)
    with_q = with_q.withColumn("far", (F.col("n") >= least) & F.col("used").isNotNull() & ((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))))
    hits = with_q.groupBy(*KEYS).agg(F.count_if("far").alias("hits"))
    ok = F.col("hits") <= F.greatest(F.lit(float(most)), most_share * F.col("n"))
    return with_q.join(hits, KEYS).select("form", "record_key", "field", "value", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), (F.coalesce("far", F.lit(False)) & ok).alias("is_outlier"))


def unique_boxes(df: DataFrame, name: str, order: str, by: list[str], default: str = "항목") -> DataFrame:
    """Names are trimmed, blank ones take the default; from the second on a repeated name gets a suffix: name, name (2), name (3)."""
    from pyspark.sql.window import Window

    named = df.withColumn("_name", F.coalesce(F.nullif(texts.stripped(F.col(name)), F.lit("")), F.lit(default)))
    n = F.row_number().over(Window.partitionBy(*by, "_name").orderBy(order))
    return named.withColumn("unique_name", F.when(n == 1, F.col("_name")).otherwise(F.concat("_name", F.lit(" ("), n.cast("string"), F.lit(")")))).drop("_name")
