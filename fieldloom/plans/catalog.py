"""Queries of the engine's own operators, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, texts
from ..operators import quality, stores


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_values(spark, d) -> DataFrame:
    """Customers as records: form is the market segment, fields are numbers."""
    spent = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("order_count"), F.sum(F.col("o_totalprice").cast("double")).alias("total_spend"))
    c = read(spark, d, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    wide = c.select(F.col("c_mktsegment").alias("form"), F.col("c_custkey").alias("record_key"), F.col("c_acctbal").cast("double").alias("acctbal"), F.coalesce("order_count", F.lit(0.0)).alias("order_count"), F.round(F.coalesce("total_spend", F.lit(0.0)), 2).alias("total_spend"))
    return wide.unpivot(["form", "record_key"], ["acctbal", "order_count", "total_spend"], "field", "value")


def event_steps(spark, d) -> DataFrame:
    """Events as records: form is the event type, the field is 5 for most events and else a value in steps of 25."""
    value = F.when(F.col("event_id") % 50 < 49, 5.0).otherwise(F.floor(F.col("value") / 25) * 25.0)
    return read(spark, d, "events").select(F.col("event_type").alias("form"), F.col("event_id").alias("record_key"), F.lit("step").alias("field"), value.alias("value"))


def queries() -> dict:
    return {
        "outliers_iqr": lambda s, d: quality.outliers(customer_values(s, d)),
        "outliers_iqr_zero": lambda s, d: quality.outliers(event_steps(s, d)),
        "dedup_names": lambda s, d: quality.unique_boxes(read(s, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", []),
        "upsert_last": lambda s, d: stores.upsert_last(read(s, d, "events"), "user_id", "event_id", ["event_type", "value"]),
        "corrections": lambda s, d: stores.corrected(
            read(s, d, "orders").select("o_orderkey", F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"), F.lit("check").alias("flag")),
            read(s, d, "orders").where("o_orderkey % 7 = 0").select(F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("o_orderkey"), F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("W").alias("new_value")), F.struct(F.lit(2).alias("at"), F.when(F.col("o_orderkey") % 3 > 0, "X").alias("new_value")))).alias("c"), F.when(F.col("o_orderkey") % 4 > 0, "status").otherwise("more").alias("field")).select("o_orderkey", "field", "c.*"), ["o_orderkey"], "field", "at"),
        "summary_first_nonempty": lambda s, d: stores.first_non_empty(read(s, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus"),
        "incremental_sync": lambda s, d: stores.incremental(read(s, d, "events").select("event_id", "user_id", "event_type"), "event_id", 100),
        "entries_sync": lambda s, d: stores.sync(read(s, d, "events").select("event_id", "user_id", "event_type"), "event_id", 100, "event_id", read(s, d, "events").where("event_id % 7 = 0")),
        "entries_idempotent": lambda s, d: stores.idempotent(read(s, d, "events").unionByName(read(s, d, "events")).withColumn("key", F.concat_ws("/", "user_id", "event_type", "event_id")).select("key", "event_id", "event_type", "value"), "key", "event_id"),
        "label_counts": lambda s, d: stores.label_counts(read(s, d, "documents").select(F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("label"), F.when(F.col("doc_id") % 2 > 0, F.col("source")).otherwise("").alias("title")), ["label", "title"]),
        "first_number": lambda s, d: read(s, d, "pages").select("page_id", numbers.first_number(F.col("url")).alias("number")),
        "normalize_key": lambda s, d: read(s, d, "part").select("p_partkey", texts.normalized_key(F.concat(F.lit("\u00a0 e\u0301"), "p_brand", F.lit("\u3000x y"))).alias("norm_key")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "outliers_iqr": """
WITH t AS (SELECT o_custkey, count(*)::DOUBLE AS n, sum(o_totalprice::DOUBLE) AS s FROM orders GROUP BY 1),
w AS (SELECT c_mktsegment AS form, c_custkey AS record_key, c_acctbal::DOUBLE AS acctbal, coalesce(n, 0) AS order_count, round(coalesce(s, 0), 2) AS total_spend FROM customer LEFT JOIN t ON c_custkey = o_custkey),
v AS (SELECT form, record_key, 'acctbal' AS field, acctbal AS value FROM w UNION ALL SELECT form, record_key, 'order_count', order_count FROM w UNION ALL SELECT form, record_key, 'total_spend', total_spend FROM w),
z AS (SELECT *, avg((value = 0)::INT) OVER g >= 0.3 AS zh, min(value) OVER g AS mn FROM v WHERE value IS NOT NULL WINDOW g AS (PARTITION BY form, field)),
u AS (SELECT *, CASE WHEN NOT (zh AND value = 0) THEN value END AS used FROM z),
q AS (SELECT form, field, quantile_cont(used, 0.25) AS q1, quantile_cont(used, 0.75) AS q3, count(used) AS n FROM u GROUP BY ALL),
b AS (SELECT u.*, q.n, q3 - q1 AS iqr, CASE WHEN mn >= 0 AND q1 - 3 * (q3 - q1) < 0 THEN 0 ELSE q1 - 3 * (q3 - q1) END AS lo, q3 + 3 * (q3 - q1) AS hi FROM u JOIN q USING (form, field)),
f AS (SELECT *, n >= 4 AND iqr > 0 AND used IS NOT NULL AND (value < lo OR value > hi) AS far FROM b),
h AS (SELECT *, count(*) FILTER (WHERE far) OVER (PARTITION BY form, field) AS hits FROM f)
SELECT form, record_key, field, value, round(lo, 4) AS lo, round(hi, 4) AS hi, coalesce(far, false) AND hits <= greatest(2, 0.1 * n) AS is_outlier FROM h""",
        "outliers_iqr_zero": """
WITH v AS (SELECT event_type AS form, event_id AS record_key, 'step' AS field, CASE WHEN event_id % 50 < 49 THEN 5.0::DOUBLE ELSE floor(value::DOUBLE / 25) * 25 END AS value FROM events),
z AS (SELECT *, avg((value = 0)::INT) OVER (PARTITION BY form, field) >= 0.3 AS zh FROM v WHERE value IS NOT NULL),
u AS (SELECT *, CASE WHEN NOT (zh AND value = 0) THEN value END AS used FROM z),
q AS (SELECT form, field, quantile_cont(used, 0.25) AS q1, quantile_cont(used, 0.75) AS q3, count(used) AS n, min(used) AS mn, list_sort(list(used) FILTER (WHERE used IS NOT NULL)) AS xs FROM u GROUP BY ALL),
m AS (SELECT *, q3 - q1 AS iqr, xs[n // 2 + 1] AS med FROM q),
e AS (SELECT *, CASE WHEN iqr > 0 THEN q1 - 3 * iqr ELSE med - 3 * greatest(1.0, abs(med)) END AS l, CASE WHEN iqr > 0 THEN q3 + 3 * iqr ELSE med + 3 * greatest(1.0, abs(med)) END AS hi FROM m),
b AS (SELECT u.*, e.n, CASE WHEN mn >= 0 THEN greatest(l, 0) ELSE l END AS lo, hi FROM u JOIN e USING (form, field)),
f AS (SELECT *, n >= 4 AND used IS NOT NULL AND (value < lo OR value > hi) AS far FROM b),
h AS (SELECT *, count(*) FILTER (WHERE far) OVER (PARTITION BY form, field) AS hits FROM f)
SELECT form, record_key, field, value, round(lo, 4) AS lo, round(hi, 4) AS hi, coalesce(far, false) AND hits <= greatest(2, 0.1 * n) AS is_outlier FROM h""",
        "dedup_names": "SELECT p_partkey, p_brand, CASE WHEN n = 1 THEN p_brand ELSE p_brand || ' (' || n || ')' END AS unique_name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE trim(p_brand) <> '')",
        "upsert_last": "SELECT user_id, min(event_id) AS first_pos, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id",
        "corrections": """WITH c AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN 'status' ELSE 'more' END AS field, CASE WHEN o_orderkey % 3 > 0 THEN 'X' END AS v FROM orders WHERE o_orderkey % 7 = 0)
SELECT o.o_orderkey, 'status' AS field, CASE WHEN c.o_orderkey IS NULL THEN o_orderstatus ELSE v END AS value, CASE WHEN c.o_orderkey IS NULL THEN 'check' ELSE '' END AS flag FROM orders o LEFT JOIN c ON o.o_orderkey = c.o_orderkey AND field = 'status'
UNION ALL SELECT c.o_orderkey, field, v, '' FROM c JOIN orders USING (o_orderkey) WHERE field = 'more'""",
        "summary_first_nonempty": "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) FILTER (WHERE trim(o_orderstatus) <> '') AS first_value FROM orders GROUP BY 1",
        "incremental_sync": "SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 500",
        "entries_sync": "SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 7 = 0)",
        "entries_idempotent": "SELECT concat_ws('/', user_id, event_type, event_id) AS key, min(event_id) AS seq, event_type, any_value(value) AS value, 2 * count(*) AS times_sent FROM events GROUP BY 1, 3",
        "label_counts": "SELECT coalesce(nullif(CASE WHEN doc_id % 3 > 0 THEN lang END, ''), nullif(CASE WHEN doc_id % 2 > 0 THEN source ELSE '' END, ''), '기타') AS label, count(*) AS n FROM documents GROUP BY 1",
        "first_number": r"SELECT page_id, replace(regexp_extract(coalesce(url, ''), '([+-]?[0-9][0-9,]*(?:\.[0-9]+)?)', 1), ',', '') AS number FROM pages",
        "normalize_key": "SELECT p_partkey, replace(trim(regexp_replace(nfc_normalize('\u00a0 e\u0301' || p_brand || '\u3000x y'), '" + texts.BLANKS + "', ' ', 'g')), ' ', '') AS norm_key FROM part",
    }
