"""Extendible hashing into shards of limited bytes (native).

The directory is indexed by the leading bits of a hash of the document id. A
bucket over the byte limit splits on its next bit; others stay. A document's
local depth is the number of oversized buckets on the path of its hash. The
directory is computed in rounds of 16 bits: each round counts bytes per cell of
16 more bits, and only cells still too large go to the next round, so no
table of all hashes is ever held.

Null text has 0 bytes; a null id hashes as the empty string. Equal ids share
all bits: a bucket of one single hash cannot split, so its rows are cut by
running bytes (part > 0): a row of over half the limit is a part of its own,
the others are cut where half the limit is full, so no part exceeds the limit
but a single row that does, which is marked over_limit. Such a bucket is dealt
by a hash of its texts first, over as many tasks as its bytes ask for, so a
stage that runs again deals the same. An empty table gives no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEP, ROUNDS = 16, 4


def hash_bits(doc_id: Column, step: int = STEP, rounds: int = ROUNDS) -> Column:
    """The leading step * rounds bits of md5(id) as a string of 0 and 1."""
    hexed = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.concat(*[F.lpad(F.conv(F.substring(hexed, 1 + k * step // 4, step // 4), 16, 2), step, "0") for k in range(rounds)])


def shards(docs: DataFrame, limit: int = 8 << 20, step: int = STEP, rounds: int = ROUNDS, carry: bool = False) -> DataFrame:
    """(doc_id, n_bytes, shard, local_depth, part, over_limit) per row of docs(doc_id, text); carry adds the whole row as a struct named row."""
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col("doc_id"), step, rounds).alias("bits"), F.xxhash64("text").alias("of"), *row)
    names = ["doc_id", "n_bytes", "bits", "of", *["row"] * carry]
    done, rest = None, rows
    for r in range(rounds):
        base = r * step
        cells = rest.groupBy(F.substring("bits", 1, base + step).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("docs"))
        nodes = cells.select(F.explode(F.sequence(F.lit(base), F.lit(base + step))).alias("d"), "cell", "b").groupBy("d", F.expr("substring(cell, 1, d)").alias("node")).agg(F.sum("b").alias("b"))
        large = nodes.where(F.col("b") > limit).select(F.col("d").alias("ld"), F.col("node").alias("lnode"))
        depth = (
            cells.select("cell", F.explode(F.sequence(F.lit(base), F.lit(base + step))).alias("ld"))
            .withColumn("lnode", F.expr("substring(cell, 1, ld)"))
            .join(large, ["ld", "lnode"], "left_semi")
            .groupBy("cell")
            .agg(F.max("ld").alias("deepest"))
        )
        at = rest.withColumn("cell", F.substring("bits", 1, base + step)).join(depth, "cell", "left")
        at = at.withColumn("local_depth", F.coalesce(F.col("deepest") + 1, F.lit(base)))
        fits = at.where(F.col("local_depth") <= base + step).select(*names, "local_depth", F.lit(0).cast("long").alias("part"))
        done = fits if done is None else done.unionByName(fits)
        rest = at.where(F.col("local_depth") > base + step).select(*names)
        if cells.where(F.col("b") > limit).limit(1).count() == 0:
            return _named(done, limit)
    # One hash, many rows: dealt by a hash of the text where a bucket has many times the limit.
    dealt = rest.join(rest.groupBy("bits").agg(F.least(F.lit(1024), F.ceil(F.sum("n_bytes") / (64 * limit))).alias("salts")), "bits")
    dealt = dealt.withColumn("salt", F.pmod("of", F.greatest(F.lit(1), F.col("salts")))).withColumn("large", F.col("n_bytes") > limit / 2)
    w = Window.partitionBy("bits", "salt", "large").orderBy("doc_id", "of", "n_bytes")
    before = F.coalesce(F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.when(F.col("large"), 2 * F.row_number().over(w) + 1).otherwise(2 * F.floor(before / max(1, limit // 2)))
    ends = dealt.withColumn("part", nth.cast("long") * 1024 + F.col("salt") + 1)
    return _named(done.unionByName(ends.select(*names, F.lit(step * rounds).alias("local_depth"), "part")), limit)


def _named(df: DataFrame, limit: int) -> DataFrame:
    return df.select("doc_id", "n_bytes", F.expr("substring(bits, 1, local_depth)").alias("shard"), F.col("local_depth").cast("long").alias("local_depth"), "part", (F.col("n_bytes") > limit).alias("over_limit"), *[c for c in df.columns if c == "row"])


def write_shards(docs: DataFrame, path: str, limit: int = 8 << 20) -> None:
    """Write every row of docs, once, into the folder of its shard and part; input columns named shard or part are replaced by these."""
    kept = docs.drop("shard", "part")
    shards(kept, limit, carry=True).select("row.*", "shard", "part").write.partitionBy("shard", "part").parquet(path)


def oracle(limit: int = 8 << 20) -> str:
    """Of all 64 bits; a text over the limit splits to the last and is then a part of its own."""
    return f"""
WITH h AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, md5(coalesce(doc_id::VARCHAR, '')) AS m FROM documents),
b AS (SELECT doc_id, n_bytes, (SELECT string_agg(lpad(bin(('0x' || substr(m, i, 1))::INT), 4, '0'), '' ORDER BY i) FROM range(1, 17) t(i)) AS bits FROM h),
n AS (SELECT doc_id, n_bytes, substr(bits, 1, d) AS node FROM b, range(0, 65) r(d)),
p AS (SELECT node FROM n GROUP BY 1 HAVING sum(n_bytes) > {limit}),
l AS (SELECT doc_id, count(*) AS large FROM n JOIN p USING (node) GROUP BY 1)
SELECT doc_id, n_bytes, substr(bits, 1, coalesce(large, 0)) AS shard, least(64, coalesce(large, 0))::BIGINT AS local_depth, CASE WHEN large > 64 THEN 3 * 1024 + 1 ELSE 0 END::BIGINT AS part, n_bytes > {limit} AS over_limit FROM b LEFT JOIN l USING (doc_id)
"""
