"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to length 1 and padded to a power of two. Each of `tables`
pseudo-rotations flips signs and applies the fast Hadamard transform, three
times; the signed axis nearest to the result is the vector's bucket in that
table (with `axes` 2 the axes of two rotations, for finer buckets). A query
looks into the `probes` buckets of each table whose axes lie nearest to it.
Inside a bucket all candidates are ranked by exact Euclidean distance in double
precision on the original vectors; each bucket sends a query its best k, and
the best of all buckets are the result, ties to the smaller id.

Rows and queries meet by a shuffle on (length, table, bucket). Buckets have
fixed counters, so those with more than BLOCK rows or queries are dealt in
blocks, and each block of rows meets each block of queries: no task gathers a
hot bucket. Of equal vectors only the k + 1 smallest ids can be in any result,
so the others leave the index first, in a partial limit before the shuffle. A
query that its buckets give fewer than k, while there are more rows, is
compared with all rows in blocks, so nothing is lost in small tables.

Vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows with a null id. Vectors of other lengths than the query's
are no candidates. A row that is repeated counts once; of rows with one id and
different vectors the least (as bytes) stands for it. Other columns are
ignored. An empty table gives no rows. Angles choose the candidates, so with
vectors of very different lengths recall is lower than measured on unit vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table_cut

TABLES, PROBES, K, BLOCK, SEED = 16, 8, 10, 4096, 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, not scaled; the width is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), 2).reshape(len(x), n)
        step *= 2
    return x


def rotated(unit: np.ndarray, seed: int) -> np.ndarray:
    """Rows under one pseudo-rotation: random signs and a Hadamard transform, three times."""
    width = 1 << (unit.shape[1] - 1).bit_length()
    rnd = np.random.default_rng(seed)
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    for _ in range(3):
        x = hadamard(x * rnd.choice((-1.0, 1.0), width)) / np.sqrt(width)
    return x


def signed(y: np.ndarray) -> np.ndarray:
    """The nearness of each row to all signed axes: the positive ones, then the negative ones."""
    return np.concatenate((y, -y), 1)


def bucket_ranks(vectors: np.ndarray, table: int, axes: int, most: int) -> np.ndarray:
    """Each row's `most` nearest buckets of a table, nearest first (fewer if there are fewer)."""
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    first = signed(rotated(unit, SEED + table * axes))
    wide = first.shape[1]
    if axes == 1:
        return np.argsort(-first, 1, kind="stable")[:, :most]
    second = signed(rotated(unit, SEED + table * axes + 1))
    few = min(most, wide)
    a, b = (np.argsort(-y, 1, kind="stable")[:, :few] for y in (first, second))
    near = np.take_along_axis(first, a, 1)[:, :, None] + np.take_along_axis(second, b, 1)[:, None]
    best = np.argsort(-near.reshape(len(vectors), -1), 1, kind="stable")[:, :most]
    code = a[:, :, None] * wide + b[:, None]
    return np.take_along_axis(code.reshape(len(vectors), -1), best, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, v) of rows with an id and a finite vector that is not zero, as bytes of doubles."""
    for b in batches:
        lists = b.column("v")
        values, ends = lists.values if hasattr(lists, "values") else lists.flatten(), lists.offsets.to_numpy()
        x = values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) + 0.0
        ids, keep, out = b.column("vec_id"), [], []
        for i, (ok, s, e) in enumerate(zip(lists.is_valid().to_pylist(), ends.tolist(), ends[1:].tolist())):
            part = x[s:e]
            if ok and ids[i].is_valid and e > s and np.isfinite(part).all() and (part != 0).any():
                keep.append(i)
                out.append(part.astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], names=["vec_id", "v"])


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v): one row per id that takes part; v has the components as bytes of doubles."""
    ready = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return ready.mapInArrow(_valid, "vec_id bigint, v binary").groupBy("vec_id").agg(F.min("v").alias("v"))


def _keys(axes: int, tables: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(v) for v in b.column("v").to_pylist()])
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                x = _matrix(part.column("v"))
                codes = np.stack([bucket_ranks(x, t, axes, most) for t in range(tables)], 1)
                bucket = (np.arange(tables)[:, None] << 40) + codes
                flat = bucket.reshape(len(x), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(np.full(len(x), size // 8), pa.int32()), lists], names=["vec_id", "v", "size", "keys"])

    return run


KEYED = "vec_id bigint, v binary, size int, keys array<bigint>"


def block_best(rows: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): the k nearest rows of each query of a block, by exact distance, then id."""
    (ids, x), (query_ids, q) = rows, asked
    square = (x * x).sum(1)
    out: tuple[list, list, list] = ([], [], [])
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        near = square - 2 * part @ x.T + (part * part).sum(1, keepdims=True)
        near[query_ids[i : i + 256, None] == ids] = np.inf
        limit = np.partition(near, min(k, len(x)) - 1, 1)[:, min(k, len(x)) - 1]
        # rounding moves no row out of the best: all within a margin are measured exactly
        slack = 1e-9 * (square.max() + (part * part).sum(1))
        for j, at in enumerate(near <= (limit + slack)[:, None]):
            at = np.flatnonzero(at & np.isfinite(near[j]))
            score = np.sqrt(((x[at] - part[j]) ** 2).sum(1))
            best = np.lexsort((ids[at], score))[:k]
            out[0].append(np.full(len(best), query_ids[i + j]))
            out[1].append(ids[at[best]])
            out[2].append(score[best])
    return tuple(np.concatenate(o) for o in out)


def _blocks(k: int):
    """Of rows in the order of size, key, row block, query block: the best of each block that has rows and queries."""
    names = ["size", "key", "rows_part", "asked_part"]

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.stack([t.column(c).to_numpy() for c in names], 1)
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))).tolist()
        ids, asked, v = t.column("vec_id").to_numpy(), t.column("asked").to_numpy(), t.column("v").combine_chunks()
        for s, e in zip(first, [*first[1:], len(keys)]):
            a = asked[s:e]
            if a.all() or not a.any():
                continue
            x = _matrix(v.slice(s, e - s))
            query, row, score = block_best((ids[s:e][~a], x[~a]), (ids[s:e][a], x[a]), k)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(row), pa.array(score)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            last = [b.column(c)[-1] for c in names]
            if all(held[0].column(c)[0] == x for c, x in zip(names, last)):
                continue  # still one block, which is bounded
            t = pa.Table.from_batches(held)
            same = np.ones(len(t), bool)
            for c, x in zip(names, last):
                same &= t.column(c).to_numpy() == x.as_py()
            cut = len(t) - int(same.sum())
            yield from work(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def met(rows: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each query in each bucket block; rows and asked are (vec_id, v, size, key)."""

    def parts(side: DataFrame, name: str) -> DataFrame:
        # a row for each bucket with more than a block: at most lengths x tables x buckets
        return side.groupBy("size", "key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("size", "key", F.ceil(F.col("n") / block).cast("int").alias(name))

    large = parts(rows, "n_rows").join(parts(asked, "n_asked"), ["size", "key"], "full")

    def dealt(side: DataFrame, own: str, other: str, mark: bool) -> DataFrame:
        with_parts = side.join(F.broadcast(large), ["size", "key"], "left")
        whole = lambda c: F.coalesce(c, F.lit(1))
        place = {own: F.pmod(F.xxhash64("vec_id"), whole(F.col(f"n_{own}"))).cast("int"), other: F.explode(F.sequence(F.lit(0), whole(F.col(f"n_{other}")) - 1))}
        return with_parts.select("size", "key", place["rows"].alias("rows_part"), place["asked"].alias("asked_part"), "vec_id", F.lit(mark).alias("asked"), "v")

    both = dealt(rows, "rows", "asked", False).unionByName(dealt(asked, "asked", "rows", True))
    names = ["size", "key", "rows_part", "asked_part"]
    return both.repartition(*names).sortWithinPartitions(*names).mapInArrow(_blocks(k), "query_id bigint, vec_id bigint, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries, k: int = K, tables: int = TABLES, probes: int = PROBES, axes: int = 1, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of rows(vec_id, embedding) for which the condition `queries` on vec_id holds."""
    all_rows = table_cut(vectors(rows))
    w = Window.partitionBy("v").orderBy("vec_id")
    index = all_rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).drop("_r")
    keyed = table_cut(index.mapInArrow(_keys(axes, tables, 1), KEYED))
    asked = table_cut(all_rows.where(queries).mapInArrow(_keys(axes, tables, probes), KEYED))
    flat = lambda df: df.select("vec_id", "v", "size", F.explode("keys").alias("key"))
    found = table_cut(ranked(met(flat(keyed), flat(asked), k, block), k))
    # queries that got fewer than k, though there may be more
    count = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = asked.join(count, asked["vec_id"] == count["query_id"], "left").where(F.coalesce("n", F.lit(0)) < k).select("vec_id", "v", "size", F.lit(0).cast("bigint").alias("key"))
    short = table_cut(short)
    if short.limit(1).count() == 0:
        return found
    whole = keyed.select("vec_id", "v", "size", F.lit(0).cast("bigint").alias("key"))
    again = ranked(met(whole, short, k, block), k)
    rest = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return rest.unionByName(again)
