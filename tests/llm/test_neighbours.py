"""Nearest neighbours against a scan of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import neighbours

SF = "/root/testdata/{}/embeddings.parquet"


def brute(rows, asked, k=10):
    """{query: [(id, distance)]} over all rows of the query's length."""
    out = {}
    for q in asked:
        if q in rows:
            near = sorted((math.dist(rows[q], v), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
            out[q] = [(i, d) for d, i in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got = out.setdefault(r["query_id"], [])
        got.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got)
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
@pytest.mark.parametrize("more", [{}, {"axes": 2, "probes": 900}])
def test_recall_and_order(spark, sf, more):
    df = spark.read.parquet(SF.format(sf))
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = found(neighbours.nearest(df, F.col("vec_id") % 100 == 0, **more))
    want = brute(rows, [i for i in rows if i % 100 == 0])
    assert got.keys() == want.keys() and all(len(g) == 10 for g in got.values())
    assert recall(got, want) >= 0.9
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0])) and all(d == pytest.approx(math.dist(rows[q], rows[i]), rel=1e-12) for i, d in near)


def test_hadamard():
    x = np.random.default_rng(2).normal(size=(3, 8))
    h = np.array([[1.0]])
    while len(h) < 8:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(neighbours.hadamard(x), x @ h)
    y = neighbours.rotated(x[:, :5], 7)
    assert y.shape == (3, 8) and np.allclose((y * y).sum(1), (x[:, :5] ** 2).sum(1))


def test_hot_buckets_are_dealt(spark):
    """A third of the rows are one vector, another third lies close around it; blocks of 16 rows give what one block gives."""
    rnd = np.random.default_rng(4)
    hot = rnd.normal(size=16)
    rows = [(i, (hot if i % 3 == 0 else hot + rnd.normal(size=16) / 50 if i % 3 == 1 else rnd.normal(size=16)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = F.col("vec_id") % 5 == 0
    small, large = (found(neighbours.nearest(df, asked, block=b)) for b in (16, 4096))
    assert small == large
    want = brute(dict(rows), range(0, 900, 5))
    assert recall(small, want) > 0.97
    # equal vectors: the smallest ids, without the query's own
    assert [i for i, _ in small[450]] == [i for i in range(0, 33, 3) if i != 450][:10] and small[0][0] == (3, 0.0)


def test_small_tables_give_all_candidates(spark):
    rows = [(0, [1.0, 0, 0]), (100, [0, 1.0, 0]), (200, [-5.0, 0.5, 0]), (7, [0, 0, 1e-3]), (300, [2.0, 1])]
    rows += [(400, None), (500, []), (600, [0.0, 0, 0]), (700, [1.0, None, 0]), (800, [1.0, float("nan"), 0]), (900, [1.0, float("inf"), 0]), (None, [1.0, 0, 0]), (0, [1.0, 0, 0])]
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], "x") for i, v in rows], "vec_id bigint, embedding array<double>, score string")
    got = found(neighbours.nearest(df, F.col("vec_id") % 100 == 0))
    want = brute({i: v for i, v in rows[:5]}, [0, 100, 200, 300])
    assert got == {q: [(i, pytest.approx(d)) for i, d in near] for q, near in want.items() if near}
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 100 == 0).collect() == []
    assert neighbours.nearest(df.where("vec_id = 0"), F.col("vec_id") % 100 == 0).collect() == []
