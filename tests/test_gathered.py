"""Work on whole pages: what it finds is what joins of words find, and no words are shuffled for it."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldloom.operators import columns, labels

SF = "/root/testdata/sf0.001"
WORD = "page int, pos int, word string, x0 double, x1 double, y0 double, y1 double, width double"


def shuffled(frame):
    """The partitionings of the plan's shuffles, each with what lies below it."""
    plan = frame._jdf.queryExecution().executedPlan().toString().split("\n")
    return ["\n".join(plan[i:]) for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]


def scattered(spark, pages, seed):
    """Pages of words at random places, some blank or null, some without a place, in no order."""
    r, some = random.Random(seed), ["ab", "abc", "b", "c", "é", "é", " ", "", None, "a b", "bc", "xabx", "𝒳a", "가", "나다", "　c"]
    rows = []
    for p in pages:
        for i in range(r.randrange(1, 60)):
            x, y = 30.0 * r.randrange(12), 14.0 * r.randrange(5) + r.random()
            rows.append((p, i, r.choice(some), None if r.random() < 0.02 else x, x + r.choice((5.0, 20.0)), y, y + 10, 640.0))
    r.shuffle(rows)
    return spark.createDataFrame(rows, WORD)


@pytest.mark.parametrize("relation", ["right", "below", "self"])
def test_values_found_with_their_labels(spark, relation):
    words = scattered(spark, [1, 2, 3, 4, None], 7).cache()
    wanted = spark.createDataFrame([(x,) for x in ("ab", "abc", "é", "bcé", "a", "x", "b c", "𝒳", "가나다", "cc", "bbc")], "label string")
    told = lambda f: sorted(map(tuple, f.where("page is not null").select("page", "label", "n_words", "value").collect()))
    found = labels.label_words(words, wanted, "page", "pos").cache()
    assert found.where("page is null").count() > 0
    assert told(labels.labelled_values(words, wanted, "page", "pos", relation)) == told(labels.label_values(words, found, "page", "pos", relation)) != []
    none = labels.labelled_values(words, wanted, "page", "pos", relation).where("page is null").select("n_words", "value").distinct().collect()
    assert [tuple(r) for r in none] == [(0, "")]


def test_texts_of_one_checksum_stay_apart(spark, monkeypatch):
    """With places for two checksums only, nearly all texts may be labels; the labels stay the same."""
    words = scattered(spark, range(6), 3).cache()
    wanted = spark.createDataFrame([(x,) for x in ("ab", "bcé", "a", "cc", "가")], "label string")
    told = lambda: sorted(map(str, labels.label_words(words, wanted, "page", "pos").collect()))
    want = told()
    monkeypatch.setattr(labels, "told", lambda wanted: labels.zlib.compress(b"\x03" * labels.PLACES))
    assert told() == want != []


@pytest.mark.parametrize("name", ["label_words", "label_value_right", "label_value_below"])
def test_labels_move_texts_only(spark, name):
    """Words take several times the space of their texts: no shuffle lies above the words of pages, only that of what may be labels."""
    assert all("Generate posexplode" not in x or "MapInArrow" in x for x in shuffled(entry.queries()[name](spark, SF)))


@pytest.mark.parametrize("seed", range(2))
def test_label_of_page_dealt_over_rows(spark, seed):
    """A page made from two rows is one page."""
    words = scattered(spark, [1, 1, 2], seed).withColumn("pos", F.monotonically_increasing_id() % 50)
    found = labels.label_words(words, spark.createDataFrame([("ab",)], "label string"), "page", "pos")
    assert found.count() == found.select("page").distinct().count()


@pytest.mark.parametrize("seed", range(4))
def test_lines_split_as_the_columns_do(spark, seed):
    """Lines follow column_split: the first lines hold the words left of the split, each in steps of the side's own height."""
    r, rows = random.Random(seed), []
    for p in range(12):
        right = r.choice((250.0, 330.0, 420.0))
        for i in range(r.randrange(10, 70)):
            x, y = r.choice((0.0, 60.0, 120.0, right, right + 60)), 14.0 * r.randrange(6) + r.random() * 5
            rows.append((p, i, r.choice("abc"), None if r.random() < 0.01 else x, x + 40, y, y + r.choice((8, 10)), r.choice((640.0, 640.0, 640.0, 0.0, None)) if p == 3 else 640.0))
    words = spark.createDataFrame(rows, WORD).cache()
    splits = {x["page"]: x["split"] for x in columns.column_split(words, "page").collect()}
    assert None in splits.values() or len({*splits.values()}) > 1
    w = words.join(columns.column_split(words, "page").select("page", "split"), "page").withColumn("side", F.coalesce(((F.col("x0") + F.col("x1")) / 2 >= F.col("split")).cast("int"), F.lit(0)))
    by = {}
    for x in columns.stepped_lines(w, ["page", "side"]).collect():
        by.setdefault((x["page"], x["side"], x["line"]), []).append((-1 if x["x0"] is None else x["x0"], x["pos"]))
    want = {}
    for key in sorted(by):
        want.setdefault(key[0], []).append([pos for _, pos in sorted(by[key])])
    got = {}
    for x in sorted(columns.ordered_lines(words, "page", "pos").collect(), key=lambda x: (x["page"], x["line_no"])):
        got.setdefault(x["page"], []).append([v["pos"] for v in x["words"]])
        assert x["line_no"] == len(got[x["page"]])
    assert got == want


@pytest.mark.parametrize("name", ["survey_lines", "parse_survey", "survey_answers", "survey_pages"])
def test_lines_move_texts_only(spark, name):
    assert all("Generate posexplode" not in x or "MapInArrow" in x or "MapInPandas" in x for x in shuffled(entry.queries()[name](spark, SF)))
