"""Pages by their layout: label keys with positions inside their own bounding box, matched with templates whatever their shift and scale."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import texts

# Parts of titles and hints that are no labels, and the name of a box without one.
TITLE_PARTS = "조사표|현장|제원|측정|기재|방법|붙임|참고|지침|작성"
NO_NAME = "칸"
SCRIPT, LONGEST, RATIO = "[가-힣]", 12, 0.85


def is_label(word: Column, script: str = SCRIPT, longest: int = LONGEST) -> Column:
    """A short word of the script that is no part of a title."""
    t = texts.stripped(F.coalesce(word, F.lit("")))
    return (t != "") & (F.length(t) <= longest) & ~t.rlike(TITLE_PARTS) & t.rlike(script)


def placed_labels(items: DataFrame, page: str, order: str) -> DataFrame:
    """(page, rank, key, nx, ny): the first of each key of items(page, order, key, x, y), by order, with its place between 0 and 1 in the box of all of them; without extent 0."""
    first = items.where("key <> ''").groupBy(page, "key").agg(F.min(F.struct(order, "x", "y")).alias("_f")).select(page, "key", F.col(f"_f.{order}").alias("_order"), "_f.x", "_f.y")
    box = Window.partitionBy(page)
    share = lambda c: (F.col(c) - F.min(c).over(box)) / F.coalesce(F.nullif(F.max(c).over(box) - F.min(c).over(box), F.lit(0.0)), F.lit(1.0))
    rank = F.row_number().over(box.orderBy("_order", "key"))
    return first.select(page, rank.alias("rank"), "key", share("x").alias("nx"), share("y").alias("ny"))


def word_prints(words: DataFrame, page: str, order: str, script: str = SCRIPT, longest: int = LONGEST) -> DataFrame:
    """The fingerprint of each page of words(page, order, word, box)."""
    w = words.where(is_label(F.col("word"), script, longest))
    return placed_labels(w.select(page, order, texts.normalized_key(F.col("word")).alias("key"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")), page, order)


def box_prints(boxes: DataFrame, template: str, order: str) -> DataFrame:
    """The fingerprint of each template of boxes(template, order, label, field, box): the label, or else the field."""
    key = texts.normalized_key(F.coalesce(F.nullif("label", F.lit("")), "field"))
    b = boxes.select(template, order, key.alias("key"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return placed_labels(b.where(F.col("key") != NO_NAME), template, order)


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else difflib.SequenceMatcher(None, x, y).ratio() >= r for x, y, r in zip(a, b, least)], dtype=object)


def matching_keys(pages: DataFrame, templates: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(page_key, template_key) of pages(key) and templates(key): equal, one inside the other, or of that ratio of matching characters.

    Keys meet by equal parts: a template's key is cut in one piece more than the edits that the ratio
    allows, so a key within it has a piece whole; a key inside a template's is one of its parts.
    """
    p, t = (df.select("key").distinct() for df in (pages, templates))
    parts = lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.substring(c, i, n))))
    longest = F.floor(F.length("key") * (2 - ratio) / ratio)
    pieces = F.least(F.length("key"), F.floor((1 - ratio) * (F.length("key") + longest)) + 1).cast("int")

    def piece(i):
        begin = F.floor(F.length("key") * i / pieces).cast("int")
        return F.substring("key", begin + 1, F.floor(F.length("key") * (i + 1) / pieces).cast("int") - begin)

    cut = t.withColumn("_cuts", F.transform(F.sequence(F.lit(0), pieces - 1), piece))
    own = cut.select(F.col("key").alias("template_key"), F.explode(F.array_distinct("_cuts")).alias("part"), F.lit(False).alias("whole"))
    inner = t.select(F.col("key").alias("template_key"), F.explode(F.array_distinct(parts(F.col("key")))).alias("part"), F.lit(True).alias("whole"))
    cuts = p.select(F.col("key").alias("page_key"), F.explode(F.array_distinct(parts(F.col("key")))).alias("part"))
    met = cuts.join(own.unionByName(inner), "part").where(~F.col("whole") | (F.col("part") == F.col("page_key"))).select("page_key", "template_key").distinct()
    a, b = F.col("page_key"), F.col("template_key")
    inside = a.contains(b) | b.contains(a)
    near = ~inside & (F.levenshtein(a, b) <= (1 - ratio) * (F.length(a) + F.length(b)))
    if ratio >= 1:
        return met.where(inside)
    # only pairs that are near enough reach Python
    return met.where(inside | near).where(inside | F.coalesce(_alike(F.when(near, b), F.when(near, a), F.lit(ratio)), F.lit(False)))


def layout_scores(pages: DataFrame, templates: DataFrame, page: str, template: str, ratio: float = RATIO) -> DataFrame:
    """(page, template, pairs, score): how far the layout of a page is that of a template; both are fingerprints.

    Each label of the template, in order, takes the page's first free one with a matching key. The
    score is the share of labels that found one times a half and a half of how near they lie (1 less
    their mean distance, 0 at least), to three places. Pairs without any label in common have no row.
    """
    keys = matching_keys(pages, templates, ratio)
    t = templates.select(template, F.col("rank").alias("t"), F.col("key").alias("template_key"), F.col("nx").alias("tx"), F.col("ny").alias("ty"))
    t = t.withColumn("labels", F.count("*").over(Window.partitionBy(template)))
    p = pages.select(page, F.col("rank").alias("p"), F.col("key").alias("page_key"), "nx", "ny")
    met = p.join(keys, "page_key").join(t, "template_key")
    dx, dy = F.col("nx") - F.col("tx"), F.col("ny") - F.col("ty")
    pair = F.struct("t", "p", F.sqrt(dx * dx + dy * dy).alias("d"))
    lists = met.groupBy(page, template).agg(F.sort_array(F.collect_list(pair)).alias("_pairs"), F.max("labels").alias("labels"))
    start = F.struct(F.expr("cast(array() as array<int>)").alias("used"), F.lit(0).alias("t"), F.lit(0.0).alias("sum"))

    def step(s, x):
        free = (x["t"] != s["t"]) & ~F.array_contains(s["used"], x["p"])
        return F.when(free, F.struct(F.concat(s["used"], F.array(x["p"])).alias("used"), x["t"].alias("t"), (s["sum"] + x["d"]).alias("sum"))).otherwise(s)

    done = lists.withColumn("_m", F.aggregate("_pairs", start, step)).withColumn("pairs", F.size("_m.used"))
    near = F.greatest(F.lit(0.0), 1.0 - F.col("_m.sum") / F.col("pairs"))
    return done.select(page, template, "pairs", F.bround(F.col("pairs") / F.col("labels") * (0.5 + 0.5 * near), 3).alias("score"))


def best_pages(scores: DataFrame, page: str, template: str, threshold: float = 0.4) -> DataFrame:
    """(template, page, score): the page with the highest score above the threshold, of equal ones the first; other templates have no row."""
    best = scores.where(F.col("score") > threshold).groupBy(template).agg(F.max(F.struct("score", (-F.col(page)).alias("first"))).alias("b"))
    return best.select(template, (-F.col("b.first")).alias(page), "b.score")
