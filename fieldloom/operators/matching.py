"""Pages against the few templates of a store: label shares, title similarity, assignment and one-to-one matching.

Templates are given as units (name, title, label keys) and held in the plan; only pages grow.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import texts

Unit = tuple[str, str, list[str]]


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def title_similarity(a: Column, b: Column) -> Column:
    """1 for equal keys, 0.9 where one has the other inside, 0 for a blank one, else the ratio of matching characters."""
    x, y = texts.normalized_key(a), texts.normalized_key(b)
    rule = F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.9)
    # only pairs that no rule decides reach Python with their texts
    return F.coalesce(rule, _ratio(F.when(rule.isNull(), x), F.when(rule.isNull(), y)))


def title_match(page_title: Column, unit_title: Column) -> Column:
    """The similarity of titles; -1 if both end in numbers that differ."""
    number = lambda t: F.regexp_extract(texts.normalized_key(t), r"(\p{Nd}+)$", 1)
    other = (number(page_title) != "") & (number(unit_title) != "") & (number(page_title) != number(unit_title))
    return F.when(other, -1.0).otherwise(title_similarity(page_title, unit_title))


def label_scores(pages: DataFrame, keys: list[str], text: str, units: list[Unit]) -> DataFrame:
    """(keys, rank, unit, title, hits, ratio): how many of each unit's label keys the page's text has, and their share; 0 without labels."""

    def scored(blob):
        out = []
        for rank, (unit, title, labels) in enumerate(units):
            hits = sum((blob.contains(label).cast("int") for label in labels), F.lit(0))
            out.append(F.struct(F.lit(rank).alias("rank"), F.lit(unit).alias("unit"), F.lit(title).alias("title"), hits.alias("hits"), (hits / F.lit(float(max(1, len(labels))))).alias("ratio")))
        return F.array(*out)

    # an array of one binds the text's key, which is then made once
    return pages.select(*keys, F.explode(F.transform(F.array(texts.normalized_key(F.col(text))), scored)[0]).alias("s")).select(*keys, "s.*")


def assigned_pages(pages: DataFrame, keys: list[str], title: str, text: str, units: list[Unit]) -> DataFrame:
    """(keys, unit, score): the best unit of each page by 0.6 of the title's and 0.4 of the labels' score, of equal ones the first.

    It is confirmed by a title of 0.85, a title of 0.7 with a quarter of the labels, or 0.35 of
    the labels where page or unit has no title; else unit is null. A score of null: every unit's number differs.
    """
    scores = label_scores(pages.withColumn("_page_title", texts.stripped(F.coalesce(title, F.lit("")))), [*keys, "_page_title"], text, units)
    scores = scores.withColumn("title_score", title_match(F.col("_page_title"), F.col("title")))
    score = F.when(F.col("title_score") >= 0, 0.6 * F.col("title_score") + 0.4 * F.col("ratio"))
    best = scores.groupBy(*keys).agg(F.max(F.struct(score.alias("score"), (-F.col("rank")).alias("_first"), "unit", "title", "title_score", "ratio", "_page_title")).alias("b"))
    sure = (F.col("b.title_score") >= 0.85) | ((F.col("b.title_score") >= 0.7) & (F.col("b.ratio") >= 0.25))
    untitled = (F.col("b.ratio") >= 0.35) & ((F.col("b.title") == "") | (F.col("b._page_title") == ""))
    return best.select(*keys, F.when(F.col("b.score").isNotNull() & (sure | untitled), F.col("b.unit")).alias("unit"), F.round("b.score", 6).alias("score"))


def matched_pages(scores: DataFrame, doc: str, page: str, threshold: float = 0.35) -> DataFrame:
    """(doc, unit, page): pairs taken by falling ratio from the threshold on, each unit and page once; ties by the units' rank, then the page.

    scores is label_scores with doc and page; the pairs of one document are one array.
    """
    pair = F.struct((-F.col("ratio")).alias("order"), "rank", F.col(page).cast("bigint").alias("page"), "unit")
    pairs = scores.where(F.col("ratio") >= threshold).groupBy(doc).agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    none = F.expr("cast(array() as array<struct<order: double, rank: int, page: bigint, unit: string>>)")
    free = lambda took, p: ~F.exists(took, lambda t: (t["rank"] == p["rank"]) | (t["page"] == p["page"]))
    took = F.aggregate("pairs", none, lambda took, p: F.when(free(took, p), F.concat(took, F.array(p))).otherwise(took))
    return pairs.select(doc, F.explode(took).alias("t")).select(doc, F.col("t.unit").alias("unit"), F.col("t.page").alias(page))


def matched_bundles(scores: DataFrame, doc: str, page: str, threshold: float = 0.35, most: int = 200) -> DataFrame:
    """(doc, bundle, unit, page): several copies of a form in one file, each a one-to-one matching of the units with the pages that are left.

    Matchings as in matched_pages follow each other until one is empty, has fewer than half of the
    first one's pages (halves to even, one at least), or `most` are found; bundles are numbered from 1
    by their first page. The pairs of one document are one array, gone through once a bundle.
    """
    pair = F.struct((-F.col("ratio")).alias("order"), "rank", F.col(page).cast("bigint").alias("page"), "unit")
    pairs = scores.where(F.col("ratio") >= threshold).groupBy(doc).agg(F.sort_array(F.collect_list(pair)).alias("pairs"), F.countDistinct(page).alias("_pages"))
    kind = "array<struct<order: double, rank: int, page: bigint, unit: string>>"
    none = F.expr(f"cast(array() as {kind})")
    start = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("found"), F.expr("cast(array() as array<bigint>)").alias("used"), F.lit(False).alias("over"))

    def step(state, _):
        free = lambda took, p: ~F.array_contains(state["used"], p["page"]) & ~F.exists(took, lambda t: (t["rank"] == p["rank"]) | (t["page"] == p["page"]))
        took = F.aggregate("pairs", none, lambda took, p: F.when(free(took, p), F.concat(took, F.array(p))).otherwise(took))

        def judged(t):
            least = F.greatest(F.lit(1), F.bround(F.size(F.get(state["found"], F.lit(0))) * 0.5).cast("int"))
            stop = (F.size(t) == 0) | ((F.size(state["found"]) > 0) & (F.size(t) < least))
            more = F.struct(F.concat(state["found"], F.array(t)).alias("found"), F.concat(state["used"], F.transform(t, lambda p: p["page"])).alias("used"), F.lit(False).alias("over"))
            return F.when(stop, F.struct(state["found"].alias("found"), state["used"].alias("used"), F.lit(True).alias("over"))).otherwise(more)

        return F.when(state["over"], state).otherwise(F.transform(F.array(took), judged)[0])

    # no more bundles than pages that fit
    rounds = F.sequence(F.lit(1), F.least(F.lit(most), F.col("_pages").cast("int")))
    found = pairs.withColumn("_found", F.aggregate(rounds, start, step)["found"])
    ordered = F.sort_array(F.transform("_found", lambda b: F.struct(F.array_min(F.transform(b, lambda p: p["page"])).alias("first"), b.alias("b"))))
    out = found.select(doc, F.posexplode(ordered).alias("bundle", "b")).select(doc, (F.col("bundle") + 1).alias("bundle"), F.explode("b.b").alias("p"))
    return out.select(doc, "bundle", F.col("p.unit").alias("unit"), F.col("p.page").alias(page))
