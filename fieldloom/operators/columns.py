"""Columns of pages: the empty band between two columns of text, and score columns at even distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from .gathered import floats, gathered, low, page_numbers, whole_pages

#: bins over a page's width, and between which of them a band between columns may begin
BINS, FROM, UNTIL = 200, 60, 140


def placed_bin(x: Column, width: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(x / width * BINS).cast("int")))


def stepped_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """words with `line`: their centres in steps of 0.6 of the median height of the keys' words, 3 at least."""
    step = words.groupBy(*keys).agg(F.greatest(F.lit(3.0), 0.6 * F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5))).alias("_step"))
    return words.join(step, keys).withColumn("line", F.bround((F.col("y0") + F.col("y1")) / 2 / F.col("_step")).cast("bigint")).drop("_step")


def column_split(words: DataFrame, page: str) -> DataFrame:
    """(page, n_words, split): where the left column of a page of words(page, width, word, box) ends; split is null with one column.

    The widest run of bins that no word covers and that begins between 30 % and 70 % of the width
    (of equal ones the first), at least 3 % wide, splits the page at its middle, if there are 20
    words, either side has 15 % of them and three lines. Blank words do not count, nor do pages
    without a width.
    """
    w = words.where(texts.stripped(F.col("word")) != "")
    sized = w.where("width > 0")
    bins = sized.select(page, F.explode(F.sequence(placed_bin(F.col("x0"), F.col("width")), placed_bin(F.col("x1"), F.col("width")))).alias("bin"))
    covered = bins.groupBy(page).agg(F.sort_array(F.collect_set("bin")).alias("_b"))
    gaps = F.arrays_zip(F.concat(F.array(F.lit(-1)), F.col("_b")).alias("a"), F.concat(F.col("_b"), F.array(F.lit(BINS))).alias("b"))
    gap = F.transform(gaps, lambda g: F.struct((g["b"] - F.greatest(g["a"] + 1, F.lit(FROM))).alias("wide"), (-F.greatest(g["a"] + 1, F.lit(FROM))).alias("first")))
    fit = F.filter(gap, lambda g: (g["wide"] >= 0.03 * BINS) & (g["first"] > -UNTIL))
    best = covered.select(page, F.array_max(fit).alias("g")).where("g is not null").select(page, ((F.col("g.wide") - 2 * F.col("g.first")) / 2 / BINS).alias("_share"))
    sides = sized.join(best, page).withColumn("_split", F.col("_share") * F.col("width")).withColumn("_right", (F.col("x0") + F.col("x1")) / 2 >= F.col("_split"))
    lines = stepped_lines(sides, [page, "_right"]).groupBy(page, "_right").agg(F.count("*").alias("n"), F.countDistinct("line").alias("lines"), F.max("_split").alias("split"))
    two = lines.groupBy(page).agg(F.count("*").alias("sides"), F.sum("n").alias("all"), F.min("n").alias("few"), F.min("lines").alias("lines"), F.max("split").alias("split"))
    two = two.where("sides = 2 and all >= 20 and few >= 0.15 * all and lines >= 3").select(page, "split")
    return w.groupBy(page).agg(F.count("*").alias("n_words")).join(two, page, "left")


def middles(groups: np.ndarray, values: np.ndarray, many: int) -> np.ndarray:
    """The median of each group's values, NaN left out; NaN without any."""
    some = ~np.isnan(values)
    groups, values = groups[some], values[some]
    by = np.lexsort((values, groups))
    n = np.bincount(groups, minlength=many)
    begin, out = np.cumsum(n) - n, np.full(many, np.nan)
    full = n > 0
    at = lambda k: values[by[(begin + k)[full]]]
    out[full] = 0.5 * at((n - 1) // 2) + 0.5 * at(n // 2)
    return out


def stepped(groups: np.ndarray, y0: np.ndarray, y1: np.ndarray, many: int) -> np.ndarray:
    """The lines of stepped_lines; NaN for words without a place."""
    return np.rint((y0 + y1) / 2 / np.fmax(3.0, 0.6 * middles(groups, y1 - y0, many))[groups])


def page_splits(pages: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The split of each page by the rules of column_split, NaN with one column."""
    many = int(pages[-1]) + 1
    sized = width > 0
    pages, x0, x1, y0, y1, width = (c[sized] for c in (pages, x0, x1, y0, y1, width))
    bins = [np.where(np.isnan(x), BINS - 1, np.clip(np.floor(x / width * BINS), 0, BINS - 1)).astype(np.int64) for x in (x0, x1)]
    edges = np.bincount(pages * (BINS + 1) + np.minimum(*bins), minlength=many * (BINS + 1)) - np.bincount(pages * (BINS + 1) + np.maximum(*bins) + 1, minlength=many * (BINS + 1))
    empty = edges.reshape(many, BINS + 1).cumsum(axis=1).T == 0
    run, wide, share = np.zeros(many, np.int64), np.full(many, int(np.ceil(0.03 * BINS)) - 1), np.full(many, np.nan)
    for b in range(FROM, BINS):
        run = np.where(empty[b], run + 1, 0)
        first = b - run + 1
        better = (run > wide) & (first < UNTIL)
        wide = np.where(better, run, wide)
        share = np.where(better, (run + 2 * first) / 2 / BINS, share)
    split = share[pages] * width
    # a word without a place lies on neither side
    met = ~np.isnan(x0 + x1) & ~np.isnan(split)
    side = pages[met] * 2 + ((x0 + x1) / 2 >= split)[met]
    line = stepped(side, y0[met], y1[met], 2 * many)
    n = np.bincount(side, minlength=2 * many).reshape(many, 2)
    placed = ~np.isnan(line)
    lines = np.bincount(np.unique(np.c_[side[placed], line[placed]], axis=0)[:, 0].astype(np.int64), minlength=2 * many).reshape(many, 2)
    out = np.full(many, -np.inf)
    np.maximum.at(out, pages[met], split[met])
    two = (n.min(axis=1) > 0) & (n.sum(axis=1) >= 20) & (n.min(axis=1) >= 0.15 * n.sum(axis=1)) & (lines.min(axis=1) >= 3)
    return np.where(two, out, np.nan)


def ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that sort like the values, nulls first."""
    return pc.rank(column.combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def table_lines(t: pa.Table, page: str, order: str) -> pa.RecordBatch:
    """The lines of a table of whole pages."""
    pages = page_numbers(t[page])
    x0, x1, y0, y1, width = (floats(t[c]) for c in ("x0", "x1", "y0", "y1", "width"))
    side = ((x0 + x1) / 2 >= page_splits(pages, x0, x1, y0, y1, width)[pages]).astype(np.int64)
    line = low(stepped(pages * 2 + side, y0, y1, 2 * int(pages[-1]) + 2))
    keys = [pages, side, line, low(x0), ranks(t[order])]
    by = np.lexsort(keys[::-1])
    same = lambda keys: np.logical_and.reduce([k[by][1:] == k[by][:-1] for k in keys])
    if same(keys).any():
        by = np.lexsort([low(y1), low(x1), low(y0), ranks(t["word"]), *keys[::-1]])
    begin = np.flatnonzero(np.r_[True, ~same(keys[:3])])
    words = t.take(pa.array(by))
    inner = pa.StructArray.from_arrays([words[c].combine_chunks() for c in ("x0", order, "word", "y0", "x1", "y1")], ["x0", order, "word", "y0", "x1", "y1"])
    of = pages[by][begin]
    number = np.arange(len(begin)) - np.searchsorted(of, of) + 1
    return pa.RecordBatch.from_arrays([words[page].take(pa.array(begin)).combine_chunks(), pa.array(number, pa.int32()), pa.ListArray.from_arrays(pa.array(np.r_[begin, len(by)], pa.int32()), inner)], [page, "line_no", "words"])


def ordered_lines(words: DataFrame, page: str, order: str, together: bool = False) -> DataFrame:
    """(page, line_no, words): the lines of each page from 1 on, the left column's before the right one's; words are structs (x0, order, word, y0, x1, y1) from left to right.

    With `together` the words of a page lie gathered already, else they are shuffled; a page's lines follow each other.
    """
    w = words.where(F.col(page).isNotNull() & (texts.stripped(F.col("word")) != "")).select(page, order, "word", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "width")])
    kind = {c: w.schema[c].dataType.simpleString() for c in (page, order)}
    schema = f"{page} {kind[page]}, line_no int, words array<struct<x0: double, {order}: {kind[order]}, word: string, y0: double, x1: double, y1: double>>"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (table_lines(t, page, order) for t in whole_pages(batches, page))

    return (w if together else gathered(w, page)).mapInArrow(lines, schema)


def even_columns(marks: DataFrame, keys: list[str], x: str, least: int = 3, slack: float = 0.25) -> DataFrame:
    """(keys, column, x, given): columns at even distances through the places x, missing ones filled in; from 1 on, left to right.

    The distance is the least between two neighbours. All others must be whole multiples of it, up to
    `slack`; else, or with fewer than `least` places or two at one place, the keys have no row. Where
    neighbours are n distances apart, n - 1 columns lie evenly between them (given is false). Null
    places go.
    """
    places = marks.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(x).cast("double"))).alias("_x"))
    n = F.size("_x")
    pairs = F.arrays_zip(F.slice("_x", 1, n - 1).alias("a"), F.slice("_x", 2, n - 1).alias("b"))
    fit = places.where(n >= max(2, least)).withColumn("_p", F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), (p["b"] - p["a"]).alias("d"))))
    fit = fit.withColumn("_step", F.array_min(F.transform("_p", lambda p: p["d"]))).where("_step > 0")
    times = lambda p: p["d"] / F.col("_step")
    fit = fit.where(F.forall("_p", lambda p: F.abs(times(p) - F.bround(times(p))) <= slack))

    def filled(p):
        many = F.bround(times(p)).cast("int")
        steps = F.transform(F.sequence(F.lit(1), many), lambda i: F.struct(F.when(i < many, p["a"] + (p["b"] - p["a"]) * i / many).otherwise(p["b"]).alias("x"), (i == many).alias("given")))
        return steps

    first = F.array(F.struct(F.get("_x", F.lit(0)).alias("x"), F.lit(True).alias("given")))
    out = fit.select(*keys, F.posexplode(F.concat(first, F.flatten(F.transform("_p", filled)))).alias("_at", "c"))
    return out.select(*keys, (F.col("_at") + 1).alias("column"), F.col("c.x").alias("x"), F.col("c.given").alias("given"))
