"""Labels among the words of pages, and the words that stand right of or below them.

Labels are a dictionary of any size. A page is searched whole, in one place: what may be a label there
(a word's own key, a part of it as long as some label, the joined keys of up to five words that follow
each other in a line) is told by a byte for its checksum, and meets the labels by equality. So of a
page's words only those move that may be labels.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from .gathered import floats, gathered, low, page_numbers, runs, whole_pages

BOX = ("x0", "y0", "x1", "y1")
EXACT, JOINED, INSIDE = 1, 2, 3
#: places of checksums (so many bytes for each task at most), factors of checksums, comparisons held at once
PLACES, FACTOR, SPREAD, MASK, HELD = 1 << 22, 0x2545F491, 0x9E3779B1, (1 << 32) - 1, 1_000_000
#: texts.BLANKS for Python
BLANK = re.compile("[ \t\n\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+")


def middle(prefix: str = "") -> Column:
    return (F.col(f"{prefix}y0") + F.col(f"{prefix}y1")) / 2


def nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def spread(checksums: np.ndarray) -> np.ndarray:
    """The place of each checksum, a polynomial of code points of 32 bits."""
    return ((checksums * np.uint64(SPREAD)) & np.uint64(MASK)) // np.uint64((MASK + 1) // PLACES)


def told(wanted: DataFrame) -> bytes:
    """A byte for each place: 1 if a text of wanted(text) begins with such a checksum, 3 if one has it; PLACES / 16 rows come to the driver at most."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags: dict[int, int] = {}
            for text in batch.column(0).to_pylist():
                h, sums = 0, []
                for c in text:
                    h = (h * FACTOR + ord(c)) & MASK
                    sums.append(h)
                for n, at in enumerate(spread(np.array(sums, np.uint64)).tolist(), 1):
                    flags[at] = flags.get(at, 0) | (3 if n == len(text) else 1)
            yield pa.RecordBatch.from_arrays([pa.array([k // 16 for k in flags], pa.int32()), pa.array([v << k % 16 * 2 for k, v in flags.items()], pa.int64())], ["at", "b"])

    rows = wanted.select("text").mapInArrow(marks, "at int, b bigint").groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
    packed = np.zeros(PLACES // 16, np.int64)
    packed[rows["at"].to_numpy()] = rows["b"].to_numpy()
    all_of = ((packed[:, None] >> np.arange(0, 32, 2)) & 3).astype(np.uint8).ravel()
    all_of[0] |= 1  # the text without characters begins every label
    return zlib.compress(all_of.tobytes(), 1)


class Words:
    """The keys of a table's words, one after another, as code points, with what may be labels among them."""

    def __init__(self, words: pa.ChunkedArray, flags: np.ndarray):
        self.flags = flags
        self.words = words.to_pylist()
        self.keys = [w or "" for w in self.words]
        size = np.fromiter(map(len, self.keys), np.int64, len(self.keys))
        codes = code_points("".join(self.keys))
        # other characters are neither blank nor changed by normalisation form C
        odd = (codes <= 32) | (codes == 0x85) | (codes == 0xA0) | ((codes >= 0x300) & ~((codes >= 0x4E00) & (codes < 0xA000)) & ~((codes >= 0xAC00) & (codes < 0xD7A4)))
        if odd.any():
            for i in np.unique(np.repeat(np.arange(len(size)), size)[odd]).tolist():
                self.keys[i] = BLANK.sub("", nfc(self.keys[i]))
            size = np.fromiter(map(len, self.keys), np.int64, len(self.keys))
            codes = code_points("".join(self.keys))
        self.size, self.codes = size, codes
        self.begin = np.cumsum(size) - size

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, text, inside): the parts of each row's key that may be labels; text is a number of its own for each text."""
        row = np.repeat(np.arange(len(self.size)), self.size)
        at = np.arange(len(self.codes))
        end = (self.begin + self.size)[row]
        h, packed = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
        self.sums = np.zeros(len(self.size), np.uint64)
        self.longer: dict[str, int] = {}
        found = []
        for n in range(1, int(self.size.max(initial=0)) + 1):
            fits = at + n <= end
            at, row, end, h, packed = at[fits], row[fits], end[fits], h[fits], packed[fits]
            h = (h * np.uint64(FACTOR) + self.codes[at + n - 1]) & np.uint64(MASK)
            flag = self.flags[spread(h)]
            hit = np.flatnonzero(flag == 3)
            if n <= 2:
                packed = packed << 21 | (self.codes[at + n - 1].astype(np.int64) + 1)
                text = packed[hit]
            else:
                text = np.array([-1 - self.longer.setdefault(self.keys[r][k : k + n], len(self.longer)) for r, k in zip(row[hit].tolist(), (at[hit] - self.begin[row[hit]]).tolist(), strict=True)], np.int64)
            found.append((row[hit], text, self.size[row[hit]] > n))
            alive = flag > 0
            at, row, end, h, packed = at[alive], row[alive], end[alive], h[alive], packed[alive]
            if not len(at):
                break
        rows, text, inside = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return rows, text, inside.astype(np.int64)

    def text(self, number: int) -> str:
        if number < 0:
            return self.long[-1 - number]
        return (chr((number >> 21) - 1) if number >> 21 else "") + chr((number & (1 << 21) - 1) - 1)

    @property
    def long(self) -> list[str]:
        if len(getattr(self, "_long", ())) != len(self.longer):
            self._long = list(self.longer)
        return self._long

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """The checksum of each whole key, and the factor that it moves the characters before it by."""
        sums, factor = np.zeros(len(self.size), np.uint64), np.ones(len(self.size), np.uint64)
        rows, n = np.flatnonzero(self.size > 0), 0
        while len(rows):
            sums[rows] = (sums[rows] * np.uint64(FACTOR) + self.codes[self.begin[rows] + n]) & np.uint64(MASK)
            factor[rows] = (factor[rows] * np.uint64(FACTOR)) & np.uint64(MASK)
            n += 1
            rows = rows[self.size[rows] > n]
        return sums, factor


def places(words: Words, at: np.ndarray, box: list[np.ndarray], pages: np.ndarray, most: int, line: float) -> list[dict[str, tuple]]:
    """Of each page the texts that may be labels, with their first place (kind, a, b, c, box)."""
    best: list[dict[str, tuple]] = [{} for _ in range(pages[-1] + 1)]
    x0, y0, x1, y1 = box
    rows, text, inside = words.parts()
    rank = np.empty(len(at), np.int64)
    rank[np.lexsort((low(y1), low(x1), low(y0), low(x0), at))] = np.arange(len(at))
    first = np.lexsort((rank[rows], inside, text, pages[rows]))
    first = first[np.r_[True, (text[first][1:] != text[first][:-1]) | (pages[rows][first][1:] != pages[rows][first][:-1])][: len(first)]]
    i = rows[first]
    for page, n, kind, a, *own in zip(pages[i].tolist(), text[first].tolist(), inside[first].tolist(), at[i].tolist(), *(c[i].tolist() for c in box), strict=True):
        best[page][words.text(n)] = (INSIDE if kind else EXACT, a, 0, 0, *own)

    row = low(np.rint((y0 + y1) / 2 / line))
    by = np.lexsort((at, low(x0), row, pages))
    begin = np.flatnonzero(np.r_[True, (row[by][1:] != row[by][:-1]) | (pages[by][1:] != pages[by][:-1])])
    size = np.diff(np.r_[begin, len(by)])
    least, start, end = (np.repeat(v, size) for v in (np.minimum.reduceat(at[by], begin), begin, begin + size))
    sums, factor = (c[by] for c in words.whole())
    i = np.flatnonzero(words.flags[spread(sums)] > 0)
    h = sums[i]
    for j in range(1, most):
        i, h = i[i + j < end[i]], h[i + j < end[i]]
        h = (h * factor[i + j] + sums[i + j]) & np.uint64(MASK)
        flag = words.flags[spread(h)]
        for k in i[flag == 3].tolist():
            p, q = by[k], by[k + j]
            joined = "".join(words.keys[r] for r in by[k : k + j + 1].tolist())
            place = (JOINED, int(least[k]), k - int(start[k]) + 1, j, float(x0[p]), float(np.fmin(y0[p], y0[q])), float(x1[q]), float(np.fmax(y1[p], y1[q])))
            if joined and (joined not in best[pages[p]] or place < best[pages[p]][joined]):
                best[pages[p]][joined] = place
        i, h = i[flag > 0], h[flag > 0]
    return best


def beside(words: list[str | None], at: np.ndarray, box: list[np.ndarray], pages: np.ndarray, best: list[dict[str, tuple]], relation: str, gap: float) -> Iterator[tuple[int, str]]:
    """(n_words, value) of each place of `best`, page by page."""
    x0, y0, x1, y1 = box
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    by = np.lexsort((at, low(cx), low(cy), pages) if relation == "below" else (at, low(x0), pages))
    x0, y0, x1, y1, cx, cy = (c[by] for c in (x0, y0, x1, y1, cx, cy))
    order = by.tolist()
    bounds = np.r_[np.flatnonzero(np.diff(pages, prepend=-1)), len(pages)].tolist()
    for begin, end, found in zip(bounds[:-1], bounds[1:], best, strict=True):
        # labels in one word have one box
        own = {p[4:]: (0, "") for p in found.values()}
        boxes = np.array(list(own)).reshape(-1, 4, 1)
        s, many = slice(begin, end), max(1, HELD // (end - begin))
        values: list[tuple[int, str]] = []
        for k in range(0, len(boxes), many):
            lx0, ly0, lx1, ly1 = boxes[k : k + many].transpose(1, 0, 2)
            if relation == "right":
                taken = (x0[s] >= lx1 - 1) & (np.abs(cy[s] - (ly0 + ly1) / 2) < np.fmax(y1[s] - y0[s], ly1 - ly0) * 0.6)
            elif relation == "below":
                taken = (y0[s] >= ly1 - 1) & (np.abs(cx[s] - (lx0 + lx1) / 2) < lx1 - lx0 + 30)
                taken &= np.abs(cy[s] - np.where(taken & ~np.isnan(cy[s]), cy[s], np.inf).min(axis=1, keepdims=True)) < 6
            else:
                taken = (cx[s] >= lx0) & (cx[s] <= lx1) & (cy[s] >= ly0) & (cy[s] <= ly1)
            which, place = np.nonzero(taken)
            ends = np.searchsorted(which, np.arange(len(taken) + 1)).tolist()
            place += begin
            if relation == "right":
                far = np.zeros(len(place), bool)
                far[1:] = (x0[place[1:]] - x1[place[:-1]] > gap) & (which[1:] == which[:-1])
                cuts = np.flatnonzero(far)
                cuts = np.append(cuts, len(place))[np.searchsorted(cuts, ends[:-1])].tolist()
                ends_at = [min(e, c) for e, c in zip(ends[1:], cuts, strict=True)]
            else:
                ends_at = ends[1:]
            place = place.tolist()
            for a, b in zip(ends[:-1], ends_at, strict=True):
                said = " ".join([w for n in place[a:b] if (w := words[order[n]]) is not None])
                values.append((b - a, BLANK.sub(" ", nfc(said)).strip(" ")))
        own = dict(zip(own, values, strict=True))
        yield from (own[p[4:]] for p in found.values())


def searched(words: DataFrame, labels: DataFrame, page: str, order: str, relation: str | None, most: int, line: float, gap: float, together: bool) -> DataFrame:
    """(page, label, kind, x0, y0, x1, y1, n_words, value): the first place of each label on each page, and what stands beside it."""
    wanted = labels.select("label", texts.normalized_key(F.col("label")).alias("text")).where("text <> ''").distinct()
    flags = told(wanted)
    w = words.select(page, F.col(order).cast("bigint").alias("_at"), "word", *[F.col(c).cast("double").alias(c) for c in BOX])
    kind = w.schema[page].dataType.simpleString()
    schema = f"{page} {kind}, _text string, kind int, x0 double, y0 double, x1 double, y1 double, n_words bigint, value string"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(zlib.decompress(flags), np.uint8)
        for t in whole_pages(batches, page):
            pages, told_words, box = page_numbers(t[page]), Words(t["word"], known), [floats(t[c]) for c in BOX]
            at = t["_at"].fill_null(np.iinfo(np.int64).min).to_numpy()
            best = places(told_words, at, box, pages, most, line)
            many = [len(b) for b in best]
            if not sum(many):
                continue
            place = [p for b in best for p in b.values()]
            values = list(beside(told_words.words, at, box, pages, best, relation, gap)) if relation else [(None, None)] * len(place)
            firsts = np.repeat(np.r_[0, runs(t[page])], many)
            columns = [t[page].take(pa.array(firsts)).combine_chunks(), pa.array([x for b in best for x in b], pa.string()), pa.array([p[0] for p in place], pa.int32())]
            columns += [pa.array([p[k] for p in place], pa.float64(), from_pandas=True) for k in range(4, 8)]
            columns += [pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [page, "_text", "kind", *BOX, "n_words", "value"])

    met = (w if together else gathered(w, page)).mapInArrow(search, schema)
    return met.join(wanted.withColumnRenamed("text", "_text"), "_text").select(page, "label", "kind", *BOX, "n_words", "value")


def label_words(words: DataFrame, labels: DataFrame, page: str, order: str, most: int = 5, line: float = 4.0, together: bool = False) -> DataFrame:
    """(page, label, kind, x0, y0, x1, y1): where each label of labels(label) stands on each page of words(page, order, word, box).

    A word whose key is the label's comes first, then words next to each other in a line (up to
    `most`) whose joined key is, then a word that has it inside; of several the first: by the page's
    order of words, for joined ones by the line's first word and the place in the line. A joined
    label has the box of its first and last word. Labels and words without a key match nothing, a
    label that is not there has no row. Lines are words whose centres round to one multiple of `line`.
    With `together` the words of a page lie gathered already, else they are shuffled.
    """
    return searched(words, labels, page, order, None, most, line, 0, together).drop("n_words", "value")


def labelled_values(words: DataFrame, labels: DataFrame, page: str, order: str, relation: str = "right", gap: float = 45.0, most: int = 5, line: float = 4.0, together: bool = False) -> DataFrame:
    """(page, label, n_words, value): label_values of label_words, both found in one place; a page without a key has no values."""
    if relation not in ("right", "below", "self"):
        raise ValueError(f"relation is right, below or self, not {relation}")
    found = searched(words, labels, page, order, relation, most, line, gap, together)
    none = F.col(page).isNull()
    return found.select(page, "label", F.when(none, 0).otherwise(F.col("n_words")).alias("n_words"), F.when(none, "").otherwise(F.col("value")).alias("value"))


def label_values(words: DataFrame, found: DataFrame, page: str, order: str, relation: str = "right", gap: float = 45.0) -> DataFrame:
    """(page, label, n_words, value): the words beside each label of found(page, label, box); no words give ''.

    right: words of the label's line from its right end on, up to a gap wider than `gap` between two
    of them. below: of the words under it, whose centres lie within its width and 30 of its own, those
    of the uppermost line. self: the label's own words.
    """
    at = found.select(page, "label", *[F.col(c).alias(f"l{c}") for c in BOX])
    w = words.select(page, order, "word", *BOX)
    cx, cy, ly = (F.col("x0") + F.col("x1")) / 2, middle(), middle("l")
    both = at.join(w, page)
    if relation == "right":
        high = F.greatest(F.col("y1") - F.col("y0"), F.col("ly1") - F.col("ly0"))
        both = both.where((F.col("x0") >= F.col("lx1") - 1) & (F.abs(cy - ly) < high * 0.6)).withColumn("_at", F.struct("x0", order))
        run = Window.partitionBy(page, "label").orderBy("_at")
        far = F.coalesce((F.col("x0") - F.lag("x1").over(run) > gap).cast("int"), F.lit(0))
        taken = both.withColumn("_far", far).withColumn("_runs", F.sum("_far").over(run.rowsBetween(Window.unboundedPreceding, 0))).where("_runs = 0")
    elif relation == "below":
        near = F.abs(cx - (F.col("lx0") + F.col("lx1")) / 2) < F.col("lx1") - F.col("lx0") + 30
        both = both.where((F.col("y0") >= F.col("ly1") - 1) & near).withColumn("_at", F.struct(cy.alias("cy"), cx.alias("cx"), order))
        top = F.min("_at.cy").over(Window.partitionBy(page, "label"))
        taken = both.withColumn("_top", top).where(F.abs(F.col("_at.cy") - F.col("_top")) < 6)
    elif relation == "self":
        inside = cx.between(F.col("lx0"), F.col("lx1")) & cy.between(F.col("ly0"), F.col("ly1"))
        taken = both.where(inside).withColumn("_at", F.struct("x0", order))
    else:
        raise ValueError(f"relation is right, below or self, not {relation}")
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "word"))), lambda s: s["word"]), " ")
    values = taken.groupBy(page, "label").agg(F.count("*").alias("n_words"), texts.normalized(line).alias("value"))
    return at.select(page, "label").join(values, [page, "label"], "left").select(page, "label", F.coalesce("n_words", F.lit(0)).cast("bigint").alias("n_words"), F.coalesce("value", F.lit("")).alias("value"))
