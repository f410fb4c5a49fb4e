"""Words, boxes, lines and grids of pages, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import texts


def words_in_boxes(words: DataFrame, boxes: DataFrame, page: str, band: float = 50.0) -> DataFrame:
    """(page, box_id, n_words, text): words(page, word, x0, y0, x1, y1) whose centre lies in a box(box_id, x0, y0, x1, y1), in the order of lines.

    Boxes are cut into bands of height, so the range join has an equal key.
    """
    w = words.select(page, "word", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy")).withColumn("band", F.floor(F.col("cy") / band))
    b = boxes.withColumn("band", F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))))
    hit = w.join(b, "band").where("cx between x0 and x1 and cy between y0 and y1")
    rows = F.sort_array(F.collect_list(F.struct(F.bround(F.col("cy") / 5).alias("line"), "cx", "word")))
    return hit.groupBy(page, "box_id").agg(F.count("*").alias("n_words"), F.array_join(F.transform(rows, lambda r: r["word"]), " ").alias("text"))


def value_runs(words: DataFrame, page: str, line: str, gap: float) -> DataFrame:
    """words with run: a gap wider than `gap` within a line begins a new run."""
    w = Window.partitionBy(page, line).orderBy("x0", "word")
    far = F.coalesce((F.col("x0") - F.lag("x1").over(w) > gap).cast("int"), F.lit(0))
    return words.withColumn("_far", far).withColumn("run", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_far")


def clustered(values: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(keys, cluster, centre, n): sorted values chain while the gap to the last is within the tolerance; the centre is the upper median."""
    w = Window.partitionBy(*keys).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > tolerance).cast("int"), F.lit(0))
    chained = values.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = Window.partitionBy(*keys, "cluster").orderBy(value)
    ranked = chained.withColumn("_at", F.row_number().over(rank)).withColumn("n", F.count("*").over(Window.partitionBy(*keys, "cluster")))
    return ranked.where("_at = n div 2 + 1").select(*keys, "cluster", F.col(value).alias("centre"), "n")


def covered_cells(cells: DataFrame, table: str) -> DataFrame:
    """(table, r, c, cell, text): every place that a cell (row, col, row_span, col_span) covers; the later cell wins."""
    places = cells.withColumn("r", F.explode(F.expr("sequence(row, row + row_span - 1)"))).withColumn("c", F.explode(F.expr("sequence(col, col + col_span - 1)")))
    return places.groupBy(table, "r", "c").agg(F.max("cell").alias("cell"), F.max_by("text", "cell").alias("text"))


def right_neighbours(cells: DataFrame, grid: DataFrame, table: str) -> DataFrame:
    """(table, cell, right_text): the text of the place right of each cell; null at the edge."""
    at = cells.select(table, "cell", F.col("row").alias("r"), (F.col("col") + F.col("col_span")).alias("c"))
    return at.join(grid.select(table, "r", "c", F.col("text").alias("right_text")), [table, "r", "c"], "left").select(table, "cell", "right_text")


def median(values: Column) -> Column:
    """The middle of an array, of two the mean; null of an empty one."""
    s = F.sort_array(values)
    at = lambda i: F.get(s, i.cast("int"))
    return (at(F.floor((F.size(s) - 1) / 2)) + at(F.floor(F.size(s) / 2))) * 0.5


def choice_marks(scores: DataFrame, keys: list[str], order: str, set_marks: str | None = None, delta: float = 0.015, ratio: float = 1.4) -> DataFrame:
    """(keys, order, score, thr, marked, flag): which choices of a question are darker than the others.

    The base of a question is its least score with two choices at most, else the median; a mark
    reaches base + delta and base * ratio. Choices with the column `set_marks` stay marked. The flag
    is faint (marked, but the top is within 1.5 delta of the base), several (two marks of three
    choices or more), unclear (none, but the top is 0.6 delta above the base) or ''. Null scores go.
    """
    own = F.coalesce(F.col(set_marks), F.lit(False)) if set_marks else F.lit(False)
    choice = F.struct(F.col(order).alias("at"), "score", own.alias("own"))
    q = scores.where("score is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(choice)).alias("c"))
    of = q.withColumn("_s", F.transform("c", lambda c: c["score"]))
    of = of.withColumn("base", F.when(F.size("c") <= 2, F.array_min("_s")).otherwise(median(F.col("_s")))).withColumn("_over", F.array_max("_s") - F.col("base"))
    of = of.withColumn("thr", F.greatest(F.col("base") + delta, F.col("base") * ratio))
    of = of.withColumn("c", F.transform("c", lambda c: F.struct(c["at"], c["score"], (c["own"] | (c["score"] >= F.col("thr"))).alias("marked"))))
    n = F.size(F.filter("c", lambda c: c["marked"]))
    flag = F.when((n > 0) & (F.col("_over") < delta * 1.5), "faint").when((n >= 2) & (F.size("c") >= 3), "several").when((n == 0) & (F.col("_over") >= delta * 0.6), "unclear").otherwise("")
    return of.withColumn("flag", flag).select(*keys, F.explode("c").alias("c"), "thr", "flag").select(*keys, F.col("c.at").alias(order), "c.score", "thr", "c.marked", "flag")


def scale_answers(scores: DataFrame, keys: list[str], order: str, least: float = 0.010, times: float = 2.5) -> DataFrame:
    """(keys, thr, answer, flag): the cell of a row that is darker than the others, counted from 1; null without one.

    The threshold lies above the row's median by `times` the median distance from it (of all cells
    but one greatest, with three or more), `least` at least. Of several cells the first darkest is the
    answer. The flag is faint, several, unclear (none, but the top is near the threshold) or ''.
    """
    q = scores.where("score is not null").groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), "score"))), lambda c: c["score"]).alias("_s"))
    q = q.withColumn("_base", median(F.col("_s"))).withColumn("_top", F.array_max("_s"))
    others = F.when(F.size("_s") > 2, F.slice(F.sort_array("_s"), 1, F.greatest(F.size("_s") - 1, F.lit(1)))).otherwise(F.col("_s"))
    q = q.withColumn("_mad", median(F.transform(others, lambda v: F.abs(v - F.col("_base"))))).withColumn("_delta", F.greatest(F.lit(least), times * F.col("_mad")))
    q = q.withColumn("thr", F.col("_base") + F.col("_delta")).withColumn("_n", F.size(F.filter("_s", lambda v: v >= F.col("thr")))).withColumn("_over", F.col("_top") - F.col("_base"))
    answer = F.when(F.col("_n") > 0, F.array_position("_s", F.col("_top")))
    flag = F.when((F.col("_n") == 1) & (F.col("_over") < F.col("_delta") * 1.6), "faint").when(F.col("_n") > 1, "several").when((F.col("_n") == 0) & (F.col("_over") >= F.col("_delta") * 0.6), "unclear").otherwise("")
    return q.select(*keys, "thr", answer.alias("answer"), flag.alias("flag"))


def renumbered(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """pages(doc, page, n_questions) with first_no: where the numbers of a page that continues another begin."""
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("first_no", F.coalesce(F.sum("n_questions").over(w), F.lit(0)) + 1)


def line_buckets(words: DataFrame, page: str) -> DataFrame:
    """(page, bucket, n_words, text): lines of words(page, word, x0, y0, x1, y1) by their centres, in steps of 0.6 of the page's median height, 3 at least; each from left to right."""
    w = words.where("trim(word) <> ''")
    step = w.groupBy(page).agg(F.greatest(F.lit(3.0), 0.6 * F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5))).alias("step"))
    lines = w.join(step, page).withColumn("bucket", F.bround((F.col("y0") + F.col("y1")) / 2 / F.col("step")).cast("bigint"))
    return lines.groupBy(page, "bucket").agg(F.count("*").alias("n_words"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word"))), lambda s: s["word"]), " ").alias("text"))


def page_shifts(words: DataFrame, boxes: DataFrame, page: str, order: str, near: float = 60.0, agree: float = 4.0, least: float = 2.0) -> DataFrame:
    """(page, shift): how far a page's words lie below boxes(box_id, label, x1, y0, y1) of the template, label being a key.

    A box measures its nearest word of two characters or more with its label, within `near` in height
    and left of the box's end (of equal ones the first). Three measures at least must lie within
    `agree` of their median, and that beyond `least`; the shift is their median. Other pages have no row.
    """
    w = words.select(page, order, texts.normalized_key(F.col("word")).alias("label"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), "x1").where("length(label) >= 2")
    b = boxes.select("box_id", "label", F.col("x1").alias("bx"), ((F.col("y0") + F.col("y1")) / 2).alias("by"))
    gap = F.col("cy") - F.col("by")
    found = w.join(b, "label").where((F.abs(gap) <= near) & (F.col("x1") <= F.col("bx"))).groupBy(page, "box_id").agg(F.min_by(gap, F.struct(F.abs(gap), order)).alias("dy"))
    middle = found.groupBy(page).agg(F.percentile("dy", F.lit(0.5)).alias("mid"), F.count("*").alias("n")).where((F.col("n") >= 3) & (F.abs("mid") > least))
    same = found.join(middle, page).where(F.abs(F.col("dy") - F.col("mid")) <= agree)
    return same.groupBy(page).agg(F.percentile("dy", F.lit(0.5)).alias("shift"), F.count("*").alias("n")).where("n >= 3").select(page, "shift")


def anchored_values(cells: DataFrame, page: str, boxes: list[tuple[str, str, float, float, str]]) -> DataFrame:
    """(page, field, value): the text right of ("right") or under ("below") the label's cell, for boxes (field, label key, x0, y0, relation).

    The label's cell has the label as its key, else inside; of several the nearest to the box's
    corner, then the first. No row without such a cell or neighbour. cells(page, cell, text, x0, y0, x1, y1).
    """
    places = ["x0", "y0", "x1", "y1"]
    wanted = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(label).alias("label"), F.lit(float(x)).alias("bx"), F.lit(float(y)).alias("by"), F.lit(rel).alias("relation")) for f, label, x, y, rel in boxes])
    keyed = cells.withColumn("_key", texts.normalized_key(F.col("text")))
    met = keyed.withColumn("b", F.explode(F.filter(wanted, lambda b: F.col("_key").contains(b["label"]))))
    far = (F.col("x0") - F.col("b.bx")) ** 2 + (F.col("y0") - F.col("b.by")) ** 2
    label = met.groupBy(page, "b.field", "b.relation").agg(F.min(F.struct((F.col("_key") != F.col("b.label")).alias("inside"), far.alias("far"), "cell", *places)).alias("l"))
    # the neighbour's left or upper edge lies within 4 of the label's other one
    right = (F.col("relation") == "right") & (F.abs(F.col("x0") - F.col("l.x1")) < 4) & (F.col("l.y0") < F.col("y1") - 1) & (F.col("l.y1") > F.col("y0") + 1)
    below = (F.col("relation") == "below") & (F.abs(F.col("y0") - F.col("l.y1")) < 4) & (F.col("l.x0") < F.col("x1") - 1) & (F.col("l.x1") > F.col("x0") + 1)
    beside = label.join(cells, page).where(right | below)
    first = F.struct(F.when(right, F.col("x0")).otherwise(F.col("y0")), "cell")
    return beside.groupBy(page, "field").agg(texts.normalized(F.min_by("text", first)).alias("value"))


def numbered_lists(cells: DataFrame, table: str, name: str, count: str, number: tuple[str, ...]) -> DataFrame:
    """(table, list, r, name, count): rows under each header cell with the key `name`, as long as the number column counts.

    The count column is the first cell with its key right of the header in the same row ('' without
    one), the number column the last with a key of `number` left of it, else the place before. The
    list begins at the first row with digits there and ends before the next without; rows without a name go.
    """
    keyed = cells.withColumn("_key", texts.normalized_key(F.col("text")))
    head = keyed.where(F.col("_key") == name).select(table, F.col("cell").alias("list"), F.col("row").alias("at"), F.col("col").alias("name_col"))
    same = head.join(keyed.select(table, F.col("row").alias("at"), "cell", "col", "_key"), [table, "at"])
    head = same.groupBy(table, "list", "at", "name_col").agg(
        F.min_by("col", F.when((F.col("col") > F.col("name_col")) & (F.col("_key") == count), F.col("cell"))).alias("count_col"),
        F.max_by("col", F.when((F.col("col") < F.col("name_col")) & F.col("_key").isin(*number), F.col("cell"))).alias("no_col"))
    head = head.withColumn("no_col", F.coalesce("no_col", F.greatest(F.lit(0), F.col("name_col") - 1)))
    grid = covered_cells(cells, table).withColumn("text", texts.stripped(F.col("text")))
    at = F.struct("no_col", "name_col", "count_col")
    rows = head.join(grid.select(table, "r", "c", "text"), table).where((F.col("r") > F.col("at")) & ((F.col("c") == F.col("no_col")) | (F.col("c") == F.col("name_col")) | (F.col("c") == F.col("count_col"))))
    pick = lambda col: F.max(F.when(F.col("c") == F.col(col), F.col("text")))
    rows = rows.groupBy(table, "list", "r", at.alias("_at")).agg(pick("no_col").alias("no"), pick("name_col").alias("name"), pick("count_col").alias("count"))
    counts = F.coalesce(F.col("no").rlike(r"^\p{Nd}+$"), F.lit(False))
    w = Window.partitionBy(table, "list").orderBy("r")
    rows = rows.withColumn("_no", counts).withColumn("_begun", F.max("_no").over(w)).withColumn("_gap", F.col("_begun") & ~F.col("_no"))
    # a place of the table without any cell is a row without a number
    first = F.min(F.when(F.col("_no"), F.col("r"))).over(Window.partitionBy(table, "list"))
    rows = rows.withColumn("_ended", F.max("_gap").over(w) | (F.col("r") - first + 1 != F.sum(F.col("_no").cast("int")).over(w)))
    return rows.where("_no and not _ended").where((F.col("name") != "") & (F.col("name") != name)).select(table, "list", "r", "name", F.coalesce("count", F.lit("")).alias("count"))
