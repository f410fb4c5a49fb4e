"""Survey pages without boxes: numbered questions, their choices and marks, in the order of lines.

Choices of a line and the form of its question number are array expressions over the line's words;
what a line means depends on the lines before it, so the lines of one page are folded in order, page
by page, by a small state machine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import isnan

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from . import columns
from .layout import median

# Circled numbers, marks before a choice, empty and filled boxes, lines that are no text, and the prefixes of question numbers.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
MARKS = "✓√■●☑▣✔"
EMPTY_BOXES, FILLED_BOXES = "□☐口ㅁ", "■☑▣✔✓√▪"
NOISE = r"^(→|<<|※|☆|★|◆|◇|▶|♣|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]\s*\.|-\s*[0-9]+\s*-$)"
PREFIX = "Q|문"
DATE_PARTS = "년월일"
POINTER = "번"
UNNAMED = "항목"
WIDE_DIGITS = ("０１２３４５６７８９", "0123456789")

NUMBER = "([0-9０-９]{1,2})"
CHOICE = rf"^([{MARKS}])?\s*(?:([{CIRCLED}])|\({NUMBER}\)|{NUMBER}\)|{NUMBER})(.*)$"
MOST_CHOICES, LABEL, NAME = 20, 8, 10
CHOICES = "array<struct<no: int, text: string, marked: boolean, bare: boolean>>"
QUESTIONS = "nth int, no int, qid string, text string, choices array<struct<no: int, text: string, marked: boolean>>, free array<string>"
ENDS = ("?", "？", ")", ".", ":")


def number(text: Column) -> Column:
    return F.translate(text, *WIDE_DIGITS).try_cast("int")


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def tokens_of(tokens: Column) -> Column:
    """Each word with what it is as a choice: its number, the rest of its text, its mark; a damaged number; the number of the next choice."""

    def read(t):
        at = lambda k: F.regexp_extract(t, CHOICE, k)
        bare = at(5) != ""
        circled = F.array_position(F.array(*map(F.lit, CIRCLED)), at(2)).cast("int")
        no = F.when(bare & (at(6) != ""), None).when(at(2) != "", circled).otherwise(F.coalesce(number(at(3)), number(at(4)), number(at(5))))
        damaged = rf"^{NUMBER}[^0-9０-９\s]?(.*)$"
        parts = lambda *values: F.struct(t.alias("t"), *[v.alias(n) for n, v in zip(("mark", "no", "rest", "marked", "bare", "damaged", "left"), values)])
        whole = parts(t.rlike(rf"^[{MARKS}]$"), no, texts.stripped(at(6)), at(1) != "", bare, number(F.regexp_extract(t, damaged, 1)), texts.stripped(F.regexp_extract(t, damaged, 2)))
        # most words begin like none of these and need no closer look
        plain = parts(F.lit(False), F.lit(None).cast("int"), F.lit(""), F.lit(False), F.lit(False), F.lit(None).cast("int"), F.lit(""))
        return F.when(t.rlike(rf"^[{MARKS}{CIRCLED}(0-9０-９]"), whole).otherwise(plain)

    read_all = F.transform(tokens, read)
    bound = F.array(F.struct(read_all.alias("a")))
    after = lambda a, i: F.get(F.filter(F.slice(a, i + 2, F.size(a)), lambda t: t["no"].isNotNull() & ~t["mark"]), F.lit(0))["no"]
    return F.transform(bound, lambda b: F.transform(b["a"], lambda t, i: F.struct(t.alias("w"), after(b["a"], i).alias("next"))))[0]


def numbered_choices(read: Column) -> Column:
    """struct(c, lead): the choices of a line by their numbers and the words before them; a damaged number between two others counts where it is the one that lacks."""
    start = F.struct(F.expr(f"cast(array() as {CHOICES})").alias("c"), F.expr("cast(array() as array<string>)").alias("lead"), F.lit(False).alias("mark"))
    choice = lambda no, text, marked, bare: F.array(F.struct(no.cast("int").alias("no"), text.alias("text"), marked.alias("marked"), bare.alias("bare")))
    state = lambda c, lead, mark: F.struct(c.alias("c"), lead.alias("lead"), mark.alias("mark"))
    none = F.lit(False)

    def step(s, x):
        w, last = x["w"], F.element_at(s["c"], -1)
        longer = F.concat(F.slice(s["c"], 1, F.size(s["c"]) - 1), choice(last["no"], texts.stripped(F.concat_ws(" ", last["text"], w["t"])), last["marked"], last["bare"]))
        return (
            F.when(w["mark"], state(s["c"], s["lead"], F.lit(True)))
            .when(w["no"].isNotNull(), state(F.concat(s["c"], choice(w["no"], w["rest"], w["marked"] | s["mark"], w["bare"])), s["lead"], none))
            .when(F.size(s["c"]) == 0, state(s["c"], F.concat(s["lead"], F.array(w["t"])), s["mark"]))
            .when((w["damaged"] == F.try_element_at(s["c"], F.lit(-1))["no"] + 1) & (x["next"] > w["damaged"]), state(F.concat(s["c"], choice(w["damaged"], w["left"], none, none)), s["lead"], s["mark"]))
            .otherwise(state(longer, s["lead"], s["mark"])))

    def judged(s):
        nos = F.transform(s["c"], lambda c: c["no"])
        loose = F.exists(s["c"], lambda c: c["bare"]) & ((F.size(nos) < 2) | (nos != F.sort_array(nos)))
        return F.struct(F.when(loose | ~F.forall(nos, lambda n: n.between(1, MOST_CHOICES)), F.expr(f"cast(array() as {CHOICES})")).otherwise(s["c"]).alias("c"), s["lead"].alias("lead"))

    return F.aggregate(read, start, step, judged)


def boxed_choices(tokens: Column) -> Column:
    """struct(c, lead): two boxes or more, each after its name if the line ends with a box, else before it; counted from 1, filled ones are marked."""
    box = lambda t: t.rlike(rf"^[{EMPTY_BOXES}{FILLED_BOXES}]($|\()")
    at = F.filter(F.transform(tokens, lambda t, i: F.when(box(t), i)), lambda i: i.isNotNull())
    plain = lambda a, lo, hi: F.filter(F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0))), lambda t: ~box(t))
    rest = lambda t: F.substring(t, 2, 10_000)

    def made(b):
        t, p = b["t"], b["at"]
        last = F.element_at(p, -1)
        before = (last == F.size(t) - 1) | (F.length(F.get(t, last)) > 1)
        begin = F.when(before, F.greatest(F.lit(0), F.get(p, F.lit(0)) - 1)).otherwise(F.get(p, F.lit(0)))

        def one(i, k):
            named = F.when(before, joined(plain(t, F.when(k == 0, begin).otherwise(F.get(p, k - 1) + 1), i)))
            named = named.otherwise(F.concat_ws(" ", F.nullif(rest(F.get(t, i)), F.lit("")), F.nullif(joined(plain(t, i + 1, F.coalesce(F.get(p, k + 1), F.size(t)))), F.lit(""))))
            return F.struct((k + 1).alias("no"), texts.stripped(named).alias("text"), F.substring(F.get(t, i), 1, 1).rlike(f"[{FILLED_BOXES}]").alias("marked"), F.lit(False).alias("bare"))

        many = F.size(p) >= 2
        return F.struct(F.when(many, F.transform(p, one)).otherwise(F.expr(f"cast(array() as {CHOICES})")).alias("c"), F.when(many, F.slice(t, 1, begin)).otherwise(t).alias("lead"))

    return F.transform(F.array(F.struct(tokens.alias("t"), at.alias("at"))), made)[0]


def line_choices(tokens: Column) -> Column:
    """struct(c, lead): the numbered choices of a line's words, else the boxed ones, else none and all words."""
    both = F.array(F.struct(numbered_choices(tokens_of(tokens)).alias("n"), boxed_choices(tokens).alias("b")))
    return F.transform(both, lambda x: F.when(F.size(x["n"]["c"]) > 0, x["n"]).otherwise(x["b"]))[0]


def short_label(words: Column) -> Column:
    """A short name ('' for a longer text, a sentence, a hint or a date); up to four characters without spaces."""
    raw = texts.normalized(joined(words))
    compact = F.replace(raw, F.lit(" "), F.lit(""))
    other = (F.length(compact) > LABEL) | compact.rlike(rf"[?]|[):.]$|^\(|[0-9]{POINTER}") | compact.rlike(rf"^[0-9.\-/~{DATE_PARTS}\s]*$")
    return F.when(other, "").when(F.length(compact) <= 4, compact).otherwise(raw)


def line_features(lines: DataFrame, page: str) -> DataFrame:
    """What each line of lines(page, line_no, words) is by itself: text, place, choices, label and the parts of a question number."""
    t = lines.withColumn("_t", F.transform("words", lambda w: texts.stripped(w["word"])))
    high = median(F.transform("words", lambda x: x["y1"] - x["y0"]))
    cy = (F.get("words", F.lit(0))["y0"] + F.get("words", F.lit(0))["y1"]) / 2
    t = t.withColumn("cy", cy).withColumn("near", F.greatest(F.lit(8.0), 2.2 * high))
    t = t.withColumn("joined", texts.normalized(joined(F.col("_t")))).withColumn("_first", F.get("_t", F.lit(0))).withColumn("_tail", F.slice("_t", 2, F.size("_t")))
    t = t.withColumn("_c", line_choices(F.col("_t"))).withColumn("_d", line_choices(F.col("_tail")))
    at = lambda c, pattern, k: F.regexp_extract(c, pattern, k)
    own, sub, whole = rf"^({PREFIX})?\s*{NUMBER}\s*([.,)]?)$", rf"^{NUMBER}-{NUMBER}[.)]?(.*)$", rf"^({PREFIX})?\s*{NUMBER}\s*([.,)])\s*(.+)$"
    spaced = rf"^({PREFIX})?\s+{NUMBER}$"
    alone = (F.size("_t") > 1) & F.col("_first").rlike(own) & ~F.col("_first").rlike(spaced)
    kind = F.when(alone, "own").when(F.col("_first").rlike(sub), "sub").when(joined(F.col("_t")).rlike(whole), "whole").otherwise("")
    t = t.withColumn("kind", kind)
    pick = lambda k: F.when(F.col("kind") == "own", at(F.col("_first"), own, k)).when(F.col("kind") == "whole", at(joined(F.col("_t")), whole, k)).otherwise("")
    no = F.when(F.col("kind") == "sub", number(at(F.col("_first"), sub, 1))).otherwise(number(pick(2)))
    text = F.when(F.col("kind") == "own", joined(F.col("_tail"))).when(F.col("kind") == "sub", F.concat_ws(" ", F.nullif(at(F.col("_first"), sub, 3), F.lit("")), F.nullif(joined(F.col("_tail")), F.lit("")))).otherwise(at(joined(F.col("_t")), whole, 4))
    t = t.withColumn("no", no)
    listed = (pick(3) == ")") & F.col("_first").rlike(rf"^\(?{NUMBER}\)$") & F.exists("_tail", lambda x: number(F.regexp_extract(x, rf"^\(?{NUMBER}\)$", 1)) == F.col("no") + 1)
    inner = F.when(F.col("kind") == "whole", F.col("_c")).otherwise(F.col("_d"))
    return t.select(
        page, "line_no", "joined", "cy", "near", ((F.col("joined") == "") | F.col("joined").rlike(NOISE)).alias("noise"), F.col("_c.c").alias("choices"), short_label(F.col("_c.lead")).alias("lead_label"),
        (F.size("_c.lead") > 0).alias("has_lead"), short_label(F.col("_t")).alias("label"), "kind", pick(1).alias("pre"), F.col("no").alias("number"), number(at(F.col("_first"), sub, 2)).alias("sub"),
        pick(3).alias("style"), texts.normalized(text).alias("question"), F.coalesce(listed, F.lit(False)).alias("listed"), inner["c"].alias("inner"), texts.normalized(joined(inner["lead"])).alias("inner_lead"))


class Fold:
    """The questions of one page so far: `last` and `prefix` say which number comes next, `name` waits for its choices."""

    def __init__(self):
        self.out: list[dict] = []
        self.last: int | None = None
        self.prefix = self.name = ""
        self.name_above = self.close = False
        self.cy: float | None = None

    def begin(self, **more) -> None:
        self.out.append({"no": None, "qid": "", "text": "", "choices": [], "free": []} | more)

    def question(self, x) -> tuple[int | None, str, str] | None:
        """(number, id, prefix) if the line's number is one that can come now."""
        if x.kind == "sub":
            fits = x.number in (self.last, self.last + 1) if self.last is not None else True
            return (None, f"{x.number}-{x.sub}", self.prefix) if fits else None
        if not x.kind or x.listed:
            return None
        if self.last is None or x.pre != self.prefix:
            fits = bool(x.style or x.pre)
        else:
            ahead = x.number - self.last
            fits = ahead == 1 or x.style in (".", ",") and 1 < ahead <= 3
        return (x.number, f"{x.pre}{x.number}", x.pre) if fits else None

    def line(self, x) -> None:
        """The next line of the page; close: it lies just below the one before, be that noise or not."""
        dy = 0.0 if self.cy is None or isnan(x.cy) or isnan(self.cy) else x.cy - self.cy
        self.close, self.cy = 0 <= dy < x.near, x.cy
        if not x.noise:
            self.read(x)

    def read(self, x) -> None:
        cur = self.out[-1] if self.out else None
        nos = [c["no"] for c in x.choices]
        goes_on = bool(cur and cur["choices"] and nos and nos[0] == cur["choices"][-1]["no"] + 1 and (not x.has_lead or x.lead_label))
        found = None if goes_on else self.question(x)
        if found:
            no, qid, self.prefix = found
            self.last = no if no is not None else x.number
            self.begin(no=no, qid=qid, text=x.question)
            self.name, self.name_above = "", False
            if len(x.inner) and [c["no"] for c in x.inner] == list(range(1, len(x.inner) + 1)):
                inside = re.match(rf"^(?:{PREFIX})?\s*\d{{1,2}}\s*[.,)]\s*(.+)$", x.inner_lead)
                self.out[-1] |= {"text": inside[1] if inside else x.inner_lead, "choices": list(x.inner)}
        elif nos and (goes_on or nos[0] == 1 or len(nos) >= 3):
            if cur is None or cur["choices"] and nos[0] <= cur["choices"][-1]["no"]:
                self.begin(text=x.lead_label or self.name)
                self.name_above = bool(self.name) and not x.lead_label
            elif x.lead_label and not cur["text"]:
                cur["text"] = x.lead_label
            self.name = ""
            self.out[-1]["choices"].extend(x.choices)
        elif cur:
            self.text(cur, x)

    def text(self, cur: dict, x) -> None:
        """A line that is neither question nor choices: a name, the rest of a question or an answer in words."""
        if x.label and cur["choices"]:
            unnumbered = cur["no"] is None
            if unnumbered and not cur["text"]:
                cur["text"] = x.label
            elif unnumbered and self.name_above and self.close and x.label != cur["text"] and len((cur["text"] + x.label).replace(" ", "")) <= NAME:
                cur["text"] += " " + x.label
                self.name_above = False
            else:
                self.name = x.label
        elif not cur["choices"] and not cur["free"] and self.close and not cur["text"].rstrip().endswith(ENDS):
            cur["text"] = f"{cur['text']} {x.joined}".strip()
        else:
            cur["free"].append(x.joined)


def parsed_surveys(words: DataFrame, page: str, order: str, together: bool = False) -> DataFrame:
    """(page, nth, no, qid, text, choices, free): the questions of each page of words(page, order, width, word, box), in order.

    A question begins with its number, one more than the last (a page's first may be any, two may be
    missing after a point or comma, another prefix begins anew) or as a part N-M of the last or next
    one. Choices go on while their numbers do; a new group without a number is a question by the short
    name beside, above or below it. no is null for parts and for named groups; without a name the id is
    their place. Other lines continue a question without choices or are its answers in words. Pages
    without words or without a key have no rows; a null word is blank. With `together` the words of a
    page lie gathered already, else they are shuffled.
    """
    lines = line_features(columns.ordered_lines(words, page, order, together), page)
    schema = f"{page} {lines.schema[page].dataType.simpleString()}, {QUESTIONS}"

    def rows(at, state: Fold) -> Iterator[tuple]:
        for i, q in enumerate(state.out, 1):
            yield at, i, q["no"], q["qid"] or q["text"] or f"{UNNAMED}{i}", q["text"], [{k: c[k] for k in ("no", "text", "marked")} for c in q["choices"]], q["free"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda out: pd.DataFrame(out, columns=[page, "nth", "no", "qid", "text", "choices", "free"]).astype({"no": "Int32"})
        at, state, out = None, Fold(), []
        for pdf in batches:
            for x in pdf.astype({"number": "Int32", "sub": "Int32"}).itertuples(index=False):
                if x[0] != at:
                    out += rows(at, state)
                    at, state = x[0], Fold()
                state.line(x)
            yield frame(out)
            out = []
        yield frame(list(rows(at, state)))

    return lines.mapInPandas(fold, schema)


def survey_answers(questions: DataFrame, page: str) -> DataFrame:
    """(page, nth, key, answer): the marked choices of each question as 'no:text' joined by ';', else its answers in words."""
    marked = F.filter("choices", lambda c: c["marked"])
    chosen = F.array_join(F.transform(marked, lambda c: F.when(c["text"] != "", F.concat(c["no"].cast("string"), F.lit(":"), c["text"])).otherwise(c["no"].cast("string"))), ";")
    title = F.rtrim(F.regexp_replace(F.substring("text", 1, 18), "[?？. ]+$", ""))
    key = F.when((F.col("qid") == F.col("text")) | (F.col("text") == ""), F.col("qid")).otherwise(F.concat("qid", F.lit("_"), title))
    return questions.select(page, "nth", key.alias("key"), F.when(F.size("choices") > 0, chosen).otherwise(F.array_join("free", " ")).alias("answer"))


def survey_pages(questions: DataFrame, lines: DataFrame, page: str) -> DataFrame:
    """(page, n_lines, numbered, good, is_survey, first_no, last_no): a survey page has a numbered question, two with choices that begin 1, 2, and those on a fifth of its lines.

    first_no and last_no are the least and greatest number with the prefix of the last numbered question.
    """
    nos = F.transform("choices", lambda c: c["no"])
    good = (F.size("choices") >= 2) & (F.slice(nos, 1, 2) == F.array(F.lit(1), F.lit(2)))
    prefix = F.regexp_extract("qid", f"^({PREFIX})?", 1)
    q = questions.withColumn("_pre", prefix)
    last = F.max_by("_pre", F.when(F.col("no").isNotNull(), F.col("nth"))).over(Window.partitionBy(page))
    q = q.withColumn("_same", F.when(F.col("_pre") == last, F.col("no")))
    sums = q.groupBy(page).agg(F.count("no").alias("numbered"), F.count_if(good).alias("good"), F.min("_same").alias("first_no"), F.max("_same").alias("last_no"))
    n = lines.groupBy(page).agg(F.count("*").alias("n_lines"))
    out = n.join(sums, page, "left").withColumn("numbered", F.coalesce("numbered", F.lit(0))).withColumn("good", F.coalesce("good", F.lit(0)))
    return out.select(page, "n_lines", "numbered", "good", ((F.col("numbered") >= 1) & (F.col("good") >= 2) & (F.col("good") >= 0.2 * F.col("n_lines"))).alias("is_survey"), "first_no", "last_no")
