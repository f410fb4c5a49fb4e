"""Fill-in-middle transformation over ropes.

A text is cut into units: runs of ASCII letters, and every other character by
itself. Its rope is a balanced tree whose leaves hold up to LEAF units of text
and whose nodes cache unit and code-point counts, so a split at a unit rank
walks one path and cuts one leaf. A document's rope is split at two unit ranks
into prefix, middle and suffix; the subtrees are concatenated in another order
with a sentinel before each. The inverse finds the sentinels and splits the
output's rope at their code points.

The ranks and the form of a document depend on its id alone. A text that is
empty or holds a sentinel stays plain, so every output can be inverted.

Null text counts as empty; a null id is written as `null`. Repeated rows give
equal rows. Input columns named like results are replaced, other columns stay.
An empty table gives no rows. Rows are changed where they lie, without a
shuffle; a task holds one batch of texts and the rope of one of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

LEAF = 256
UNIT = re.compile(r"[A-Za-z]++|[^A-Za-z]")
PIECE = re.compile(rf"(?:[A-Za-z]++|[^A-Za-z]){{1,{LEAF}}}+")
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
RESULTS = {"n": LongType(), "form": StringType(), "prefix_chars": LongType(), "middle_chars": LongType(), "output": StringType()}


class Rope:
    """A leaf with text or a node with two subtrees; both know their units, code points and depth."""

    __slots__ = ("text", "left", "right", "units", "chars", "depth")

    def __init__(self, text: str | None = None, units: int = 0, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.units, self.chars, self.depth = units, len(text), 0
        else:
            self.units, self.chars, self.depth = left.units + right.units, left.chars + right.chars, 1 + max(left.depth, right.depth)

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            r = todo.pop()
            if r.text is not None:
                yield r.text
            else:
                todo += (r.right, r.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


EMPTY = Rope("", 0)


def leaf(text: str) -> Rope:
    return Rope(text, sum(1 for _ in UNIT.finditer(text)))


def rope(text: str) -> Rope:
    """The balanced rope of a text; all leaves but the last have LEAF units."""
    level = [Rope(p, LEAF) for p in PIECE.findall(text)]
    if not level:
        return EMPTY
    level[-1] = leaf(level[-1].text)
    while len(level) > 1:
        level = [Rope(None, 0, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def joined(*ropes: Rope) -> Rope:
    out = EMPTY
    for r in ropes:
        out = r if not out.chars else out if not r.chars else Rope(None, 0, out, r)
    return out


def _cut_units(text: str, rank: int) -> int:
    """The code points of the first `rank` units."""
    for i, m in enumerate(UNIT.finditer(text), 1):
        if i == rank:
            return m.end()
    return 0


def split(r: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first `rank` units (or chars) and the rest."""
    left, right = [], []
    while True:
        if rank <= 0:
            right.append(r)
            break
        if rank >= getattr(r, by):
            left.append(r)
            break
        if r.text is not None:
            at = rank if by == "chars" else _cut_units(r.text, rank)
            left.append(Rope(r.text[:at], rank) if by == "units" else leaf(r.text[:at]))
            right.append(Rope(r.text[at:], r.units - rank) if by == "units" else leaf(r.text[at:]))
            break
        size = getattr(r.left, by)
        if rank <= size:
            right.append(r.right)
            r = r.left
        else:
            left.append(r.left)
            rank -= size
            r = r.right
    return joined(*left), joined(*reversed(right))


def draws(doc_id) -> list[int]:
    """The first four 32-bit numbers of the id's digest."""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id, text: str | None, plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle code points or None, output)."""
    text = text or ""
    whole = rope(text)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= plain_from:
        return whole.units, PLAIN, None, None, text
    low, high = sorted((h1 % (whole.units + 1), h2 % (whole.units + 1)))
    head, suffix = split(whole, high)
    prefix, middle = split(head, low)
    p, s, m = (Rope(x, 3) for x in SENTINELS)
    spm = h4 % 100 < spm_below
    out = joined(s, suffix, p, prefix, m, middle) if spm else joined(p, prefix, s, suffix, m, middle)
    return whole.units, SPM if spm else PSM, prefix.chars, middle.chars, str(out)


def restore(output: str, form: str) -> str:
    """The text of an output, rebuilt from the output and its form alone."""
    if form == PLAIN:
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == SPM else (PREFIX, SUFFIX, MIDDLE)
    parts, rest = {}, rope(output)
    for mark, after in zip(order, (*order[1:], None)):
        _, rest = split(rest, len(mark), "chars")
        # the rest begins where this part does, so the next sentinel's place gives the rank
        at = output.find(after, len(output) - rest.chars) - (len(output) - rest.chars) if after else rest.chars
        parts[mark], rest = split(rest, at, "chars")
    return str(joined(parts[PREFIX], parts[MIDDLE], parts[SUFFIX]))


def _rows(names: list[str], digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [transform(i, t) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            out = dict(zip(RESULTS, columns))
            if digests:
                sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
                del out["output"]
                out["output_sha256"] = pa.array([sha(m[4]) for m in made], pa.string())
                out["restored_sha256"] = pa.array([sha(restore(m[4], m[1])) for m in made], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *out.values()], names=[*names, *out])

    return run


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """docs with (n, form, prefix_chars, middle_chars, output)."""
    docs = docs.drop(*RESULTS)
    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in RESULTS.items())])
    return docs.mapInArrow(_rows(docs.columns, False), schema)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars) with digests of each output and of the text rebuilt from it."""
    docs = docs.select("doc_id", "text")
    # the text itself is not sent back
    run = _rows(["doc_id"], True)
    return docs.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")
