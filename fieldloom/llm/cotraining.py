"""Quality classifier by co-training.

Two logistic models see two views of a document: its text (hashed words,
hashed word endings, shares of symbols, capitals, digits and repeats) and its
metadata (source, language, length). Over some rounds each model labels the
unlabelled documents that it ranks highest and lowest, at most as many of
either class as the labels' share says, and these pseudo-labels join the other
model's training rows. A view gives only rows beyond the score from which, on
labels kept out of training, it is right so often that the lower bound of its
precision (Wilson, 95 %) reaches SURE; a view or class that never gets there
gives none. Then each view is calibrated by a logistic fit on labels kept
out of training, and a second fit with weights of 0 or more adds the two views'
log-odds. A further fifth of the labels only measures the accuracy.

Fitting uses a sample of at most `sample` labelled rows (by a hash of the id).
In each round both models score every unlabelled document twice: first for a
table of score counts of fixed size, which gives the cut-off ranks, then for
the rows beyond these, a tenth of the labelled sample in all, which alone move
to the driver. Scoring covers every document without a shuffle. A good document
has quality 1 and is not toxic. Scores are in [0, 1]; a document is kept from
the threshold on.

Null text, source, language or length count as values of their own; with fewer
than 20 labelled rows or labels of one class only every document is kept with
score 0.5. Repeated rows repeat; of rows with one id and different texts one
stands for the id in fitting. An input column named p_text, p_meta, score or
kept is replaced, other columns stay. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import hashed_words, sliced, table_cut

SAMPLE, ROUNDS, SHAPES, WORDS, ENDINGS = 8000, 3, 8, 1 << 15, 256
WIDTHS = (SHAPES + WORDS + ENDINGS, 897)
RESULTS = ("p_text", "p_meta", "score", "kept")
BINS, REACH, SURE = 4000, 20.0, 0.9
PACKED = "doc_id bigint, shape binary, words binary, meta binary"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


MARKS, SYMBOLS, DIGITS = _table(b".,;:!?\"'()[]"), _table(b"#*$%&|<>!{}=;"), _table(b"0123456789")
INNER, LEADS = _table(bytes(range(128, 192))), _table(bytes(range(192, 256)))
UPPER, LOWER = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))


@dataclass
class Views:
    """Both views of some documents: shapes, the words' places (of all rows, sizes apart) and the metadata's places."""

    shape: np.ndarray
    at: np.ndarray
    size: np.ndarray
    meta: np.ndarray

    def __post_init__(self):
        self.rows = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.weight = 2 / np.sqrt(np.maximum(10, self.size))

    def dot(self, view: int, w: np.ndarray) -> np.ndarray:
        if view:
            return w[self.meta].sum(1)
        return self.shape @ w[:SHAPES] + self.weight * np.bincount(self.rows, w[SHAPES:][self.at], len(self.size))

    def back(self, view: int, r: np.ndarray) -> np.ndarray:
        if view:
            return np.bincount(self.meta.ravel(), np.repeat(r, self.meta.shape[1]), WIDTHS[1])
        return np.append(self.shape.T @ r, np.bincount(self.at, (self.weight * r)[self.rows], WIDTHS[0] - SHAPES))

    def packed(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        ends = np.cumsum(self.size)
        raw, begin = self.at.astype("<u2").tobytes(), ends - self.size
        words = [raw[2 * x : 2 * y] for x, y in zip(begin.tolist(), ends.tolist())]
        return tuple(pa.array(x, pa.binary()) for x in ([s.tobytes() for s in self.shape.astype("<f4")], words, [m.tobytes() for m in self.meta.astype("<u2")]))


def unpacked(shape: list[bytes], words: list[bytes], meta: list[bytes]) -> Views:
    joined = lambda rows, kind: np.frombuffer(b"".join(rows), kind)
    return Views(joined(shape, "<f4").reshape(-1, SHAPES).astype(float), joined(words, "<u2").astype(np.int32), np.array([len(w) // 2 for w in words], np.int64), joined(meta, "<u2").reshape(-1, 5).astype(np.int32))


def text_views(column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(shapes, places of distinct words and endings) of some rows at a time."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for lo, hi, b, places, first, end, h in hashed_words(column, fold=True, marks=MARKS, most=1 << 20):
        begin = np.append(0, np.cumsum(lengths[lo:hi]))
        shape, at = np.zeros((hi - lo, SHAPES)), []
        shape[:, 0] = 1
        sums = {k: np.append(np.int32(0), np.cumsum(t[b], dtype=np.int32)) for k, t in (("symbol", SYMBOLS), ("digit", DIGITS), ("upper", UPPER), ("lower", LOWER), ("char", ~INNER), ("wide", LEADS))}
        capital = (sums["upper"][end] > sums["upper"][first]) & (sums["lower"][end] == sums["lower"][first])
        size = end - first
        ending = np.zeros(len(first), np.int64)
        for i in range(1, 4):
            ending = ending * 31 + np.where(size >= i, b[np.maximum(end - i, 0)], 0)
        word_at, ending_at = (h % np.uint64(WORDS)).astype(np.int64), WORDS + (ending * 40503 >> 4) % ENDINGS
        for i, (p, q) in enumerate(zip(places.tolist(), places[1:].tolist())):
            n = q - p
            if not n:
                at.append(word_at[:0])
                continue
            x, y = begin[i], begin[i + 1]
            raw = b[x:y].tobytes()
            lines = [line for line in raw.split(b"\n") if line.strip()]
            many = {k: int(s[y] - s[x]) for k, s in sums.items()}
            if many["wide"]:
                text = raw.decode("utf-8", "replace")
                many["digit"] += sum(text.count(c) for c in set(text) if c > "\x7f" and c.isdigit())
            shape[i, 1:] = (10 * many["symbol"] / many["char"], 5 * capital[p:q].mean(), size[p:q].mean() / 10, 3 * (1 - len(set(lines)) / len(lines)), 2 * len(np.unique(h[p:q])) / n, np.log1p(n) / 10, 10 * many["digit"] / many["char"])
            at.append(np.append(np.unique(word_at[p:q]), np.unique(ending_at[p:q])))
        yield shape, at


def _bucket(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % n


def meta_places(lang, source, n_chars) -> tuple[int, ...]:
    size = -1 if n_chars is None else int(4 * np.log1p(max(0, n_chars)))
    return 0, 1 + _bucket(f"l{lang}", 64), 65 + _bucket(f"s{source}", 256), 321 + _bucket(f"n{size}", 64), 385 + _bucket(f"{lang}/{source}", 512)


def views_of(b: pa.RecordBatch) -> Views:
    shapes, at = [np.zeros((0, SHAPES))], []
    for s, places in text_views(b.column("text")):
        shapes.append(s)
        at += places
    meta = [meta_places(*r) for r in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")))]
    return Views(np.concatenate(shapes), np.concatenate([*at, np.zeros(0, np.int64)]), np.array([len(a) for a in at], np.int64), np.array(meta, np.int32).reshape(-1, 5))


def views(docs: DataFrame) -> DataFrame:
    """Both views of each row, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *views_of(b).packed()], names=["doc_id", "shape", "words", "meta"])

    return docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars")).mapInArrow(sliced(run), PACKED)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(dot, back, width: int, y: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.5, l2: float = 1e-4, least: np.ndarray | None = None) -> np.ndarray:
    """Weights by adaptive gradient steps; least has lower bounds."""
    w, seen = np.zeros(width), np.full(width, 1e-8)
    for _ in range(steps):
        g = back(weight * (sigmoid(dot(w)) - y)) / weight.sum() + l2 * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        w = w if least is None else np.maximum(w, least)
    return w


def sure_from(z: np.ndarray, good: np.ndarray, sure: float = SURE) -> tuple[float, float]:
    """The scores up to which rows are bad and from which they are good, surely enough on these labelled rows; infinite without such a score."""
    out = []
    for side, right in ((z, good == 0), (-z, good == 1)):
        order = np.argsort(side, kind="stable")
        n, hits = np.arange(1, len(z) + 1), np.cumsum(right[order])
        p, w = hits / n, 1.96**2 / n
        low = (p + w / 2 - np.sqrt(w * (p * (1 - p) + w / 4))) / (1 + w)
        # equal scores count together
        ends = np.append(side[order][1:] != side[order][:-1], True) if len(z) else np.zeros(0, bool)
        ok = np.flatnonzero(ends & (low >= sure))
        out.append(float(side[order][ok[-1]]) if len(ok) else -np.inf)
    return out[0], -out[1]


def surest(pool: DataFrame, models: list[np.ndarray], quota: tuple[int, int], taken: list[list[int]], bounds: list[tuple[float, float]] | None = None) -> list[tuple[int, int, object]]:
    """(view, good, row): at most quota[good] rows of either class that each view ranks surest in the whole pool, beyond its bounds and without those taken from it before."""
    bounds = bounds or [(np.inf, -np.inf)] * 2
    if all(b == (-np.inf, np.inf) for b in bounds):
        return []
    gone = [np.array(sorted(t), np.int64) for t in taken]

    def scored(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        v = unpacked(*(b.column(c).to_pylist() for c in ("shape", "words", "meta")))
        ids = b.column("doc_id").to_numpy()
        for view in (0, 1):
            z = v.dot(view, models[view])
            yield view, z, ~np.isin(ids, gone[view])

    def beyond(view: int, good: int, z: np.ndarray) -> np.ndarray:
        return z >= bounds[view][1] if good else z <= bounds[view][0]

    def place(z: np.ndarray) -> np.ndarray:
        return np.clip(((z + REACH) * BINS / (2 * REACH)).astype(np.int64), 0, BINS - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS), np.int64)
        for b in batches:
            for view, z, free in scored(b):
                counts[view] += np.bincount(place(z[free]), minlength=BINS)
        view, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(view), pa.array(at), pa.array(counts[view, at])], names=["view", "at", "n"])

    counts = np.zeros((2, BINS), np.int64)
    for r in pool.mapInArrow(sliced(count), "view bigint, at bigint, n bigint").groupBy("view", "at").agg(F.sum("n").alias("n")).collect():
        counts[r["view"], r["at"]] = r["n"]
    cuts = [(int(np.searchsorted(np.cumsum(c), quota[0])), BINS - 1 - int(np.searchsorted(np.cumsum(c[::-1]), quota[1]))) for c in counts]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for view, z, free in scored(b):
                for good, ok, far in ((0, place(z) <= cuts[view][0], z), (1, place(z) >= cuts[view][1], -z)):
                    ok = np.flatnonzero(ok & free & beyond(view, good, z))
                    part = b.take(pa.array(ok))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ok), view)), pa.array(np.full(len(ok), good)), pa.array(far[ok]), *part.columns], names=["view", "good", "far", *part.schema.names])

    found = table_cut(pool.mapInArrow(sliced(pick), "view bigint, good bigint, far double, " + PACKED))
    out = []
    for view in (0, 1):
        for good in (0, 1):
            one = found.where((F.col("view") == view) & (F.col("good") == good)).groupBy("doc_id").agg(F.min(F.struct("far", "shape", "words", "meta")).alias("r"))
            out += [(view, good, r) for r in one.select("doc_id", "r.*").orderBy("far", "doc_id").limit(quota[good]).collect()]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, sure: float = SURE) -> dict | None:
    """Weights of both views and of the combination; None with fewer than 20 labelled rows or without labels of both classes."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") - F.max(F.coalesce("toxic", F.lit(0))) > 0).cast("int").alias("good"))
    named = docs.where("doc_id is not null")
    both = named.select("doc_id").distinct().join(known.hint("merge"), "doc_id").withColumn("order", F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 40)))
    # a threshold on the hash leaves little more than the sample, however many labels there are
    share = min(1.0, 1.2 * sample / max(1, both.count()) + 1e-9)
    chosen = {r["doc_id"]: r["good"] for r in both.where(F.col("order") < int(share * (1 << 40))).orderBy("order", "doc_id").limit(sample).collect()}
    if len(chosen) < 20 or len(set(chosen.values())) < 2:
        return None
    picked = named.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id bigint")), "doc_id", "left_semi")
    rows = views(picked).groupBy("doc_id").agg(F.min(F.struct("shape", "words", "meta")).alias("r")).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))
    good = np.array([chosen[r["doc_id"]] for r in rows])
    # three fifths train, one calibrates, one measures
    part = np.arange(len(rows)) % 5
    train, held, last = np.flatnonzero(part > 1), np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    of = lambda some: unpacked(*([r[c] for r in some] for c in ("shape", "words", "meta")))
    tenth = max(2, len(rows) // 10)
    quota = (max(1, int(tenth * (1 - good.mean()))), max(1, int(tenth * good.mean())))
    pool = table_cut(views(named).join(known.select("doc_id").hint("merge"), "doc_id", "left_anti")) if rounds else None
    extra: list[dict] = [{}, {}]  # what each model learns from the other view: doc_id -> (label, row)
    for r in range(rounds + 1):
        models = []
        for view in (0, 1):
            more = list(extra[view].values())
            m = of([rows[i] for i in train] + [x for _, x in more])
            y = np.append(good[train], [label for label, _ in more]).astype(float)
            models.append(fit_logistic(lambda w, m=m, v=view: m.dot(v, w), lambda g, m=m, v=view: m.back(v, g), WIDTHS[view], y, np.append(np.ones(len(train)), np.full(len(more), 0.3))))
        if r == rounds:
            break
        bounds = [sure_from(of([rows[i] for i in held]).dot(v, models[v]), good[held], sure) for v in (0, 1)]
        for view, label, x in surest(pool, models, quota, [list(extra[1 - v]) for v in (0, 1)], bounds):
            extra[1 - view].setdefault(x["doc_id"], (label, x))
    z = lambda some: np.stack([of([rows[i] for i in some]).dot(v, models[v]) for v in (0, 1)])
    yh, zh = good[held].astype(float), z(held)

    def line(columns: np.ndarray) -> np.ndarray:
        m = np.vstack([np.ones(columns.shape[1]), columns])
        return fit_logistic(lambda w: w @ m, lambda g: m @ g, len(m), yh, np.ones(len(yh)), 400, least=np.append(-np.inf, np.zeros(len(m) - 1)))

    scale = [line(zh[v : v + 1]) for v in (0, 1)]
    odds = lambda zs: np.stack([scale[v][0] + scale[v][1] * zs[v] for v in (0, 1)])
    top = line(odds(zh))
    score = sigmoid(top[0] + top[1:] @ odds(z(last)))
    return {"views": models, "scale": scale, "top": top, "accuracy": float(((score >= 0.5) == good[last]).mean()), "measured": len(last), "learned": [[sum(label == g for label, _ in e.values()) for g in (0, 1)] for e in extra]}


def score(docs: DataFrame, model: dict | None, threshold: float = 0.5) -> DataFrame:
    """docs with p_text, p_meta, score and kept."""
    docs = docs.drop(*RESULTS)
    names = docs.columns
    with_size = docs.withColumn("__n_chars", F.col("n_chars").cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.full((3, b.num_rows), 0.5)
            if model is not None:
                v = views_of(pa.RecordBatch.from_arrays([b.column(c) for c in ("text", "lang", "source", "__n_chars")], names=["text", "lang", "source", "n_chars"]))
                odds = np.stack([s[0] + s[1] * v.dot(k, w) for k, (w, s) in enumerate(zip(model["views"], model["scale"]))])
                p = sigmoid(np.vstack([odds, model["top"][0] + model["top"][1:] @ odds]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *map(pa.array, p), pa.array((p[2] >= threshold) | (model is None))], names=[*names, *RESULTS])

    schema = StructType([*docs.schema.fields, *(StructField(n, BooleanType() if n == "kept" else DoubleType()) for n in RESULTS)])
    return with_size.mapInArrow(sliced(run), schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, threshold: float = 0.5) -> DataFrame:
    return score(docs, fit(docs, labels, sample, rounds), threshold)
