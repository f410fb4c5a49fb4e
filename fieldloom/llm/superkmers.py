"""Substring dedup by super-k-mer partitioning.

A window is 20 consecutive words. Its minimiser is the least hash among its
runs of 6 words. Consecutive windows of one minimiser form a super-k-mer, cut
after LONGEST windows; equal windows always lie in super-k-mers of one minimiser.

First only minimisers and places move: sorted by minimiser, those that occur
twice or more are known exactly, and all other super-k-mers stay where they
are. The rest then travel, each once, as one packed string to the bucket of its
minimiser. A bucket's strings arrive in the order of documents and places;
sorting its windows (by two 64-bit hashes) puts equal ones together with the
first in front, and the others count as repeats whose words are removed. The
words themselves are compared before that: stretches of repeats with the
stretch they repeat, byte by byte, and where hashes deceive, all windows.

A bucket takes at most MOST super-k-mers. A minimiser with more is split in
parts by place: each part settles the repeats within it and passes on one
first place per window (under a 128-bit digest of its words); the least of
those, aggregated per window, settles the rest. Of minimisers alone, which are
a few numbers each and only streamed, one task reads all that are equal. Texts
and super-k-mers come to Python in batches of about 4 MiB (a setting that stays,
unless the session has its own), and buckets are settled some 4 MiB or 10,000
super-k-mers at once, or a larger bucket alone.

Null text has no words. Documents of under 20 words are never changed. Null ids
sort first. Rows with one doc_id and different texts are documents of their
own, in the order of a hash of their texts; equal rows are one document, and
each gets its result. An input column with the name of a result column is
replaced; other columns stay. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import A, B, both, hashed_words, in_order, mix, sliced, small_batches, table_cut

SPAN, MER, MOST, LONGEST = 20, 6, 10_000, 32
RESULTS = ("n_words", "n_removed", "kept_sha256", "kept")


def runs(h: np.ndarray, places: np.ndarray, span: int, mer: int) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, minimiser, whether it occurs twice) of each super-k-mer; h has the word hashes of all rows, places where each row begins."""
    none = np.zeros(0, np.int64)
    if len(h) < span:
        return none, none, none, none, none.astype(bool)
    m = np.zeros(len(h) - mer + 1, np.uint64)
    for i in range(mer):
        m = mix((m ^ h[i : i + len(m)]) * A)
    low, width, size = m, 1, span - mer + 1
    while 2 * width <= size:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < size:
        low = np.minimum(low[: len(low) - (size - width)], low[size - width :])
    words = np.diff(places)
    whole = (np.arange(len(h)) + span <= np.repeat(places[1:], words))[: len(low)]
    begins = np.zeros(len(h) + 1, bool)
    begins[places[:-1]] = True
    first = np.flatnonzero(whole & (begins[: len(low)] | np.append(True, (low[1:] != low[:-1]) | ~whole[:-1])))
    many = np.add.reduceat(np.append(whole, False).astype(np.int64), first) if len(first) else none
    # long runs (of texts that repeat themselves) in pieces
    pieces = -(-many // LONGEST)
    skip = LONGEST * in_order(np.zeros(len(first), np.int64), pieces)
    first, many = np.repeat(first, pieces) + skip, np.minimum(np.repeat(many, pieces) - skip, LONGEST)
    mini, last = low[first], first + many - 1
    hits = np.add.reduceat(np.append((m[: len(low)] == low) & whole, False).astype(np.int64), first) if len(first) else none
    for i in range(1, size):
        hits += m[last + i] == mini
    row = np.searchsorted(places, first, "right") - 1
    return row, first - places[row], many, mini.view(np.int64), hits > 1


def joined(b: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words, each followed by one space, and where each begins (and the last one ends)."""
    at = np.append(0, np.cumsum(end - first + 1))
    out = b[np.minimum(in_order(first, end - first + 1), max(0, len(b) - 1))]
    out[at[1:] - 1] = 32
    return out.tobytes(), at


def _minimisers(span: int, mer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, _, places, _, _, h in hashed_words(b.column("text")):
                row, start, _, mini, twice = runs(h, places, span, mer)
                row = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays([pa.array(mini), b.column("doc_id").take(row), b.column("tag").take(row), pa.array(2 * start + twice)], names=["mini", "doc_id", "tag", "code"])

    return run


def _repeated(most: int):
    """Of rows in the order of mini, those whose minimiser occurs twice: their start, and the part of a minimiser with over `most` (else -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot, done = None, None, 0  # rows of the last minimiser; it, if it is known to be hot, and its rows so far

        def work(t: pa.Table, ended: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, hot, done
            mini, code = t.column("mini").to_numpy(), t.column("code").to_numpy()
            if not len(mini):
                return
            begin = np.flatnonzero(np.append(True, mini[1:] != mini[:-1]))
            size = np.diff(np.append(begin, len(mini)))
            before = np.zeros(len(begin), np.int64)
            before[0] = done if hot == mini[0] else 0
            large = before + size > most
            index = np.arange(len(mini)) - np.repeat(begin - before, size)
            send = np.repeat((before + size > 1), size) | (code % 2 == 1)
            cut = len(mini)
            if not ended and not large[-1]:
                cut = int(begin[-1])
            hot, done = (mini[-1], int(before[-1] + size[-1])) if large[-1] else (None, 0)
            held = t.slice(cut) if cut < len(mini) else None
            send[cut:] = False
            part = np.where(np.repeat(large, size), index // most, -1)
            for r in t.filter(pa.array(send)).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([r.column("doc_id"), r.column("tag"), pa.array((code[send] // 2 << 20) + part[send] + 1)], names=["doc_id", "tag", "code"])

        for b in batches:
            new = pa.Table.from_batches([b])
            yield from work(pa.concat_tables([held, new]) if held is not None else new, False)
        if held is not None:
            yield from work(held, True)

    return run


def _packed(span: int, mer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column("codes")
            for lo, hi, raw, places, first, end, h in hashed_words(b.column("text")):
                row, start, many, mini, _ = runs(h, places, span, mer)
                code, owner = pa.array(codes.slice(lo, hi - lo)).flatten().to_numpy(), np.repeat(np.arange(hi - lo), np.diff(codes.slice(lo, hi - lo).offsets.to_numpy()))
                # all runs of the rows are in order of row and start, so the places sent are found by search
                order = np.argsort(owner << 40 | code >> 20, kind="stable")
                at = np.searchsorted(row << 40 | start, (owner << 40 | code >> 20)[order])
                text, begin = joined(raw, first, end)
                head = places[row[at]] + start[at]
                packed = [text[x : y - 1] for x, y in zip(begin[head].tolist(), begin[head + many[at] + span - 1].tolist())]
                rows = pa.array(lo + row[at])
                part = (code[order] & (1 << 20) - 1) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mini[at]), pa.array(part), b.column("doc_id").take(rows), b.column("tag").take(rows), pa.array(start[at]), pa.array(packed, pa.binary())], names=["mini", "part", "doc_id", "tag", "start", "packed"]
                )

    return run


def spans(h: np.ndarray, span: int) -> np.ndarray:
    """A hash of the `span` hashes from each place on, by doubling; zero where there are fewer."""
    out, done, width, power = None, 0, 1, h
    while done < span:
        if span & width:
            part = power[done:]
            out = part if out is None else both(out[: len(part)], part)
            done += width
        if done < span:
            power = both(power[: max(0, len(power) - width)], power[width:])
            width *= 2
    return np.append(out, np.zeros(len(h) - len(out), np.uint64))


def same_words(packed: pa.Array, row: np.ndarray, opens: np.ndarray, closes: np.ndarray, first: np.ndarray, lead: np.ndarray) -> bool:
    """Whether each window that is not first has the bytes of its lead; windows in step with their leads are compared in one stretch."""
    i = np.flatnonzero(~first)
    if not len(i):
        return True
    j = lead[i]
    step = (np.diff(i) == 1) & (np.diff(j) == 1) & (np.diff(row[i]) == 0) & (np.diff(row[j]) == 0)
    s, e = np.flatnonzero(np.append(True, ~step)), np.flatnonzero(np.append(~step, True))
    places = zip(row[i[s]].tolist(), opens[i[s]].tolist(), closes[i[e]].tolist(), row[j[s]].tolist(), opens[j[s]].tolist(), closes[j[e]].tolist())
    data, ends = memoryview(packed.buffers()[2]), np.frombuffer(packed.buffers()[1], np.int32)[packed.offset :]
    at = lambda r, x, y: data[ends[r] + x : ends[r] + y]
    return all(at(a, b, c) == at(d, f, g) for a, b, c, d, f, g in places)


def first_windows(packed: pa.Array, bucket: np.ndarray, row: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Which windows are the first of their words in their bucket, by the words alone."""
    seen: set = set()
    out = np.zeros(len(row), bool)
    texts = packed.to_pylist()
    for k, (b, r, x, y) in enumerate(zip(bucket.tolist(), row.tolist(), opens.tolist(), closes.tolist())):
        key = b, hashlib.blake2b(texts[r][x:y], digest_size=16).digest()
        out[k] = key not in seen
        seen.add(key)
    return out


FOUND = "window binary, doc_id bigint, tag bigint, start bigint, many bigint"


def _bucket(span: int, rows_at_once: int = 10_000, bytes_at_once: int = 4 << 20):
    """Ranges of windows that repeat an earlier one of their bucket; of parts also each window's first place.

    Rows arrive in the order of minimiser, part, document and place.
    """

    def work(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        mini, part, start = (t.column(c).to_numpy() for c in ("mini", "part", "start"))
        bucket = np.append(0, np.cumsum((mini[1:] != mini[:-1]) | (part[1:] != part[:-1])))
        row, place, one, two, opens, closes = [], [], [], [], [], []
        for lo, hi, _, places, first_byte, end_byte, h in hashed_words(t.column("packed")):
            windows = np.diff(places) - span + 1
            at = in_order(places[:-1], windows)
            for out, code in ((one, h), (two, mix((h ^ B) * A))):
                out.append(spans(code, span)[at])
            row.append(np.repeat(np.arange(lo, hi), windows))
            place.append(in_order(start[lo:hi], windows))
            # the bytes of each window, counted from its row's begin
            begin = np.repeat(first_byte[places[:-1]], windows)
            opens.append(first_byte[at] - begin), closes.append(end_byte[at + span - 1] - begin)
        row, place, one, two, opens, closes = map(np.concatenate, (row, place, one, two, opens, closes))
        order = np.lexsort((two, one, bucket[row]))
        b, x, y = bucket[row][order], one[order], two[order]
        leads = np.append(True, (b[1:] != b[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        first = np.zeros(len(row), bool)
        first[order[leads]] = True
        lead = np.empty(len(row), np.int64)
        lead[order] = order[np.flatnonzero(leads)][np.cumsum(leads) - 1]
        words = t.column("packed").combine_chunks()
        if not same_words(words, row, opens, closes, first, lead):
            first = first_windows(words, bucket[row], row, opens, closes)
        # ranges of repeats, within one super-k-mer each
        again = ~first
        begin = np.flatnonzero(again & np.append(True, ~again[:-1] | (row[1:] != row[:-1])))
        last = np.flatnonzero(again & np.append(~again[1:] | (row[1:] != row[:-1]), True))
        local = np.flatnonzero(first & (part[row] >= 0))
        texts = {i: words[i].as_py() for i in np.unique(row[local]).tolist()}
        prints = [hashlib.blake2b(texts[i][x:y], digest_size=16).digest() for i, x, y in zip(row[local].tolist(), opens[local].tolist(), closes[local].tolist())]
        taken = pa.array(np.append(row[begin], row[local]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None] * len(begin) + prints, pa.binary()),
                *(t.column(c).combine_chunks().take(taken) for c in ("doc_id", "tag")),
                pa.array(np.append(place[begin], place[local])),
                pa.array(np.append(last - begin + 1, np.ones(len(local), np.int64))),
            ],
            names=["window", "doc_id", "tag", "start", "many"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < rows_at_once and sum(x.nbytes for x in held) < bytes_at_once:
                continue
            t = pa.Table.from_batches(held)
            mini, part = t.column("mini").to_numpy(), t.column("part").to_numpy()
            cut = np.flatnonzero((mini != mini[-1]) | (part != part[-1]))
            if len(cut):
                yield work(t.slice(0, int(cut[-1]) + 1))
                held = t.slice(int(cut[-1]) + 1).to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def repeats(docs: DataFrame, unique: bool, span: int = SPAN, mer: int = MER, most: int = MOST) -> DataFrame:
    """(doc_id, tag, start, many): ranges of windows that repeat an earlier one; docs(doc_id, tag, text), unique if no (doc_id, tag) comes twice."""
    minis = docs.mapInArrow(sliced(_minimisers(span, mer)), "mini bigint, doc_id bigint, tag bigint, code bigint")
    twice = minis.repartition("mini").sortWithinPartitions("mini", "doc_id", "tag", "code").mapInArrow(_repeated(most), "doc_id bigint, tag bigint, code bigint")
    twice = twice if unique else twice.distinct()
    codes = twice.groupBy("doc_id", "tag").agg(F.collect_list("code").alias("codes")).withColumnsRenamed({"doc_id": "id", "tag": "of"})
    one = docs if unique else docs.groupBy("doc_id", "tag").agg(F.first("text").alias("text"))
    texts = one.join(codes.hint("merge"), one["doc_id"].eqNullSafe(codes["id"]) & (one["tag"] == codes["of"])).select("doc_id", "tag", "text", "codes")
    packed = texts.mapInArrow(sliced(_packed(span, mer)), "mini bigint, part bigint, doc_id bigint, tag bigint, start bigint, packed binary")
    found = table_cut(packed.repartition("mini", "part").sortWithinPartitions("mini", "part", "doc_id", "tag", "start").mapInArrow(sliced(_bucket(span)), FOUND))
    local = found.where("window is not null").select("window", F.struct("doc_id", "tag", "start").alias("place"))
    first = local.groupBy("window").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("window", "first")
    later = local.join(first.hint("merge"), "window").where("place > first").select("place.*", F.lit(1).cast("bigint").alias("many"))
    return found.where("window is null").select("doc_id", "tag", "start", "many").unionByName(later)


def _removed(names: list[str], span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, digests, kept = [], [], [], []
            starts, manys = (b.column(c) for c in ("__starts", "__manys"))
            for lo, hi, raw, places, first, end, _ in hashed_words(b.column("__text")):
                s, many = (x.slice(lo, hi - lo) for x in (starts, manys))
                sizes = np.diff(s.offsets.to_numpy()) * s.is_valid().to_numpy(zero_copy_only=False)
                at = np.repeat(places[:-1], sizes) + s.flatten().to_numpy()
                gone = np.zeros(len(first) + 1, np.int64)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + many.flatten().to_numpy() + span - 1, -1)
                keep = np.cumsum(gone)[:-1] == 0
                text, begin = joined(raw, first[keep], end[keep])
                stay = np.append(0, np.cumsum(keep))[places]
                for x, y, words in zip(stay.tolist(), stay[1:].tolist(), np.diff(places).tolist()):
                    line = text[begin[x] : begin[y] - 1] if y > x else b""
                    n_words.append(words)
                    n_removed.append(words - (y - x))
                    digests.append(hashlib.sha256(line).hexdigest())
                    kept.append(line if y - x < words else None)
            new = pa.array(kept, pa.binary())
            new = pa.StringArray.from_buffers(len(new), new.buffers()[1], new.buffers()[2], new.buffers()[0])
            out = pc.if_else(pa.array(np.array(n_removed, np.int64) > 0), new, b.column("__text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), out], names=[*names, *RESULTS])

    return run


def dedup(docs: DataFrame, span: int = SPAN, mer: int = MER, most: int = MOST) -> DataFrame:
    """docs with (n_words, n_removed, kept_sha256, kept): the words that stay, joined by a space; kept is the text itself if nothing goes."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*RESULTS)
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
    tag = F.lit(0).cast("bigint") if unique else F.xxhash64(F.col("text").cast("binary"))
    found = repeats(docs.select("doc_id", tag.alias("tag"), "text"), unique, span, mer, most)
    found = found.groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__of")).agg(F.collect_list("start").alias("__starts"), F.collect_list("many").alias("__manys"))
    joined_docs = docs.withColumn("__text", F.col("text")).join(found.hint("merge"), docs["doc_id"].eqNullSafe(found["__id"]) & (tag == found["__of"]), "left").drop("__id", "__of")
    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(RESULTS, (LongType(), LongType(), StringType(), StringType())))])
    return joined_docs.mapInArrow(sliced(_removed(docs.columns, span)), schema)
