"""Periodic runs of words by heavy and light lag counting.

A run of smallest period q and length L >= max(6, 4 q) has L - q consecutive
places whose word comes again q words later, so lag q has at least
max(6, 4 q) - q matches. For every lag up to a quarter of the text all matches
are counted: words that occur more often than HEAVY (or the root of the text's
length) by the autocorrelation of their places, one inverse Fourier transform
for all of them, rounded to whole counts; the others by the differences of
their places, pair by pair. Only lags with enough matches go on. Of such a lag
q, every q-th place is looked at: a run covers three of them in a row. Where
that happens, the islands of matches are scanned; long enough ones are runs,
unless a divisor of q is a period too.

Words are runs of anything but ASCII white space. Null and empty texts have no
words and no runs. Repeated rows give equal rows. Other columns are ignored. A
null id stays null. An empty table gives no rows. Texts are read where they
lie, without a shuffle; a task holds one batch and the counts of one text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cmp_to_key
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import words

HEAVY, TIMES, LEAST, AT_ONCE = 16, 4, 6, 1 << 20
Run = tuple[int, int, int]


def least_length(period: int, times: int = TIMES, least: int = LEAST) -> int:
    return max(least, times * period)


def lag_counts(ids: np.ndarray, most: int, heavy: int) -> np.ndarray:
    """For each lag 0..most (0 unused) the number of places whose word comes again so many words later."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    sizes = np.bincount(ids)
    counts = np.zeros(most + 1, np.int64)
    frequent = sizes > heavy
    if frequent.any():
        size = 1 << (n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        number = np.cumsum(frequent) - 1
        rows = max(1, AT_ONCE // size)
        at = np.flatnonzero(frequent[ids])
        row = number[ids[at]]
        for lo in range(0, int(frequent.sum()), rows):
            here = (row >= lo) & (row < lo + rows)
            places = np.zeros((min(rows, int(frequent.sum()) - lo), size))
            places[row[here] - lo, at[here]] = 1
            spectrum = np.fft.rfft(places, axis=1)
            power += (spectrum.real**2 + spectrum.imag**2).sum(0)
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
        order = order[~frequent[ids[order]]]
    step = 1
    place, word = order, ids[order]
    while True:
        same = word[step:] == word[:-step]
        if not same.any():
            return counts
        gap = place[step:][same] - place[:-step][same]
        counts += np.bincount(gap[gap <= most], minlength=most + 1)
        step += 1


def _prime_divisors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def islands(ids: np.ndarray, q: int, length: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the maximal stretches of period q that have the length at least."""
    step = ids[::q]
    again = step[1:] == step[:-1]
    inner = (length - q) // q  # so many of every q-th places lie in a row inside a run, at least
    for i in range(1, inner):
        again = again[:-1] & (step[1 + i :] == step[i:-1])
    if not again.any():
        return
    match = np.concatenate(([0], (ids[q:] == ids[:-q]).view(np.int8), [0]))
    edge = np.diff(match)
    for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if e - s + q >= length:
            yield s, e - s + q


def runs(ids: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[Run]:
    """(start, length, period) of all runs, by start and period; ids are numbers of words, from 0."""
    n = len(ids)
    most = n // times
    if n < least or not most:
        return []
    counts = lag_counts(ids, most, max(HEAVY, isqrt(n)))
    lag = np.arange(most + 1)
    enough = counts >= np.maximum(least, times * lag) - lag
    out = []
    for q in (np.flatnonzero(enough[1:]) + 1).tolist():
        for s, length in islands(ids, q, least_length(q, times, least)):
            part = ids[s : s + length]
            if not any((part[q // p :] == part[: -(q // p)]).all() for p in _prime_divisors(q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(found: list[Run]) -> Run | None:
    """The run with the greatest length / period; ties by start, then period."""
    order = cmp_to_key(lambda a, b: b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2])
    return min(found, key=order) if found else None


def kept_words(n: int, found: list[Run]) -> np.ndarray:
    """Which words stay: all but those after the first period of a run."""
    gone = np.zeros(n + 1, np.int64)
    for s, length, q in found:
        gone[s + q] += 1
        gone[s + length] -= 1
    return np.cumsum(gone)[:-1] == 0


def repeated_tail(doc_id, found: list[str]) -> list[str]:
    """Of every tenth id (by its checksum) the words from a place on are a repetition of the first ones there."""
    n, h = len(found), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return found
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = found[a : a + p]
    return found[:a] + (block * (-(-(n - a) // p)))[: n - a]


def numbered(found: list[str]) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in found], np.int64)


def collapsed(docs: DataFrame, prepare=None, with_texts: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) per row of docs(doc_id, text).

    prepare changes the words of a document first. with_texts adds the collapsed text and all runs.
    """
    schema = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    more = ", collapsed string, runs array<struct<start: bigint, length: bigint, period: bigint>>" if with_texts else ""
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()

    def row(doc_id, text) -> list:
        ws = words(text)
        ws = prepare(doc_id, ws) if prepare else ws
        found = runs(numbered(ws))
        top = strongest(found)
        left = " ".join(np.array(ws, object)[kept_words(len(ws), found)].tolist() if found else ws)
        out = [doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None]
        out += [sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(left)]
        return out + [left, [dict(zip(("start", "length", "period"), r)) for r in found]] if with_texts else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        if with_texts:
            kinds += [pa.string(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))]
        names = [c.split()[0] for c in (schema + ", collapsed x, runs x").split(", ")][: len(kinds)]
        for b in batches:
            rows = [row(*r) for r in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema + more)
