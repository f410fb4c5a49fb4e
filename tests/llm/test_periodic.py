"""Periodic runs against a direct search."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from fieldloom.llm import periodic
from fieldloom.llm.common import words

SF = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def slow_runs(w):
    """Every lag over the whole text; a stretch counts for its smallest period."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and w[e] == w[e + q]:
                e += 1
            length = e - s + q
            if length >= max(6, 4 * q):
                part = w[s : s + length]
                if not any(all(part[i] == part[i + p] for i in range(length - p)) for p in range(1, q)):
                    out.append((s, length, q))
            s = max(e, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(left))


@pytest.mark.parametrize("heavy", [1, 3, 16])
def test_all_lags_are_counted_exactly(heavy):
    rnd = np.random.default_rng(heavy)
    for n, kinds in ((7, 2), (40, 3), (333, 20), (2000, 5), (2000, 900)):
        ids = np.minimum(rnd.integers(0, kinds, n), rnd.integers(0, kinds, n))
        ids = np.unique(ids, return_inverse=True)[1]
        want = [int((ids[q:] == ids[:-q]).sum()) for q in range(1, n // 4 + 1)]
        assert periodic.lag_counts(ids, n // 4, heavy)[1:].tolist() == want


def test_runs_of_random_words():
    rnd = random.Random(5)
    for trial in range(1500):
        w = [rnd.choice("abc"[: 1 + trial % 3]) for _ in range(rnd.randrange(60))]
        if trial % 2:
            for _ in range(rnd.randrange(1, 4)):
                block = [rnd.choice("abcd") for _ in range(rnd.randrange(1, 9))]
                at = rnd.randrange(len(w) + 1)
                w = w[:at] + block * rnd.randrange(3, 7) + block[: rnd.randrange(len(block))] + w[at:]
        assert periodic.runs(periodic.numbered(w)) == slow_runs(w), w


@pytest.mark.parametrize("w, want", [("", []), ("a", []), ("aaaaa", []), ("aaaaaa", [(0, 6, 1)]), ("abababab", [(0, 8, 2)]), ("xabababax", []), ("aaaaaabaaaaaa", [(0, 6, 1), (7, 6, 1)]), ("abcabcabcabc", [(0, 12, 3)]), ("aabaabaabaabaab", [(0, 15, 3)])])
def test_cases(w, want):
    assert periodic.runs(periodic.numbered(list(w))) == want == slow_runs(w)


def test_long_texts():
    """A rare word and a very frequent one, in texts of 200,000 words with runs of long periods."""
    rnd = np.random.default_rng(1)
    ids = np.minimum(rnd.zipf(1.3, 200_000), 50_000)
    block = rnd.integers(60_000, 70_000, 9_000)
    ids[20_000:60_000] = np.resize(block, 40_000)
    ids[100_000:100_300] = 7
    ids[100_300] = 99_999
    found = periodic.runs(np.unique(ids, return_inverse=True)[1])
    assert any(q == 9_000 and s <= 20_000 and s + n >= 60_000 for s, n, q in found)
    assert any(q == 1 and s <= 100_000 and s + n == 100_300 for s, n, q in found)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic.collapsed(docs, periodic.repeated_tail).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    chosen = [k for k, t in texts.items() if len(words(t)) <= 1500]
    assert len(chosen) > 150 and all(got[k] == slow_row(k, texts[k]) for k in chosen)
    assert sum(g[0] > 0 for g in got.values()) > 5


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "ha " * 7, 1), (1, "ha " * 7, 2), (2, None, 3), (None, " \n", 4), (None, "x y " * 4, 5)], "doc_id bigint, text string, n_runs int")
    rows = periodic.collapsed(docs, with_texts=True).collect()
    assert rows[0] == rows[1] and (rows[0]["n_runs"], rows[0]["collapsed"], tuple(rows[0]["runs"][0])) == (1, "ha", (0, 7, 1))
    assert [(r["n_runs"], r["start"], r["collapsed_sha256"]) for r in rows[2:4]] == [(0, None, sha(""))] * 2 and rows[4]["collapsed"] == "x y"
    assert periodic.collapsed(docs.where("false"), periodic.repeated_tail).collect() == []
