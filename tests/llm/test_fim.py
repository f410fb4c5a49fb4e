"""Fill-in-middle against plain string slices."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import fim

SF = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "a", "<P>", "x<M>y", "ab cd", "é\n\x00 ab12", "\U0001f600ab" * 900, "a" * 5000, " " * 3000, "word " * 3000, "<" * 40, "<P<S><", "P>S>M>"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_slices_and_inverts(text):
    forms = set()
    for doc_id in (*range(60), -7, 2**40):
        got = fim.transform(doc_id, text)
        assert got == plain(doc_id, text)
        assert fim.restore(got[4], got[1]) == (text or "")
        forms.add(got[1])
    assert forms == {"plain"} if not text or re.search("<[PSM]>", text) else forms == {"plain", "psm", "spm"}


@given(st.text(alphabet="ab <PSM>é1", max_size=700), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_any_text(text, doc_id):
    got = fim.transform(doc_id, text)
    assert got == plain(doc_id, text) and fim.restore(got[4], got[1]) == text


def test_rope_splits():
    """Trees stay shallow, nodes know their sizes, and every split equals a slice."""
    text = "".join(f"word{i} é" for i in range(3000))
    r = fim.rope(text)
    assert str(r) == text and r.chars == len(text) and r.depth <= 8
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert r.units == len(units)
    for k in (0, 1, 255, 256, 257, 9000, len(units) - 1, len(units), len(units) + 5):
        a, b = fim.split(r, k)
        assert (str(a), str(b)) == ("".join(units[:k]), "".join(units[k:])) and a.units == min(k, len(units)) and a.units + b.units == len(units)
        a, b = fim.split(r, k, "chars")
        assert (str(a), str(b)) == (text[:k], text[k:])
        assert a.units == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text[:k]))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in fim.digests(docs).collect()}
    want = {}
    for r in docs.collect():
        p = plain(r["doc_id"], r["text"])
        want[r["doc_id"]] = (*p[:4], sha(p[4]), sha(r["text"] or ""))
    assert got == want and {g[1] for g in got.values()} == {"plain", "psm", "spm"}


def test_nulls_clashes_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab cd", "x", 1.5), (1, "ab cd", "x", 1.5), (None, "ab", None, None), (2, None, "y", None)], "doc_id bigint, text string, form string, more double")
    rows = fim.fill_in_middle(docs).collect()
    assert len(rows) == 4 and rows[0] == rows[1] and [r["more"] for r in rows] == [1.5, 1.5, None, None]
    assert (rows[0]["n"], rows[0]["form"], rows[0]["output"]) == tuple(plain(1, "ab cd")[i] for i in (0, 1, 4))
    assert rows[2]["output"] == plain("null", "ab")[4] and rows[3]["form"] == "plain"
    assert fim.digests(docs.where("false")).collect() == [] and fim.fill_in_middle(docs.where("false")).count() == 0
