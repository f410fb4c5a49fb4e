"""Co-training: features of very long texts."""

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import cotraining


def _shape(text):
    return next(cotraining.text_views(pa.array(["before", text])))[0][1]


@pytest.mark.parametrize("n", [100, 19_999, 20_000, 25_000])
def test_digit_share_of_whole_text(n):
    text = " ".join(["12ab \u0663\u00b2"] * (n // 2))
    assert _shape(text)[cotraining.SHAPES - 1] == 10 * sum(c.isdigit() for c in text) / len(text) > 4


def test_long_digit_junk_scores_like_short():
    assert _shape("7 " * 30_000)[cotraining.SHAPES - 1] == _shape("7 " * 300)[cotraining.SHAPES - 1] == 5


def test_surest_come_from_the_whole_pool(spark):
    """The surest rows of either class are found wherever they lie, once each, and not again."""
    n = 3000
    docs = spark.createDataFrame([(i, "good " * (i + 1) if i < 5 else "bad " * 9 if i >= n - 5 else "middle", "en", "s", 5) for i in range(n)] + [(0, "good", "en", "s", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(7)
    text, meta = np.zeros(cotraining.WIDTHS[0]), np.zeros(cotraining.WIDTHS[1])
    word = lambda w: cotraining.SHAPES + next(cotraining.text_views(pa.array([w])))[1][0][0]
    text[word("good")], text[word("bad")] = 9, -9
    pool = cotraining.views(docs)
    got = cotraining.surest(pool, [text, meta], (4, 4), [[], []])
    text_view = lambda rows: [(v, g, r["doc_id"]) for v, g, r in rows if v == 0]
    assert sorted(text_view(got)) == [(0, 0, n - 5 + i) for i in range(4)] + [(0, 1, i) for i in range(4)]
    more = cotraining.surest(pool, [text, meta], (4, 4), [[r["doc_id"] for _, _, r in got], []])
    assert {(0, 0, n - 1), (0, 1, 4)} <= set(text_view(more)) and not set(text_view(more)) & set(text_view(got))


def test_unlabelled_beyond_the_sample_take_part(spark, monkeypatch):
    """With a sample of 40 rows every unlabelled row is scored in each round."""
    seen = []
    monkeypatch.setattr(cotraining, "surest", lambda pool, *a: seen.append(pool.count()) or [])
    docs = spark.createDataFrame([(i, "good text" if i % 2 else "bad text", "en", "s", 8) for i in range(500)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id bigint, quality int, toxic int")
    assert cotraining.fit(docs, labels, sample=40)["measured"] == 8 and seen == [400] * cotraining.ROUNDS
    assert cotraining.fit(docs, labels.where("doc_id < 19")) is None


def test_features_of_rows(spark):
    """Both views equal a plain computation row by row, whatever the batch."""
    texts = [None, "", " \n ", "One TWO three, three!\nx\nx\n", "Ünï 12 ٣ #$ ABC", "w " * 5000]
    shapes, at = [], []
    for s, places in cotraining.text_views(pa.array(texts)):
        shapes += s.tolist()
        at += places
    for text, x, places in zip(texts, shapes, at):
        ws = (text or "").split()
        bare = [w.strip(".,;:!?") for w in ws]
        lines = [line for line in (text or "").split("\n") if line.strip()]
        n, chars = max(1, len(ws)), max(1, len(text or ""))
        want = [1, 10 * sum(c in "#*$%&|<>!{}=;" for c in text or "") / chars, 5 * sum(w.isascii() and w.isupper() for w in ws) / n, sum(len(w.encode()) for w in ws) / n / 10, 3 * (1 - len(set(lines)) / max(1, len(lines))), 2 * len({w.lower() for w in bare}) / n, np.log1p(len(ws)) / 10, 10 * sum(c.isdigit() for c in text or "") / chars]
        assert x == pytest.approx(want if ws else [1] + [0] * 7)
        assert (len(places) > 0) == bool(ws) and len(places) <= 2 * len(set(ws))


def test_clashing_columns_and_accuracy(spark):
    """Columns named like results are replaced and others stay; of two separable classes nearly all rows are told apart, also by a plain fit on the same rows."""
    rows = [(i, f"{'fine clear' if i % 3 else 'bad spam'} text w{i % 50} " * 5, "en", f"s{i % 7}", 50, "old", 1.5) for i in range(400)] + [(None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int, kept string, more double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    out = cotraining.classify(docs, labels).collect()
    assert len(out) == 401 and {r["more"] for r in out} == {1.5, None}
    assert all(r["kept"] == (r["doc_id"] % 3 > 0) for r in out if r["doc_id"] is not None)
    assert cotraining.fit(docs, labels)["accuracy"] == 1.0


@pytest.mark.parametrize("rounds", [0, 1, 2, 3])
def test_exchange_does_no_harm(spark, rounds):
    """A view without signal teaches nothing: plain rows stay told apart after any number of rounds."""
    rows = [(i, f"{'fine clear' if i % 3 else 'bad spam'} text w{i % 50} " * 5, "en", f"s{i % 7}", 50) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    model = cotraining.fit(docs, labels, rounds=rounds)
    assert model["learned"][0] == [0, 0] and model["accuracy"] == 1.0
    assert all(r["kept"] == (r["doc_id"] % 3 > 0) for r in cotraining.score(docs, model).collect())


def test_sure_bounds():
    """Bounds need enough right rows; equal scores count together; a view without signal has none."""
    z = np.concatenate([np.linspace(-5, -1, 100), np.linspace(1, 5, 100)])
    good = (z > 0).astype(int)
    low, high = cotraining.sure_from(z, good)
    assert -1.5 < low < 1.5 and -1.5 < high < 1.5
    assert cotraining.sure_from(z[90:110], good[90:110]) == (-np.inf, np.inf)
    assert cotraining.sure_from(np.zeros(200), good) == (-np.inf, np.inf)
    assert cotraining.sure_from(np.random.default_rng(0).normal(size=200), good) == (-np.inf, np.inf)
    assert cotraining.sure_from(np.zeros(0), np.zeros(0)) == (-np.inf, np.inf)
