"""Byte-level BPE of many words at once against the plain fold and tiktoken."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from fieldloom.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def words():
    draw = random.Random(5)
    parts = ["a", "e", "n", "th", "er", "in", "ö", "é", "ß", "漢", "🙂", "я", "Q", "x"]
    return sorted({"".join(draw.choices(parts, k=draw.choice([1, 2, 3, 5, 8, 12, 30, 90]))) for _ in range(6000)})


def _vocabulary(path, ranks):
    path.write_bytes(b"".join(base64.b64encode(w) + b" %d\n" % r for w, r in ranks.items()))
    return str(path)


def test_new_words_are_folded_together(words, monkeypatch):
    short = [w for w in words if len(w.encode()) <= 24]
    alone, plain = [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda w, ranks: alone.append(w) or plain(w, ranks))
    codec = bpe.Codec(PATH, P.PATTERN)
    ids = codec.encode(" ".join(short))
    assert codec.decode(ids) == " ".join(short).encode()
    assert len(short) > 2000 and len(alone) < len(short) / 5


def test_equals_tiktoken_over_slices_and_full_caches(words, monkeypatch):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    texts = [" ".join(words[i : i + 97]) for i in range(0, len(words), 97)] + [None, "", "  \n", "a" * 70, "w" * 5000, words[0]]
    codec = bpe.Codec(PATH, P.PATTERN)
    for size, limit, cells in ((200_000, 400_000, 1 << 21), (1500, 400_000, 1 << 21), (1500, 700, 200), (40, 50, 1 << 21), (1, 1, 1 << 21)):
        monkeypatch.setattr(bpe, "SLICE", size)
        monkeypatch.setattr(bpe, "CELLS", cells)
        codec.words.clear()
        codec.words.limit = limit
        assert list(codec.encode_all(texts)) == [enc.encode_ordinary(t or "") for t in texts]


def test_any_vocabulary(tmp_path):
    """Words with a rank that no merge reaches, pieces with several splits, ties, ranks out of order of length."""
    draw = random.Random(7)
    for turn in range(12):
        longer = sorted({"".join(draw.choices("abc", k=draw.randint(2, 6))).encode() for _ in range(draw.choice([5, 40, 150]))})
        draw.shuffle(longer)
        ranks = {w: r for r, w in enumerate([*(bytes([i]) for i in range(256)), *longer])}
        codec = bpe.Codec(_vocabulary(tmp_path / f"v{turn}", ranks), P.PATTERN)
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        text = " ".join("".join(draw.choices("abc", weights=[6, 2, 1], k=draw.randint(1, 14))) for _ in range(3000))
        assert codec.encode(text) == enc.encode_ordinary(text)


def test_vocabulary_without_all_bytes(tmp_path):
    ranks = {b"a": 0, b"b": 1, b" ": 2, b"ab": 3, b" a": 4, "é".encode(): 5, "aé".encode(): 6}
    codec = bpe.Codec(_vocabulary(tmp_path / "v", ranks), P.PATTERN)
    assert codec.encode("abab aé") == [3, 3, 4, 5]
    assert codec.decode(codec.encode("abab aé")) == "abab aé".encode()
