"""Byte-level BPE encoding and decoding.

Each match of the pre-tokenising pattern is a word. Each distinct word of some
texts is folded once: from single bytes, the adjacent pair of the lowest rank
(leftmost on ties) merges until no pair has a rank. Words of one length are
folded together, one merge of each at a time. Decoding concatenates the binary
pieces. Encoding runs task by task without a shuffle: a worker reads the rank
map once, and a bounded cache keeps words that come again.

Null text counts as empty: no tokens. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import Cache

#: fewer words of one length than FEW, or longer ones than LONG bytes, are folded one by one, others up to CELLS bytes at a time
FEW, LONG, CELLS = 32, 64, 1 << 21
#: texts are encoded together until they have so many words, and longer ones so many words at a time
SLICE = 200_000
NONE = np.iinfo(np.int64).max
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Fold the ranked merges over one word; a heap keeps long words at n log n."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        push(i)
    while heap:
        r, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """Ranks of adjacent pairs of ids; NONE where their bytes together have none."""

    def __init__(self, ranks: dict[bytes, int]):
        self.base = 1 + max(ranks.values(), default=0)
        found = {ranks[w[:i]] * self.base + ranks[w[i:]]: r for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks}
        keys = np.array(sorted(found), np.int64)
        self.keys = np.append(keys, NONE)
        self.ranks = np.append(np.array([found[k] for k in keys.tolist()], np.int64), NONE)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.base + right
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[at] == pair, self.ranks[at], NONE)


def merge_all(ids: np.ndarray, pairs: Pairs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fold words of one length, a row of single bytes' ids each: a round makes one merge in every word that has one left.

    Each item is the rows that have none left after a round, and their ids.
    """
    # rank[:, i] is that of ids i and i + 1; the last id has no pair
    rank = np.full(ids.shape, NONE)
    rank[:, :-1] = pairs(ids[:, :-1], ids[:, 1:])
    rows = np.arange(len(ids))
    while len(rows):
        at = rank.argmin(1)
        best = rank[np.arange(len(rows)), at]
        done = best == NONE
        yield rows[done], ids[done]
        ids, rank, rows, at, best = (x[~done] for x in (ids, rank, rows, at, best))
        n, k = ids.shape
        ids[np.arange(n), at] = best
        ids = ids[np.arange(k) != at[:, None] + 1].reshape(n, k - 1)
        rank = rank[np.arange(k) != at[:, None]].reshape(n, k - 1)
        left, right = np.flatnonzero(at > 0), np.flatnonzero(at < k - 2)
        rank[left, at[left] - 1] = pairs(ids[left, at[left] - 1], best[left])
        rank[right, at[right]] = pairs(best[right], ids[right, at[right] + 1])


class Codec:
    """encode(), encode_all() and decode() for one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.pieces = {v: k for k, v in self.ranks.items()}
        self.names = {v: str(v) for v in self.pieces}
        self.find = regex.compile(pattern).findall
        # ids are kept as bytes, which the garbage collector need not walk
        self.words = Cache(lambda w: np.array(merge(w.encode("utf-8", "surrogatepass"), self.ranks), np.int32).tobytes())
        self.whole = {w.decode() for w in self.ranks if w.decode(errors="ignore").encode() == w}
        singles = [self.ranks.get(bytes([i]), -1) for i in range(256)]
        self.single, self.pairs = (None, None) if min(singles) < 0 else (np.array(singles), Pairs(self.ranks))

    def learn(self, words: set[str]) -> None:
        """Fold many new words together into the cache; words left out are folded when met."""
        if self.pairs is None:
            return
        new = words.difference(self.words)
        if len(self.words) + len(new) > self.words.limit:
            self.words.clear()
            new = words
        fold = list(new.difference(self.whole))
        b = np.frombuffer("".join(fold).encode("utf-8", "surrogatepass"), np.uint8)
        chars = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
        first = chars[np.cumsum([0, *map(len, fold)])]
        size = np.diff(first)
        for n in range(1, LONG + 1):
            rows = np.flatnonzero(size == n)
            if len(rows) < FEW:
                continue
            for part in (rows[i : i + CELLS // n] for i in range(0, len(rows), CELLS // n)):
                for at, ids in merge_all(self.single[b[first[part][:, None] + np.arange(n)]], self.pairs):
                    packed, width = ids.astype(np.int32).tobytes(), 4 * ids.shape[1]
                    self.words.update(zip(map(fold.__getitem__, part[at].tolist()), (packed[i : i + width] for i in range(0, len(packed), width))))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """The ids of each text, some texts at a time."""
        found: list[list[str]] = []
        size = 0
        for text in texts:
            found.append(self.find(text or ""))
            size += len(found[-1])
            if size >= SLICE:
                yield from self._ids(found)
                found, size = [], 0
        yield from self._ids(found)

    def _ids(self, found: list[list[str]]) -> Iterator[list[int]]:
        self.learn(set().union(*(words[:SLICE] for words in found)))
        for words in found:
            packed = [b"".join(map(self.words.__getitem__, words[:SLICE]))]
            for i in range(SLICE, len(words), SLICE):
                self.learn(set(words[i : i + SLICE]))
                packed.append(b"".join(map(self.words.__getitem__, words[i : i + SLICE])))
            yield memoryview(b"".join(packed)).cast("i").tolist()

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=1)
def codec_of(path: str, pattern: str) -> Codec:
    """One codec for all tasks of a worker."""
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Digests of the ids and of the decoded bytes per document; with_ids adds the ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers as P

        codec = codec_of(path or P.path("byte_bpe_50k.tiktoken"), pattern or P.PATTERN)
        for b in batches:
            rows = []
            for doc_id, ids in zip(b["doc_id"], codec.encode_all(b["text"])):
                row = [doc_id, len(ids), hashlib.sha256(" ".join(map(codec.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()]
                rows.append(row + [ids] if with_ids else row)
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA + ", ids array<int>" * with_ids)
