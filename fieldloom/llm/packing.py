"""Concatenate and cut.

Pass 1 tokenises every document once; the ids stay in their partition as
packed 16-bit numbers in a reliable checkpoint. The totals of the partitions
(one row a partition) give each partition its global offset. Pass 2 walks the
partitions in place: a document's pieces are the cuts of its token range at
multiples of the sequence length; every sequence but the last is full.

Null text is an empty document: its only token is the end token. Repeated rows
are packed once each. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KNOWN = 600_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


#: The pattern of a vocabulary file whose short words WordIds cuts itself, and the same for lower-case Latin-1 characters.
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
LATIN = re.compile(r"[!-~\xa1-\xff]+")


class WordIds(dict):
    """The ids of words as little-endian unsigned 16-bit numbers, kept as they are asked for; emptied when full, so results never depend on it.

    White space always separates tokens of the vocabulary and is dropped, so words can be
    encoded one by one. Words of Latin-1 characters are cut by the file's own pattern in
    lower case and their pieces kept too, since few pieces make many words.
    """

    def __init__(self, tok):
        super().__init__()
        self.tok, self.pieces = tok, {}
        form = json.loads(tok.to_str())
        steps = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])], [x.get("pattern", {}).get("Regex") for x in (form["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.added = [x["content"] for x in form["added_tokens"]]
        self.known_form = steps == (["NFC", "Replace", "Lowercase"], [FILE_PATTERN, None]) and not any(x.isalpha() for x in self.added)
        self.shown = {b: self._byte(b) for b in range(128, 256)}
        self.pair = [n.to_bytes(2, "little") for n in range(1 << 16)]

    @staticmethod
    def _byte(b: int) -> str:
        """The character that stands for a byte from 128 on: itself if printable in Latin-1, else one from 256 on in order."""
        hidden = [*range(0, 33), *range(127, 161), 173]
        return chr(256 + hidden.index(b)) if b in hidden else chr(b)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
            self.pieces.clear()
        text = word.decode("utf-8", "replace")
        if not self.known_form:
            out = self.whole(text)
        elif word.isalpha():
            out = self.piece(text.lower())
        elif LATIN.fullmatch(text) and not any(x in text for x in self.added):
            out = b"".join(map(self.piece, PIECE.findall(text.lower())))
        else:
            out = self.whole(text)
        if len(word) <= 256:
            self[word] = out
        return out

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.pair.__getitem__, self.tok.encode(text, add_special_tokens=False).ids))

    def piece(self, piece: str) -> bytes:
        out = self.pieces.get(piece)
        if out is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
            out = self.pieces[piece] = b"".join([self.pair[t.id] for t in self.tok.model.tokenize(shown)])
        return out


def tokens(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """(part, doc_id, n, ids): ids as little-endian unsigned 16-bit numbers, with the end token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        from tokenizers import Tokenizer

        known = WordIds(Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json")))
        end = np.array([end_id], "<u2").tobytes()
        part = TaskContext.get().partitionId()
        for b in batches:
            # bytes split at the same white space as words()
            ids = [b"".join(map(known.__getitem__, (t or b"").split())) + end for t in b["raw"]]
            yield pd.DataFrame({"part": part, "doc_id": b["doc_id"].astype("Int64"), "n": [len(x) // 2 for x in ids], "ids": ids})

    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInPandas(run, "part int, doc_id bigint, n bigint, ids binary")


def pack(docs: DataFrame, size: int = 4096, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of `size` tokens."""
    kept = cut(tokens(docs, path))
    offsets, at = {}, 0
    for part, n in sorted(kept.groupBy("part").agg(F.sum("n")).collect()):
        offsets[part] = at
        at += n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for b in batches:
            out = []
            for part, doc_id, n, raw in zip(b["part"], b["doc_id"], b["n"], b["ids"]):
                at = offsets[part] if at is None else at
                ids, start = np.frombuffer(raw, "<u2").astype("<u4"), 0
                while start < n:
                    length = min(n - start, size - at % size)
                    piece = ids[start : start + length]
                    row = (doc_id, start, length, zlib.crc32(piece.tobytes()), n, at // size, at % size)
                    out.append((*row, piece.tolist()) if with_ids else row)
                    start += length
                    at += length
            yield pd.DataFrame(out, columns=[c.split()[0] for c in (PIECES + ", ids x" * with_ids).split(", ")]).astype({"doc_id": "Int64"})

    return kept.mapInPandas(run, PIECES + ", ids array<int>" * with_ids)
