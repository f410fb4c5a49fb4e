"""Quality rules by tokeniser fertility.

Every word of a text is encoded with a public vocabulary (sentencepiece with
byte fallback). Three measures per document follow: characters per token,
share of byte-fallback tokens and token entropy in bits. A document is kept
when the base rules pass and each measure lies in the band of its language.

Null or empty text: no words, base_failed true. A null or unknown language
takes the band "". Repeated rows give repeated results; further columns of the
input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame

from .common import Cache, words

#: (least characters a token, most characters a token, most byte-fallback share, least entropy in bits)
BANDS = {
    "en": (1.85, 8.0, 0.05, 5.2),
    "fr": (1.60, 8.0, 0.05, 5.2),
    "de": (1.75, 8.0, 0.05, 5.2),
    "es": (1.70, 8.0, 0.05, 5.2),
    "": (1.0, 12.0, 0.60, 3.0),
}
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, kept boolean"
)
SYMBOLS = re.compile(r"[#*$%&|<>]")


def base_counts(text: str | None) -> tuple[int, int, int, int, int, list[str]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words."""
    ws = words(text)
    n = len(ws)
    seen: set[str] = set()
    dup_lines = 0
    for line in (text or "").split("\n"):
        if line in seen:
            dup_lines += 1
        elif words(line):
            seen.add(line)
    grams = list(zip(ws, ws[1:], ws[2:]))
    count = Counter(grams)
    repeat, covered = 0, 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            repeat += i + 3 - max(covered, i)
            covered = i + 3
    return n, sum(map(len, ws)), len(SYMBOLS.findall(text or "")), dup_lines, repeat, ws


def fertility(docs: DataFrame, model: str | None = None, bands: dict | None = None) -> DataFrame:
    """Measures and verdict per row of docs(doc_id, text, lang)."""
    bands = bands or BANDS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
        is_byte = [sp.is_byte(i) for i in range(sp.get_piece_size())]

        def piece_ids(word: str):
            ids = tuple(sp.encode(word))
            return ids, sum(is_byte[i] for i in ids)

        cache = Cache(piece_ids)
        for b in batches:
            out = []
            for doc_id, text, lang in zip(b["doc_id"], b["text"], b["lang"]):
                n, chars, symbols, dups, repeat, ws = base_counts(text)
                ids: Counter = Counter()
                fallback = total = 0
                for w, k in Counter(ws).items():
                    pieces, nb = cache[w]
                    fallback += nb * k
                    total += len(pieces) * k
                    for p in pieces:
                        ids[p] += k
                cpt = chars / total if total else 0.0
                share = fallback / total if total else 0.0
                entropy = log2(total) - sum(c * log2(c) for c in ids.values()) / total if total else 0.0
                failed = n < 50 or 100 * repeat > 50 * n
                lo, hi, most, least = bands.get(lang) or bands[""]
                kept = not failed and lo <= cpt <= hi and share <= most and entropy >= least
                out.append((doc_id, n, chars, symbols, dups, repeat, failed, total, cpt, share, entropy, kept))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text", "lang").mapInPandas(run, SCHEMA)
