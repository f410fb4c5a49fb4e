"""One query per corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, cascade, cotraining, fertility, fim, jaccard, matroska, neighbours, packing, periodic, pii, sharding, superkmers
from .common import table

#: bytes of a shard
SHARD = 8 << 20


def queries() -> dict:
    return {
        "op1_fertility": lambda s, d: fertility.fertility(table(s, d, "documents")),
        "op2_byte_bpe": lambda s, d: bpe.encode_documents(table(s, d, "documents")),
        "op3_jaccard_join": lambda s, d: jaccard.near_groups(table(s, d, "documents")),
        "op4_cotraining": lambda s, d: cotraining.classify(table(s, d, "documents"), table(s, d, "labels")).select("doc_id", "p_text", "p_meta", "score", "kept"),
        "op5_extendible_hashing": lambda s, d: sharding.shards(table(s, d, "documents"), SHARD),
        "op6_matroska": lambda s, d: matroska.media_column(table(s, d, "documents")),
        "op7_pseudonyms": lambda s, d: pii.pseudonymise(table(s, d, "documents").select("doc_id", "text")).select("doc_id", "n_found", "n_changed", "text"),
        "op8_superkmers": lambda s, d: superkmers.dedup(table(s, d, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256"),
        "op9_packing": lambda s, d: packing.pack(table(s, d, "documents")),
        "op10_url_cascade": lambda s, d: cascade.judge(table(s, d, "pages")),
        "op11_periodic_runs": lambda s, d: periodic.collapsed(table(s, d, "documents"), periodic.repeated_tail),
        "op12_cross_polytope": lambda s, d: neighbours.nearest(table(s, d, "embeddings"), F.col("vec_id") % 100 == 0),
        "op13_fill_in_middle": lambda s, d: fim.digests(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_extendible_hashing": sharding.oracle(SHARD), "op10_url_cascade": cascade.ORACLE}
