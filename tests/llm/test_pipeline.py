"""Stages of the corpus pipeline."""

import corpus_pipeline
from fieldloom.llm.common import words


def _similarity(x, y, k):
    a, b = ({tuple(words(t)[i : i + k]) for i in range(len(words(t)) - k + 1)} for t in (x, y))
    return len(a & b) / len(a | b)


def test_near_duplicates_between_the_thresholds(spark):
    """Pairs of 5-word similarity >= 0.8 lose a copy even where the 4-word similarity is below 0.85; others stay."""
    made, gone = {}, set()
    for pair, (size, changed) in enumerate([(100, 2), (230, 5), (415, 9), (600, 13), (100, 3), (400, 11)]):
        base = [f"p{pair}w{i}" for i in range(size)]
        near = list(base)
        for j in range(changed):
            near[(j + 1) * size // (changed + 1)] = f"p{pair}new{j}"
        made[2 * pair], made[2 * pair + 1] = " ".join(base), " ".join(near)
        if _similarity(made[2 * pair], made[2 * pair + 1], 5) >= 0.8:
            assert _similarity(made[2 * pair], made[2 * pair + 1], 4) < 0.85
            gone.add(2 * pair + 1)
    assert len(gone) == 4
    docs = spark.createDataFrame(list(made.items()), "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == made.keys() - gone


def test_near_duplicates_of_repeated_ids(spark):
    """Rows are told apart by id and text: no text vanishes because another one with its id goes."""
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(1, x), (2, x), (2, y), (3, f"{y} more"), (4, y), (4, y), (None, x), (None, x), (5, None), (5, None), (6, " "), (7, f"{x} tail"), (7, f"{x} tail")]
    docs = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], "doc_id bigint, text string, nth int, leader string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, x), (2, y), (None, x), (None, x), (5, None), (5, None), (6, " ")], key=repr)
    # the one that stays comes once, though its row is repeated
    again = spark.createDataFrame([(1, x, "a"), (1, x, "a"), (2, x, "b"), (9, y, "c")], "doc_id bigint, text string, __own string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, again, "").collect()) == [1, 9]
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


def test_stages_keep_clashing_columns(spark):
    """Input columns named like an operator's results come back as they were, nulls, ties and empty texts pass, empty tables give none."""
    more = {"kept": "k", "score": "s", "p_text": "p", "p_meta": "m", "n_words": "w", "n_removed": "r", "kept_sha256": "h", "n_found": "f", "n_changed": "c"}
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{passage} card 4111 1111 1111 1111"), (2, f"{passage} other"), (2, f"{passage} other"), (3, None), (4, ""), (None, passage)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in more)
    docs = spark.createDataFrame([(i, t, None, None, None, *more.values()) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(r[c] == v for r in kept for c, v in more.items()), name
        assert stage(spark, docs.where("false"), SMALL).count() == 0, name
    assert corpus_pipeline.pack(spark, docs.where("false"), SMALL).count() == 0


SMALL = "/root/testdata/sf0.001"


def test_whole_pipeline(spark):
    """Each stage of one run over the smallest tables, judged on the rows that the stage before wrote."""
    import hashlib
    import zlib
    from pathlib import Path

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from fieldloom.llm.common import checkpoint_dir

    from .test_ops import SF, _dedup

    checkpoint_dir(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = set(folder.glob("pipeline-*"))
    packed = corpus_pipeline.run(spark, SF).collect()
    (made,) = set(folder.glob("pipeline-*")) - before
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [spark.read.parquet(str(made / str(k))) for k in range(4)]
    assert all(s.columns == whole.columns for s in stages)
    docs = {r["doc_id"]: r["text"] for r in whole.collect()}
    good, single, cut, plain = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages)

    # clean documents stay as they are, those of low quality go (few labels here: a bound on both together)
    judged = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(docs[k] == t for k, t in good.items())
    of = lambda quality: [k in good for k, r in judged.items() if r["quality"] == quality and not r["toxic"] and k in docs]
    assert np.mean(of(1)) > 0.95 and np.mean(of(1) + [not kept for kept in of(0)]) > 0.9

    # one document of each group of similar ones, that of the least id
    def shingles(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    ids, sets = sorted(good), {k: shingles(t) for k, t in good.items()}
    group = {k: k for k in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert single == {k: good[k] for k in ids if group[k] == k}

    # repeated passages
    digest = lambda t: hashlib.sha256(" ".join(words(t)).encode()).hexdigest()
    assert {k: digest(t) for k, t in cut.items()} == {k: d for k, (_, _, d) in _dedup(single).items()}

    # personal data: same documents, other texts stay, lengths are of the new text
    assert plain.keys() == cut.keys()
    assert all(plain[k] == t for k, t in cut.items() if not any(c.isdigit() or c == "@" for c in t or ""))
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].where("text is not null").collect())

    # every token lies in one piece
    tok, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == plain.keys()
    for k, t in plain.items():
        tokens = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        ps = sorted(pieces[k], key=lambda r: r["start"])
        assert sum(p["length"] for p in ps) == len(tokens)
        assert all(zlib.crc32(tokens[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in ps)
