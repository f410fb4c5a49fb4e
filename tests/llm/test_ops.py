"""Corpus operators against brute force, round trips and edge cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fieldloom.llm import bpe, cascade, cotraining, fertility, jaccard, matroska, packing, pii, sharding, superkmers
from fieldloom.llm.common import words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, starts string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    real = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    common = " ".join(f"pass{i}" for i in range(40))
    texts = [None, "", " \n\t ", "one", "a a a a a a a a a a a a a a a a a a a a a a a a a", "x y z", "x y z", f"{common} tail one", f"head two {common}", "naïve Ünïcödé 漢字 🙂 \u00a0 don't  <|endoftext|> 12345", "w" * 70_000, f"{common} {common}", "Σ ΑΣ é e\u0301"]
    made = [(10_000 + i, t, None, None, None) for i, t in enumerate(texts)]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in real] + made
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fertility(docs, rows, empty):
    out = {r["doc_id"]: r for r in fertility.fertility(docs).collect()}
    assert out.keys() == rows.keys()
    for k, t in rows.items():
        ws = words(t)
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        hit = {i + j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = out[k]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(ws), sum(map(len, ws)), len(hit), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(ws) < 50 or 100 * len(hit) > 50 * len(ws))
        assert not (r["base_failed"] and r["kept"])
    assert fertility.fertility(empty).count() == 0


def test_bpe(docs, rows, empty):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_documents(docs).collect():
        t = rows[r["doc_id"]] or ""
        ids = enc.encode_ordinary(t)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_documents(empty).count() == 0


def _components(rows):
    sets = {}
    for k, t in rows.items():
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)]
        sets[k] = {tuple(ws[i : i + 4]) for i in range(len(ws) - 3)} if len(ws) >= 4 else {tuple(ws)} if ws else set()
    top = {k: k for k in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {k: (len(sets[k]), find(k)) for k in rows}


def test_jaccard(spark, docs, rows, empty):
    assert {r[0]: (r[1], r[2]) for r in jaccard.near_groups(docs).collect()} == _components(rows)
    assert jaccard.near_groups(empty).count() == 0


def test_jaccard_chains(spark):
    """Near copies in chains, of many sizes, at both sides of the threshold."""
    import random

    rnd, made = random.Random(5), {}
    for size in (5, 8, 20, 31, 64, 150, 400):
        base = [f"b{size}_{rnd.randrange(9000)}" for _ in range(size)]
        for j in range(9):
            made[len(made)] = " ".join(base)
            base = list(base)
            for _ in range(max(1, size // 90)):
                base[rnd.randrange(size)] = f"n{rnd.random()}"
            if j % 3 == 2:
                base.append(f"more{j}")
    got = jaccard.near_groups(spark.createDataFrame(list(made.items()), "doc_id bigint, text string"))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == _components(made)


@pytest.mark.parametrize("percent, k", [(85, 4), (80, 5)])
def test_group_keys_never_lose_a_link(spark, percent, k):
    """Linked sets share a key, whatever the order by frequency, and the bound of their counts is no reason to skip them."""
    import random

    import numpy as np

    rnd, made = random.Random(k), []
    for n in (1, 2, 5, 7, 13, 40, 111, 300):
        for _ in range(24):
            base = [f"v{rnd.randrange(50 if n % 2 else 9000)}" for _ in range(n + k - 1)]
            near = list(base)
            for _ in range(rnd.randrange(0, n // 40 + 2)):
                near[rnd.randrange(len(near))] = f"n{rnd.random()}"
            made += [base, near + [f"m{i}" for i in range(rnd.randrange(0, n // 12 + 1))]]
    df = spark.createDataFrame([(i, i, bytearray(" ".join(w).encode())) for i, w in enumerate(made)], "doc_id bigint, text_hash bigint, raw binary").repartition(3)
    keys = {r["doc_id"]: set(r["keys"]) for r in jaccard.sets(df, jaccard.cell_levels(df, k), percent, k).collect()}
    grams = [np.unique(np.array([hash(tuple(w[i : i + k])) for i in range(max(1, len(w) - k + 1))])) for w in made]
    linked = 0
    for a in range(0, len(made), 2):
        both = len(np.intersect1d(grams[a], grams[a + 1]))
        if 100 * both >= percent * (len(grams[a]) + len(grams[a + 1]) - both):
            same = set(grams[a]) == set(grams[a + 1])
            linked += not same
            # a set that a task has met again leaves its keys out: equal sets have one digest
            assert same or keys[a] & keys[a + 1] or not keys[a] or not keys[a + 1]
    assert linked > 20


def _opposite(n):
    """Two different words of n letters which polynomials modulo 2 ** 64 cannot tell apart from about 1,024 letters on."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_built_to_collide(spark, n):
    """They are no near copies, and a window that holds one does not repeat a window that holds the other."""
    one, two = _opposite(n)
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id bigint, text string")
    assert {r[0]: r[2] for r in jaccard.near_groups(docs).collect()} == {1: 1, 2: 2}
    tail = " ".join(f"t{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} {tail}")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_removed"] for r in superkmers.dedup(docs).collect()} == {1: 0, 2: 0, 3: 20}


def test_word_hashes():
    """No two of many words share a hash, whatever their lengths and places; A-Z fold where asked."""
    import numpy as np

    from fieldloom.llm.common import bytes_hashes

    words_ = [str(i).encode() for i in range(20_000)] + [b"a" * i for i in range(1, 600)] + [b"b" * 8 + bytes([i]) for i in range(65, 91)] + [x.encode() for n in (8, 16, 32, 64, 1024) for x in _opposite(n)]
    ends = np.cumsum([len(w) for w in words_])
    starts = ends - [len(w) for w in words_]
    b = np.frombuffer(b"".join(words_), np.uint8)
    h = bytes_hashes(b, starts, ends)
    assert len(np.unique(h)) == len(set(words_))
    alone = [bytes_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words_[::97]]
    assert alone == h[::97].tolist()
    upper = np.frombuffer(b"ABCdefghijKLM abcdefghijklm", np.uint8)
    x, y = bytes_hashes(upper, np.array([0, 14]), np.array([13, 27]), fold=True)
    assert x == y


def test_deceiving_hashes_are_settled_by_words():
    """Where windows share a hash, the words decide."""
    import numpy as np
    import pyarrow as pa

    packed = pa.array([b"a b c", b"a b d", b"a b c"], pa.binary())
    row, opens, closes = np.array([0, 1, 2]), np.array([0, 0, 0]), np.array([5, 5, 5])
    first, lead = np.array([True, False, False]), np.array([0, 0, 0])
    assert not superkmers.same_words(packed, row, opens, closes, first, lead)
    assert superkmers.same_words(packed, row, opens, closes, np.array([True, True, False]), np.array([0, 1, 0]))
    assert superkmers.first_windows(packed, np.zeros(3, int), row, opens, closes).tolist() == [True, True, False]
    assert superkmers.first_windows(packed, np.array([0, 0, 1]), row, opens, closes).tolist() == [True, True, True]


def test_components_grow_link_by_link(spark):
    """Chains, stars and random links, given in parts, equal a plain union of sets."""
    import random

    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(500, 540)] + [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(260)] + [(7, 1000), (5, 5)]
    rnd.shuffle(links)
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    comp = None
    for part in (links[:150], links[150:160], links[160:]):
        for a, b in part:
            x, y = sorted((find(a), find(b)))
            top[y] = x
        comp = jaccard.merged(comp, spark.createDataFrame(part, "a bigint, b bigint"))
        got = {r["node"]: r["comp"] for r in comp.collect()}
        assert got == {x: find(x) for x in got} and set(top) - set(got) <= {5}


def test_best_pairs_are_bounded(monkeypatch):
    """4,096 near copies in one key: few pairs are held at a time, each row keeps its best ones and the group is known to have more."""
    import numpy as np

    rnd = np.random.default_rng(1)
    m = 700
    counts = np.tile(rnd.integers(0, 4, jaccard.GROUPS), (m, 1)).astype(np.int32)
    counts[np.arange(m), rnd.integers(0, jaccard.GROUPS, m)] += 1
    n = counts.sum(1)
    group, leaf, node = np.zeros(m, np.int64), np.zeros(m, np.int64), np.arange(m)
    got = {}
    for limit in (10_000, 10**9):
        monkeypatch.setattr(jaccard, "PAIRS", limit)
        best = jaccard.Best(group, node, 2)
        sizes = []
        real = best.add
        best.add = lambda *a: (real(*a), sizes.append(best.size))
        jaccard.group_pairs(group, leaf, counts, n, node, 85, best)
        i, j, more = best.pairs()
        got[limit] = sorted(zip(i.tolist(), j.tolist(), more.tolist()))
        assert more.all() and set(i.tolist()) | set(j.tolist()) == set(range(m))
        if limit == 10_000:
            assert max(sizes) < 25_000
    assert got[10_000] == got[10**9]


def test_cotraining(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = cotraining.fit(real, labels)
    assert model["accuracy"] > 0.9
    out = cotraining.score(docs, model)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()
    assert cotraining.classify(docs, labels.limit(0)).where("not kept").count() == 0
    assert cotraining.score(empty, model).count() == 0


@pytest.mark.parametrize("limit", [2_000, 100_000, 1 << 30])
def test_sharding(docs, rows, empty, limit):
    out = sharding.shards(docs, limit).collect()
    assert {r["doc_id"] for r in out} == set(rows) and len(out) == len(rows)
    size = defaultdict(int)
    for r in out:
        size[r["shard"], r["part"]] += r["n_bytes"]
    for r in out:
        assert size[r["shard"], r["part"]] <= limit or r["over_limit"]
    names = sorted({r["shard"] for r in out})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert sharding.shards(empty, limit).count() == 0


def test_sharding_one_key(spark):
    same = spark.createDataFrame([(7, "x" * 100)] * 500, "doc_id bigint, text string")
    out = sharding.shards(same, 1000, step=4).collect()
    size = Counter()
    for r in out:
        size[r["part"]] += r["n_bytes"]
    assert len(out) == 500 and max(size.values()) <= 1000


def test_matroska(docs, rows, empty):
    for r in matroska.media_column(docs).collect():
        raw = (rows[r["doc_id"]] or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert matroska.media_column(empty).count() == 0


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_matroska_lacing(lacing):
    data = bytes(i * 7 % 256 for i in range(192 * 1500 + 50))
    found, cues, scale = matroska.parse(file := matroska.write(data, lacing))
    assert b"".join(file[at : at + n] for _, _, at, n, _ in found) == data
    assert all(file[p : p + 4] == b"\x1f\x43\xb6\x75" for _, _, p in cues) and cues
    with pytest.raises(ValueError):
        matroska.parse(file[:-3])


def test_matroska_packets(spark):
    rows = [(1, matroska.write(b"a" * 400)), (2, b"junk"), (3, None)]
    out = matroska.packets(spark.createDataFrame(rows, "doc_id bigint, media binary")).collect()
    assert {r["doc_id"] for r in out} == {1} and [r["size"] for r in out] != []


def _luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark, docs, rows, empty):
    import datetime

    fixed = "call +49 170 1234567 on 2021-02-28 from 10.20.30.40, pay 4111 1111 1111 1111 or 4111-1111-1111-1111, not 4111111111111112, mail a.b@x.example.com; 2021-02-30 999.1.1.1"
    got = pii.pseudonymise(spark.createDataFrame([(1, fixed, "k"), (2, fixed, "k"), (3, None, "k"), (4, "", "k")], "doc_id bigint, text string, extra string")).collect()
    a, b = got[0]["text"], got[1]["text"]
    assert a == b and got[2]["text"] is None and got[3]["text"] == ""
    for gone in ("1234567", "2021-02-28", "10.20.30.40", "4111 1111", "a.b@"):
        assert gone not in a
    for same in ("4111111111111112", "2021-02-30", "999.1.1.1", "@x.example.com"):
        assert same in a
    spaced = re.search(r"pay (\d{4} \d{4} \d{4} \d{4}) or (\d{4}-\d{4}-\d{4}-\d{4}),", a)
    assert spaced[1].replace(" ", "") == spaced[2].replace("-", "") and _luhn(spaced[2].replace("-", ""))
    datetime.date.fromisoformat(re.search(r"on (\S+) from", a)[1])
    out = pii.pseudonymise(docs)
    for r in out.collect():
        t = rows[r["doc_id"]]
        assert re.sub(pii.PATTERN, "#", r["text"] or "") == re.sub(pii.PATTERN, "#", t or "")
    assert pii.pseudonymise(empty).count() == 0


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert {r[0] for r in d.select(pii.digits_permuted(F.col("d"), "k", "t")).collect()} == {f"{i:03}" for i in range(1000)}


def _dedup(rows):
    seen, out = {}, {}
    for k in sorted(rows):
        ws = words(rows[k])
        gone = set()
        for i in range(len(ws) - 19):
            if seen.setdefault(tuple(ws[i : i + 20]), (k, i)) != (k, i):
                gone.update(range(i, i + 20))
        line = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out[k] = (len(ws), len(gone), hashlib.sha256(line.encode()).hexdigest())
    return out


@pytest.mark.parametrize("most", [superkmers.MOST, 40])
def test_superkmers(spark, docs, rows, empty, most):
    extra = {20_000 + i: rows[min(rows)] for i in range(150)}
    more = spark.createDataFrame([(k, t, "", "", 1, "", "", "") for k, t in extra.items()], SCHEMA)
    got = superkmers.dedup(docs.union(more), most=most).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == _dedup(rows | extra)
    assert superkmers.dedup(empty).count() == 0


def test_superkmers_of_texts_that_repeat_themselves(spark):
    """Their long super-k-mers come in pieces; the result is that of brute force, also with minimisers in parts."""
    import numpy as np

    line = " ".join(f"l{i}" for i in range(23))
    texts = {1: "a " * 300, 2: "b c " * 150, 3: f"{line} " * 12, 4: "c b " * 90 + "a " * 70, 5: f"x {line} " * 3 + "b c " * 40, 6: "d " * 19}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for most in (superkmers.MOST, 3):
        got = superkmers.dedup(docs, most=most).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == _dedup(texts)
    row, start, many, _, twice = superkmers.runs(np.array([7] * 300 + [9] * 45, np.uint64), np.array([0, 300, 345]), 20, 6)
    assert many.max() <= superkmers.LONGEST and twice.all()
    assert [many[row == r].sum() for r in (0, 1)] == [281, 26]
    assert all((start[row == r] == np.append(0, np.cumsum(many[row == r])[:-1])).all() for r in (0, 1))


def test_superkmers_hold_few_bytes(spark):
    """Batches that go to Python are small unless the session says otherwise, and so are the buckets that a task settles at once."""
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda: [r["m"] for r in spark.range(0, 9000, 1, 1).selectExpr("repeat('x', 1000) t").mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["m"]) for b in it), "m long").collect()]
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    spark.conf.unset(key)
    try:
        superkmers.dedup(docs)
        assert max(sizes()) < 5 << 20
        spark.conf.set(key, "64m")
        superkmers.dedup(docs)
        assert spark.conf.get(key) == "64m"
    finally:
        spark.conf.unset(key)
    long = " ".join("w" * 15_000 for _ in range(20)).encode()
    batches = [pa.RecordBatch.from_pydict({"mini": [i], "part": [-1], "doc_id": [i], "tag": [0], "start": [0], "packed": [long]}) for i in range(60)]
    batches = [b.set_column(5, "packed", b.column("packed").cast(pa.binary())) for b in batches]
    assert len(list(superkmers._bucket(20)(iter(batches)))) >= 4


def test_sharding_of_one_id(spark, tmp_path):
    """Many rows of one id: no part exceeds the limit but single rows that do, and every row is written once."""
    sizes = [400, 900, 1000, 501, 500, 1, 1300] * 300
    docs = spark.createDataFrame([(7, f"{i:05}".ljust(n, "x")[:n], "clash") for i, n in enumerate(sizes)] + [(8, "y" * 30, None), (None, None, None)], "doc_id bigint, text string, part string").repartition(6)
    parts = defaultdict(list)
    for r in sharding.shards(docs, limit=1000).collect():
        parts[r["shard"], r["part"]].append((r["n_bytes"], r["over_limit"]))
    assert all(sum(n for n, _ in p) <= 1000 or len(p) == 1 and p[0][1] for p in parts.values())
    assert len(parts) < 2 * sum(sizes) / 1000
    sharding.write_shards(docs, f"{tmp_path}/out", limit=1000)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(r["text"] for r in out.select("text").collect()) == Counter(r["text"] for r in docs.collect())


def test_pseudonyms_replace_clashing_columns(spark):
    got = pii.pseudonymise(spark.createDataFrame([(1, "on 2021-02-28", "a", "b"), (2, None, "a", "b")], "doc_id bigint, text string, n_found string, n_changed string")).collect()
    assert sorted((r["doc_id"], r["n_found"], r["n_changed"]) for r in got) == [(1, 1, 1), (2, 0, 0)]


def test_superkmers_of_repeated_ids(spark):
    """Rows of one id with other texts are documents of their own, equal rows are one; null ids come first; columns named like results are replaced."""
    line = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, line("a"), "x"), (2, line("b"), "y"), (2, line("a"), "z"), (3, line("c"), "u"), (3, line("c"), "v"), (None, line("d"), "w"), (4, line("d"), None), (5, None, None)]
    got = superkmers.dedup(spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, kept string, n_words string, more int")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [(0, 60, 0), (1, 60, 0), (2, 60, 0), (2, 60, 60), (3, 60, 0), (3, 60, 0), (4, 60, 60), (5, 0, 0)]
    assert {r["more"] for r in got} == {1} and next(r["kept"] for r in got if r["doc_id"] == 3) == line("c")


def test_packing_words(spark):
    """Words of any characters are encoded as within a whole text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["a\x01b \x01 it's DON'T 'sx ''s e \u0301x e\u0301 \u00a0q\u3000r 12a! \x85 \x1c", " ".join(f"{chr(c)} a{chr(c)}B{chr(c)}{chr(c)}" for c in range(1, 700)), " ".join(f"w{i}" for i in range(30_000))]
    got = {r["doc_id"]: r["ids"] for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), size=1 << 20, with_ids=True).collect()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    seqs = defaultdict(list)
    for r in packing.pack(docs, with_ids=True).collect():
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in rows.items():
        want = tok.encode(t or "", add_special_tokens=False).ids + [2]
        ps = sorted(pieces[k], key=lambda r: r["start"])
        assert [x for p in ps for x in p["ids"]] == want
        assert all(p["doc_tokens"] == len(want) for p in ps)
    for s, spans in seqs.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == 4096 or s == max(seqs)
    assert packing.pack(empty).count() == 0


def test_cascade(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1?q#f", "https://example.net/de/", "x://example.com/de/9", "x://example.com/de", "ftp://foo.org/fr/", "http://net/", "http://net", "http://foonet/", "http://b.net?x/", "http://a.org/en/http://net/", "http://example.org/\nfr/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(3, urls[3])], "page_id bigint, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in cascade.judge(pages).collect()}
    want = {3: ("example.net/en/", "allow"), 4: ("net/", "block"), 5: ("example.com/de/", "block"), 7: ("org/fr/", "allow"), 8: ("net/", "block")}
    assert got == {i: want.get(i, (None, "allow")) for i in range(len(urls))}
    assert cascade.judge(pages.limit(0)).count() == 0


def test_cascade_levels(spark):
    from pyspark.sql import functions as F

    universe = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 30_000, 97)]
    levels = cascade.build(universe, listed)
    assert len(levels) > 1
    assert {r[0] for r in universe.where(cascade.listed_in(F.col("key"), levels)).collect()} == set(listed)
