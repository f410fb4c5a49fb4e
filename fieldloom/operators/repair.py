"""Repair of misread text: codes whose digits were read as letters, and words one syllable away from a known one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts

# Words of survey forms and of the species they count; only those of three syllables or more are repaired.
TERMS = """
조사지역 조사시간 조사자 개체군 성장단계 단계별 개체수 가락지 위치추적기 번식준비 둥지합계 동소종 특이사항
조사사진 현장사진 번식지 관찰개체수 부착개체수
저어새 노랑부리저어새 노랑부리백로 중대백로 중백로 쇠백로 대백로 흑로 황로 왜가리 해오라기 검은댕기해오라기
괭이갈매기 재갈매기 한국재갈매기 붉은부리갈매기 검은머리갈매기 쇠제비갈매기 제비갈매기 검은머리물떼새
가마우지 민물가마우지 쇠가마우지 흰뺨검둥오리 청둥오리 물수리 뿔쇠오리 바다제비 알락꼬리마도요 마도요
흰물떼새 꼬마물떼새 개개비 섬개개비 흑비둘기 원앙 매
""".split()
PAIRS = [("포관", "포란")]
CODE = r"(?<![A-Za-z0-9])(?:[A-Z]\p{Nd}{2}|\p{Nd}{2}[A-Z])(?![A-Za-z0-9])"
MISREAD = r"(?<![A-Za-z0-9])(?:[A-Z][0-9OoGIlB]{2}|[0-9OoIl]{2}[A-Z])(?![A-Za-z0-9])"
LETTERS = ("OoGIlB", "006118")
# The first Hangul syllable and how many syllables share an initial, or an initial and a vowel.
FIRST, BY_INITIAL, BY_VOWEL = 0xAC00, 588, 28
HANGUL = "[가-힣]+"


def fixed_codes(text: Column) -> Column:
    """Letters that stand for digits in codes of a letter and two digits, or two digits and a letter; only where two codes or more are read well."""
    found, between = F.regexp_extract_all(text, F.lit(MISREAD), F.lit(0)), F.split(text, MISREAD)
    digits = lambda c: F.translate(c, *LETTERS)
    fixed = F.transform(found, lambda m: F.when(m.rlike("^[A-Z][0-9OoGIlB]{2}$"), F.concat(F.substring(m, 1, 1), digits(F.substring(m, 2, 2)))).otherwise(F.concat(digits(F.substring(m, 1, 2)), F.substring(m, 3, 1))))
    whole = F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(fixed, i), F.lit("")))), "")
    return F.when(F.size(F.regexp_extract_all(text, F.lit(CODE), F.lit(0))) >= 2, whole).otherwise(text)


def label_words(labels: DataFrame) -> DataFrame:
    """(word): the Hangul words of labels(label) with two syllables or more."""
    return labels.select(F.explode(F.regexp_extract_all("label", F.lit(HANGUL), F.lit(0))).alias("word")).where("length(word) >= 2").distinct()


def differing_parts(a: Column, b: Column) -> tuple[Column, Column]:
    """How many of initial, vowel and final differ between two syllables, and whether the finals are equal."""
    code = lambda c: F.ascii(c) - FIRST
    initial, vowel, final = (lambda c: F.floor(code(c) / BY_INITIAL)), (lambda c: F.floor(code(c) / BY_VOWEL) % (BY_INITIAL // BY_VOWEL)), (lambda c: code(c) % BY_VOWEL)
    return sum(((part(a) != part(b)).cast("int") for part in (initial, vowel, final)), F.lit(0)), final(a) == final(b)


def gapped(word: Column) -> Column:
    """The word with each of its syllables left out in turn: (gap, syllable)."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.struct(F.concat(F.substring(word, F.lit(1), i - 1), F.lit("_"), F.substring(word, i + 1, F.length(word))).alias("gap"), F.substring(word, i, F.lit(1)).alias("syllable")))


def repaired_words(spans: DataFrame, labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(span, fixed) of the distinct spans(span) of Hangul that are one misread syllable away from a known word; labels(word), terms(word).

    A span of three syllables or more meets labels and terms of its length that differ in one
    syllable of similar shape (one part differs, or two and not the final); one of two syllables meets
    labels only, with one part. With one such word it is that word; else its beginning without the last
    syllables is tried in the same way, down to three, until a beginning is known itself or has one
    word. Words meet by equality with one syllable left out.
    """
    long = labels.unionByName(terms).where("length(word) >= 3").distinct()
    pool = long.unionByName(labels.where("length(word) = 2").distinct())
    known = pool.unionByName(terms).distinct().select(F.col("word").alias("head"), F.lit(True).alias("known"))
    heads = spans.select("span").distinct().where("length(span) >= 2")
    heads = heads.select("span", F.explode(F.sequence(F.length("span"), F.least(F.lit(3), F.length("span")))).alias("n")).withColumn("head", F.substring(F.col("span"), F.lit(1), F.col("n")))
    distinct = heads.select("head").distinct()
    with_gaps = lambda df, name: df.select(name, F.explode(gapped(F.col(name))).alias("g")).select(name, "g.gap", F.col("g.syllable").alias(f"{name}_s"))
    met = with_gaps(distinct, "head").join(with_gaps(pool, "word"), "gap").where("head <> word")
    differ, final = differing_parts(F.col("head_s"), F.col("word_s"))
    met = met.where((differ == 1) | ((differ == 2) & final & (F.length("head") >= 3)))
    one = met.groupBy("head").agg(F.countDistinct("word").alias("n_words"), F.min("word").alias("word")).where("n_words = 1").select("head", "word")
    judged = heads.join(known, "head", "left").join(one, "head", "left").where("known or word is not null")
    best = judged.groupBy("span").agg(F.max_by(F.struct("n", "known", "word"), "n").alias("b"))
    return best.where("b.known is null").select("span", F.concat("b.word", F.expr("substring(span, b.n + 1)")).alias("fixed"))


def repaired(rows: DataFrame, key: str, text: str, labels: DataFrame, terms: DataFrame | None = None, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """rows with `text` repaired: pairs (wrong, right), then codes, then words; labels(label), terms(word), by default TERMS.

    Blank and null texts stay. key names the rows; rows with one key and text are repaired alike.
    Only texts with Hangul move: cut where Hangul begins and ends, and put together again.
    """
    spark = rows.sparkSession
    terms = terms if terms is not None else spark.createDataFrame([(t,) for t in TERMS], "word string")
    t = F.col(text)
    first = fixed_codes(texts.replaced_pairs(t, PAIRS + (pairs or [])))
    ready = rows.withColumn("_fixed", F.when(texts.stripped(t) != "", first).otherwise(t))
    parts = ready.where(F.col("_fixed").rlike(HANGUL)).select(key, F.col("_fixed").alias("_of")).distinct()
    parts = parts.select(key, "_of", F.posexplode(F.regexp_extract_all("_of", F.lit(rf"(?s){HANGUL}|[^가-힣]+"), F.lit(0))).alias("_at", "span"))
    known = repaired_words(parts.where(F.col("span").rlike(HANGUL)), label_words(labels), terms)
    put = parts.join(known, "span", "left").withColumn("_new", F.coalesce("fixed", "span"))
    touched = put.groupBy(key, "_of").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_new"))), lambda s: s["_new"]), "").alias("_text")).where(F.col("_text") != F.col("_of"))
    out = ready.join(touched.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_fixed") == F.col("_of")), "left")
    return out.withColumn(text, F.coalesce("_text", "_fixed")).select(*rows.columns)
