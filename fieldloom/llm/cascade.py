"""URL rules held in a Bloom filter cascade (native).

A rule is a host and a path prefix. The complete key universe of a corpus is
each url's host suffixes joined with its path prefixes of the lengths that
rules have. For each action a cascade is built over that universe: level 0
encodes the listed keys, level 1 those keys of the universe that level 0 holds
falsely, level 2 the listed keys that level 1 holds falsely, and so on until no
key is held falsely. A key is listed when the first level that lacks it is odd.
Filters are literals of at most MAX_WORDS words, since rule lists are
bounded: membership is exact for this universe without a join.

A null url or one without :// has empty host and path and no rule. Urls that no
rule fits are allowed: their keys are in no list. Repeated pages repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = {"block": ("net/", "example.com/de/"), "allow": ("example.net/en/", "org/fr/")}
MAX_WORDS = 1 << 18
HASHES = 4


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def parsed(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path"))


def keys(h: Column, p: Column, lengths: list[int]) -> Column:
    """All candidate keys of a url, the longest first."""
    labels = F.split(h, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    per_host = lambda x: F.filter(F.array(*[F.when(F.length(p) >= n, F.concat(x, p.substr(1, n))) for n in lengths]), lambda k: k.isNotNull())
    found = F.flatten(F.transform(hosts, per_host))
    order = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.when(h != "", F.array_sort(F.array_distinct(found), order)).otherwise(F.array().cast("array<string>"))


def _places(key: Column, level: int, bits: int) -> list[Column]:
    a, b = (F.pmod(F.xxhash64(key, F.lit(x)), F.lit(1 << 40)) for x in (level, -1 - level))
    return [F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(HASHES)]


def _within(key: Column, level: int, words: list[int]) -> Column:
    table, yes = F.lit(words) if words else None, None
    if table is None:
        return F.lit(False)
    for at in _places(key, level, len(words) * 64):
        bit = F.get(table, F.floor(at / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0
        yes = bit if yes is None else yes & bit
    return yes


def _filter(listed: DataFrame, level: int) -> list[int]:
    """The words of a Bloom filter over listed(key): words are or-ed where the keys are, only words reach the driver."""
    n = listed.count()
    if n == 0:
        return []
    size = max(1, -(-n * 10 // 64))
    if size > MAX_WORDS:
        raise ValueError(f"{n} listed keys need more than {MAX_WORDS} words")
    at = listed.select(F.explode(F.array(*_places(F.col("key"), level, size * 64))).alias("at"))
    got = at.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("v")).collect()
    words = [0] * size
    for w, v in got:
        words[w] = v
    return words


def build(universe: DataFrame, listed: list[str], most: int = 32) -> list[list[int]]:
    """The cascade's levels for the listed keys within universe(key)."""
    is_listed = F.col("key").isin(*listed) if listed else F.lit(False)
    yes, no = universe.where(is_listed), universe.where(~is_listed)
    levels: list[list[int]] = []
    inside, outside = yes, no
    while True:
        words = _filter(inside, len(levels))
        if not words:
            return levels
        if len(levels) == most:
            raise ValueError("the cascade does not end")
        levels.append(words)
        inside, outside = outside.where(_within(F.col("key"), len(levels) - 1, words)), inside


def listed_in(key: Column, levels: list[list[int]]) -> Column:
    out = F.lit(len(levels) % 2 == 1)
    for k in reversed(range(len(levels))):
        out = F.when(~_within(key, k, levels[k]), F.lit(k % 2 == 1)).otherwise(out)
    return out


def judge(pages: DataFrame, rules: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) per page."""
    rules = rules or RULES
    lengths = sorted({len(r) - r.index("/") for rs in rules.values() for r in rs}, reverse=True)
    rows = parsed(pages)
    universe = rows.select("host", "path").distinct().select(F.explode(keys(F.col("host"), F.col("path"), lengths)).alias("key")).distinct()
    universe = universe.persist()
    cascades = {k: build(universe, list(rs)) for k, rs in rules.items()}
    universe.unpersist()
    candidates = keys(F.col("host"), F.col("path"), lengths)
    hit = lambda k: listed_in(k, cascades["block"]) | listed_in(k, cascades["allow"])
    rule = F.get(F.filter("__keys", hit), F.lit(0))
    return (
        rows.withColumn("__keys", candidates)
        .withColumn("rule", rule)
        .select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull() & listed_in(F.col("rule"), cascades["block"]), "block").otherwise("allow").alias("verdict"))
    )


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, h, pre, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
b AS (SELECT page_id, host, path, r.rule, r.verdict,
             row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rule) DESC) AS n
      FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM b WHERE n = 1
"""
