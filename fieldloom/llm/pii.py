"""Format-preserving pseudonyms by keyed Feistel networks (native).

Found in text: card-like numbers of 13 to 19 digits with a valid Luhn digit,
calendar dates (yyyy-mm-dd), IPv4 addresses, telephone numbers written with a
leading plus, and e-mail addresses. Numbers that stand side by side are told
apart: a telephone number or card ends where an address, a date or another card
begins, and cards are looked for at every number of a run by the Luhn digit.
After a country code other than 1 and 7 a short number behind a telephone number
cannot be told from its last digits and counts as such, up to 15 digits in all.
Each value is permuted by a keyed Feistel
network within its own format: digits stay digits, separators stay in place,
the Luhn digit stays valid, a date stays a date of the same 400 years, an
address stays an address. The permutation depends on key and value alone, so
equal values stay linked across documents. An e-mail's local part is replaced
by a keyed token of its own, its domain stays.

Only SQL functions are used: the text is split around the matches once and
the pieces are joined again. Null text stays null, texts without a match stay
as they are. An input column named n_found or n_changed is replaced; other
columns are untouched, but for __found and __new, which are the operator's own. Repeated rows repeat, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]{0,252}\.[A-Za-z]{2,24}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])"
FOURS = r"[0-9]{4}(?:[ -][0-9]{4}){3}(?:(?:[ -][0-9]{4}){4}){0,4}+(?![ -][0-9]{4}(?![0-9]))"
OTHER = rf"(?!{IP}|{DATE}|(?<![0-9])(?:{FOURS}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})(?![0-9A-Za-z]))"
# +1 and +7 have ten more digits; other numbers go on until an address, date or card begins
PHONE = rf"\+[17](?:[ ().-]{{0,2}}[0-9]){{10}}(?![0-9])|\+[0-9](?:[ ().-]{{0,2}}[0-9]){{7}}(?:[ ().-]{{0,2}}{OTHER}[0-9]){{0,7}}(?![0-9])"
# a run of whole numbers with 13 digits or more; card() looks for cards in it
CARD = rf"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?![A-Za-z])(?:[ -](?!{IP}|{DATE})[0-9]++(?![A-Za-z]))*+"
FORMS = ((4, 4, 4, 4, 3), (6, 13), (4, 4, 4, 4, 2), (4, 4, 4, 4), (8, 8), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3))
PATTERN = f"(?:{EMAIL})|(?:{IP})|(?:{DATE})|(?:{PHONE})|(?:{CARD})"
ROUNDS = 8


def _f(key: str, r: int, tag: str, value: Column) -> Column:
    """A round function: 48 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{tag}|{r}|"), value.cast("string")), 256), 1, 12), 16, 10).cast("long")


def _bind(value: Column, body) -> Column:
    """Evaluate value once within an expression."""
    return F.transform(F.array(value), body)[0]


def _mixed(left: Column, right: Column, a: Column, b: Column, key: str, tag: str, rounds: int) -> Column:
    """An alternating Feistel network on Z_a x Z_b, as struct(l, r)."""
    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    for k in range(rounds):
        if k % 2 == 0:
            step = lambda s, k=k: F.struct(F.pmod(s["l"] + _f(key, k, tag, s["r"]), a).alias("l"), s["r"].alias("r"))
        else:
            step = lambda s, k=k: F.struct(s["l"].alias("l"), F.pmod(s["r"] + _f(key, k, tag, s["l"]), b).alias("r"))
        state = _bind(state, step)
    return state


def digits_permuted(d: Column, key: str, tag: str, rounds: int = ROUNDS) -> Column:
    """Permute a string of 2 to 30 digits within its length."""
    half = F.floor(F.length(d) / 2).cast("int")
    rest = F.length(d) - half
    ten = lambda n: F.pow(F.lit(10.0), n).cast("long")
    state = _mixed(d.substr(F.lit(1), half), d.substr(half + 1, rest), ten(half), ten(rest), key, tag, rounds)
    return _bind(state, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), rest, "0")))


def luhn_sum(d: Column, doubled: int) -> Column:
    """Luhn sum of a digit string; digits at odd (doubled=1) or even (0) places from the right, counting from 0, are doubled."""
    chars = F.reverse(F.split(d, ""))
    weigh = lambda c, i: F.when(i % 2 == doubled, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(chars, weigh), F.lit(0), lambda s, x: s + x)


def _only_digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _laid(v: Column, d: Column) -> Column:
    """Lay new digits d over the digits of v; everything else stays."""
    places = F.sequence(F.lit(1), F.length(v))
    put = lambda i: F.when(v.substr(i, F.lit(1)).rlike("[0-9]"), d.substr(F.length(_only_digits(v.substr(F.lit(1), i))), F.lit(1))).otherwise(v.substr(i, F.lit(1)))
    return F.array_join(F.transform(places, put), "")


def _card(v: Column, key: str) -> Column:
    """One card number's pseudonym."""
    def body(d: Column) -> Column:
        new = digits_permuted(d.substr(F.lit(1), F.length(d) - 1), key, "card")
        full = _bind(new, lambda p: F.concat(p, F.pmod(-luhn_sum(p, 0), F.lit(10)).cast("string")))
        return _laid(v, full)

    return _bind(_only_digits(v), body)


def card(v: Column, key: str) -> Column:
    """The cards of a run of numbers: unbroken or in a usual grouping, wherever they stand; if there are none, the run's first 13 to 19 digits."""
    forms = [r"[0-9]{13,19}", *["[ -]".join(f"[0-9]{{{n}}}" for n in form) for form in FORMS]]
    at_each = F.concat(*[F.regexp_extract_all(v, F.lit(rf"(?<![0-9])(?=({form})(?![0-9]))"), F.lit(1)) for form in forms])
    valid = lambda w: luhn_sum(_only_digits(w), 1) % 10 == 0
    first = F.array(F.regexp_extract(v, r"^[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", 0))
    cards = _bind(F.filter(F.array_distinct(at_each), valid), lambda c: F.when(F.size(c) > 0, c).otherwise(F.filter(first, lambda w: (w != "") & valid(w))))

    # each card is cut out of the pieces not taken yet: [text, card, text, ...]
    def take(pieces: Column, w: Column) -> Column:
        def parts(p: Column) -> Column:
            gaps = F.split(p["s"], F.concat(F.lit("(?<![0-9])"), w, F.lit("(?![0-9])")), -1)
            plain = F.transform(gaps, lambda g: F.struct(g.alias("s"), F.lit(False).alias("card")))
            both = F.flatten(F.transform(plain, lambda g: F.array(F.struct(w.alias("s"), F.lit(True).alias("card")), g)))
            return F.when(p["card"], F.array(p)).otherwise(F.slice(both, 2, 2 * F.size(gaps)))

        return F.flatten(F.transform(pieces, parts))

    whole = F.array(F.struct(v.alias("s"), F.lit(False).alias("card")))
    cut = lambda c: F.array_join(F.transform(F.aggregate(c, whole, take), lambda p: F.when(p["card"], _card(p["s"], key)).otherwise(p["s"])), "")
    return _bind(cards, lambda c: F.when(F.size(c) > 0, cut(c)).otherwise(v))


def date(v: Column, key: str) -> Column:
    """A permutation of the 146097 days (189 x 773) of the date's 400 Gregorian years that begin with 1600 or 2000, and so on."""
    day = F.expr("date '2000-01-01'")
    def body(n: Column) -> Column:
        cycle, at = F.floor(n / 146097).cast("int"), F.pmod(n, F.lit(146097))
        s = _mixed(F.floor(at / 773), at % 773, F.lit(189), F.lit(773), key, "date", ROUNDS)
        return F.date_format(F.date_add(day, (cycle * 146097).cast("int") + _bind(s, lambda x: x["l"] * 773 + x["r"]).cast("int")), "yyyy-MM-dd")

    good = F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(F.when(v.substr(1, 4) != "0000", _bind(F.datediff(good, day), body)), v)


def ip(v: Column, key: str) -> Column:
    def body(o) -> Column:
        s = _mixed(o[0].cast("int") * 256 + o[1].cast("int"), o[2].cast("int") * 256 + o[3].cast("int"), F.lit(65536), F.lit(65536), key, "ip", ROUNDS)
        out = _bind(s, lambda x: F.concat_ws(".", F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256))
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), out).otherwise(v)

    return _bind(F.split(v, r"\."), body)


def email(v: Column, key: str) -> Column:
    name = F.substring_index(v, "@", 1)
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|mail|"), F.lower(v)), 256), 1, 12), v.substr(F.length(name) + 1, F.length(v)))


def phone(v: Column, key: str) -> Column:
    return _bind(_only_digits(v), lambda d: _laid(v, F.concat(d.substr(1, 1), digits_permuted(d.substr(F.lit(2), F.length(d) - 1), key, "phone"))))


def replaced(v: Column, key: str) -> Column:
    return (
        F.when(v.contains("@"), email(v, key))
        .when(v.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), ip(v, key))
        .when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), date(v, key))
        .when(v.startswith("+"), phone(v, key))
        .otherwise(card(v, key))
    )


RESULTS = ("n_found", "n_changed")


def pseudonymise(docs: DataFrame, key: str = "fieldloom", column: str = "text") -> DataFrame:
    """docs with the column's personal values replaced; adds n_found and n_changed."""
    text = F.col(column)
    with_found = docs.withColumn("__found", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    new = with_found.withColumn("__new", F.when(F.size("__found") > 0, F.transform("__found", lambda v: replaced(v, key))))
    gaps = F.split(text, PATTERN, -1)
    joined = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), F.col("__new").alias("n")), lambda x: F.concat(F.coalesce(x["g"], F.lit("")), F.coalesce(x["n"], F.lit("")))), "")
    return (
        new.withColumn(column, F.when(F.size("__new") > 0, joined).otherwise(text))
        .withColumn("n_found", F.coalesce(F.when(F.size("__found") > 0, F.size("__found")), F.lit(0)).cast("long"))
        .withColumn("n_changed", F.coalesce(F.size(F.filter(F.arrays_zip(F.col("__found").alias("a"), F.col("__new").alias("b")), lambda x: x["a"] != x["b"])), F.lit(0)).cast("long"))
        .drop("__found", "__new")
    )
