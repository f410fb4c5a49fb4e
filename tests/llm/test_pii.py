"""Personal values that stand next to other numbers."""

import re

from fieldloom.llm import pii

PHONE, IP, CARD, SPACED, DATE = "+1 (826) 555-4081", "190.137.223.204", "4111111111111111", "4111 1111 1111 1111", "2021-02-28"
CASES = [
    (f"{PHONE} {IP}", [PHONE, IP]),
    (f"{PHONE} 190", [PHONE, "190"]),
    (f"{PHONE} {CARD}", [PHONE, CARD]),
    (f"{PHONE} {SPACED} {DATE}", [PHONE, SPACED, DATE]),
    (f"+49 170 1234567 {IP} {PHONE}", ["+49 170 1234567", IP, PHONE]),
    (f"+49 170 1234567 {DATE} 12", ["+49 170 1234567", DATE, "12"]),
    (f"+49 170 1234567 {SPACED}", ["+49 170 1234567", SPACED]),
    (f"+44 20 7946 0958 {SPACED}", ["+44 20 7946 0958", SPACED]),
    (f"+44 20 7946 0958 {SPACED} {SPACED}", ["+44 20 7946 0958", SPACED, SPACED]),
    ("+45 12.34.56.78", ["+45 12.34.56.78"]),
    (f"12 {CARD}", ["12", CARD]),
    (f"{CARD} 12", [CARD, "12"]),
    (f"5 {SPACED}", ["5", SPACED]),
    (f"1234 {SPACED} 1234", ["1234", SPACED, "1234"]),
    (f"123456 {SPACED} 5500005555555559 7", ["123456", SPACED, "5500005555555559", "7"]),
    (f"{CARD} {CARD} 4111-1111-1111-1111", [CARD, CARD, "4111-1111-1111-1111"]),
    (f"{CARD} {IP} 12 {DATE}", [CARD, IP, "12", DATE]),
    (f"12 {DATE} {CARD} {PHONE}", ["12", DATE, CARD, PHONE]),
    (f"{SPACED} 3rd", [SPACED, "3rd"]),
    ("41 11 11 11 11 11 11 11", ["41 11 11 11 11 11 11 11"]),
    ("4111111111111112 12 34", ["4111111111111112 12 34"]),
    (" ".join(["12"] * 30_000), [" ".join(["12"] * 30_000)]),
]
PRIVATE = {PHONE, IP, CARD, SPACED, DATE, "4111-1111-1111-1111", "+49 170 1234567", "+45 12.34.56.78", "+44 20 7946 0958", "5500005555555559", "41 11 11 11 11 11 11 11"}


def test_adjacent_values(spark):
    """Each value gets the pseudonym it has where it stands alone."""
    texts = [*sorted(PRIVATE), *[t for t, _ in CASES]]
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    alone = {t: out[i] for i, t in enumerate(texts) if t in PRIVATE}
    assert all(a != b for a, b in alone.items())
    wrong = []
    for i, (text, parts) in enumerate(CASES, len(PRIVATE)):
        if out[i] != " ".join(alone.get(p, p) for p in parts) or re.sub(pii.PATTERN, "#", out[i]) != re.sub(pii.PATTERN, "#", text):
            wrong.append((text[:80], out[i][:80]))
    assert not wrong
