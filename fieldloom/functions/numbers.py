"""Numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


WIDE = ("０１２３４５６７８９．，＋－", "0123456789.,+-")


def first_number(text: Column) -> Column:
    """The first number of a text without thousands commas and plus, with a digit before the point; '' if there is none. Full-width characters count as the usual ones."""
    found = F.regexp_extract(F.translate(F.coalesce(text, F.lit("")), *WIDE), r"([-+]?(?:\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?|\.\p{Nd}+))", 1)
    padded = F.regexp_replace(F.regexp_replace(found, ",", ""), r"(?<![^+-])\.", "0.")
    return F.regexp_replace(padded, r"^\+", "")

