"""Sync of entries after a watermark."""

from fieldloom.operators import stores


def test_sync_is_not_one_page(spark):
    """All pages after the watermark arrive, known ids stay out and a repeated id counts once."""
    rows = spark.createDataFrame([(i, f"e{i}") for i in range(1, 1301)] + [(1301, "e700")], "seq int, id string")
    known = spark.createDataFrame([("e150",), ("e1300",), ("e1300",)], "id string")
    got = sorted((r["seq"], r["id"]) for r in stores.sync(rows, "seq", 100, "id", known).collect())
    assert got == [(i, f"e{i}") for i in range(101, 1300) if i != 150]
