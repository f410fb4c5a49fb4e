"""Entries of forms that close and open again, over restarts of the stream."""

from fieldloom.streaming import entries

SCHEMA = "form string, at long, kind string, id string"


def send(spark, folder, *rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(folder))


def drain(spark, folder, base):
    stream = spark.readStream.schema(SCHEMA).json(str(folder))
    got = entries.drained(entries.received(stream, "form"), "receipts", str(base))
    return sorted((r["form"], r["at"], r["status"], r["seq"]) for r in got.collect())


def test_forms_close_and_a_restart_goes_on(spark, tmp_path):
    folder, base = tmp_path / "in", tmp_path / "run"
    send(spark, folder, ("a", 1, "entry", "entry-001"), ("a", 3, "close", None), ("a", 2, "entry", "entry-002"), ("a", 4, "entry", "entry-003"), ("b", 1, "entry", "entry-001"), ("b", 2, "entry", "short"), ("b", 3, "entry", None), ("b", 4, None, "x" * 80))
    first = drain(spark, folder, base)
    assert first == [("a", 1, "taken", 1), ("a", 2, "taken", 2), ("a", 4, "closed", None), ("b", 1, "taken", 1), ("b", 2, "invalid", None), ("b", 3, "invalid", None), ("b", 4, "taken", 2)]
    # nothing new: nothing is counted twice
    assert drain(spark, folder, base) == first
    # the restarted stream still knows that a is closed, and each id
    send(spark, folder, ("a", 5, "entry", "entry-001"), ("a", 6, "open", None), ("a", 7, "entry", "entry-003"), ("a", 8, "entry", "entry-001"), ("b", 5, "entry", "x" * 64), ("b", 6, "entry", "bad id!!"))
    assert drain(spark, folder, base) == sorted([*first, ("a", 5, "closed", None), ("a", 7, "taken", 3), ("a", 8, "duplicate", 1), ("b", 5, "duplicate", 2), ("b", 6, "invalid", None)], key=lambda r: r[:2])
