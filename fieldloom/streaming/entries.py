"""Entries as a stream of files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names; one process on this machine may also take a folder of its own, a cluster may not."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="stream-")
    return root


def first_entries(stream: DataFrame, key: str) -> DataFrame:
    """An entry that is sent again counts once; the keys seen are the query's state."""
    return stream.dropDuplicates([key])


def drained(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """All rows that the stream has by now, written as a table in the shared folder; the same base goes on where the last call ended."""
    from uuid import uuid4

    spark = stream.sparkSession
    base = base or f"{checkpoint_root(spark)}/{name}-{uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY_ID = re.compile(r"[A-Za-z0-9_-]{8,64}")
RECEIPT = StructType([StructField("at", LongType()), StructField("id", StringType()), StructField("status", StringType()), StructField("seq", LongType())])


class Desk(StatefulProcessor):
    """The desk of one form: open or closed, how many entries it took, and the number of each id."""

    def __init__(self, key: str, kind):
        self.out = StructType([StructField(key, kind), *RECEIPT.fields])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.form = handle.getValueState("form", StructType([StructField("closed", BooleanType()), StructField("last", LongType())]))
        self.ids = handle.getMapState("ids", StructType([StructField("id", StringType())]), StructType([StructField("seq", LongType())]))

    def receipt(self, kind: str, entry: str | None, closed: bool, last: int) -> tuple[str, int | None]:
        """(status, number) of an entry; taken ones get the next number."""
        entry = (entry or "")[:64]
        if closed:
            return "closed", None
        if not ENTRY_ID.fullmatch(entry):
            return "invalid", None
        if self.ids.containsKey((entry,)):
            return "duplicate", self.ids.getValue((entry,))[0]
        self.ids.updateValue((entry,), (last + 1,))
        return "taken", last + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed, last = self.form.get() if self.form.exists() else (False, 0)
        batch = pd.concat(list(rows)).sort_values("at", kind="stable")
        out = []
        for at, kind, entry in zip(batch["at"].tolist(), batch["kind"].tolist(), batch["id"].tolist()):
            if kind in ("close", "open"):
                closed = kind == "close"
                continue
            status, seq = self.receipt(kind, entry, closed, last)
            last += status == "taken"
            out.append((key[0], at, entry, status, seq))
        self.form.update((closed, last))
        yield pd.DataFrame(out, columns=self.out.names).astype({"seq": "Int64", "at": "Int64"})

    def close(self) -> None:
        pass


def received(stream: DataFrame, form: str) -> DataFrame:
    """(form, at, id, status, seq): what becomes of each entry of stream(form, at, kind, id), where kind is entry, close or open.

    A closed form takes nothing until it opens again; an id is 8 to 64 letters, digits, - or _ (longer
    ones are cut); one sent again has its first number and counts once. Taken entries are numbered from
    1 in each form, in the order of `at` within a batch and of the batches. State is kept per form and
    id, so a restarted query goes on where its checkpoint ends; the rows of one form of one batch are
    held together, so the source's batch size bounds them. Entries with a null kind are entries; a null
    form is a form.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    desk = Desk(form, stream.schema[form].dataType)
    rows = stream.select(form, F.col("at").cast("bigint").alias("at"), "kind", "id")
    return rows.groupBy(form).transformWithStateInPandas(desk, outputStructType=desk.out, outputMode="Append", timeMode="None")
