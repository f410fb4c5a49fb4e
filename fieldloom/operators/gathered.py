"""Rows of whole pages, one page after another, so that work on a page needs no shuffle of its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def gathered(rows: DataFrame, page: str) -> DataFrame:
    """rows, those of one page one after another in one partition; what explode makes of them lies so too.

    Rows of words take several times the space of the texts that they are made from: gather those. As
    many tasks as shuffles have: by the few bytes of the texts, Spark would merge them into one or two.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), page).sortWithinPartitions(page)


def runs(keys: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Where another key than the one before begins; a null is a key like others."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    ids = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(ids[1:] != ids[:-1]) + 1


def whole_pages(batches: Iterator[pa.RecordBatch], page: str) -> Iterator[pa.Table]:
    """The rows of gathered batches in tables that end where a page ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(page)
        if held and held[-1].column(page)[-1].as_py() != keys[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if len(begins := runs(keys)):
            last = int(begins[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def page_numbers(keys: pa.ChunkedArray) -> np.ndarray:
    """Of each row the number of its page, from 0 on."""
    numbers = np.zeros(len(keys), np.int64)
    numbers[runs(keys)] = 1
    return numbers.cumsum()


def floats(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles; null is NaN."""
    return column.cast(pa.float64()).to_numpy()


def low(values: np.ndarray) -> np.ndarray:
    """Values to sort by: NaN, which stands for null, comes first."""
    return np.where(np.isnan(values), -np.inf, values)
