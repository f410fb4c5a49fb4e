"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    """Words of a text: runs of anything but ASCII white space; a null text has none."""
    return WORD.findall(text) if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; one process on this machine may also take a folder of its own, a cluster may not."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not named:
            import tempfile

            named = tempfile.mkdtemp(prefix="ckpt-")
        sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder."""
    checkpoint_dir(spark := df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values):
    """Settings (two underscores for a point) for the jobs run inside; then the former ones."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: tables without a proven bound are never broadcast, however small they are here: joins inside these settings shuffle both sides
UNBOUNDED = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1"}

def small_batches(spark: SparkSession, size: str = "4m", key: str = "spark.sql.execution.arrow.maxBytesPerBatch") -> None:
    """From now on rows go to Python in batches of about `size` instead of 64 MiB, unless the session has a limit of its own.

    An executor holds a batch outside its heap, twice while it grows. The setting stays, since later jobs compute what operators return.
    """
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def sliced(run, rows: int = 2000):
    """The same work on batches of at most so many rows; after a task a worker gives back the memory that it no longer uses."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, max(b.num_rows, 1), rows):
                yield b.slice(at, rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(small(batches))
        give_back()

    return work


def give_back() -> None:
    """Freed memory of Arrow and of the allocator goes back to the system, since workers live on between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Cache(dict):
    """A word cache of bounded size: emptied when full, so results never depend on it."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self.make(key)
        if len(key) <= 256:
            self[key] = value
        return value


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLOCK, LONG = 1 << 18, 512
MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * B
    return h ^ (h >> np.uint64(29))


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in their order."""
    return mix((a * A) ^ mix((b + B) * A))


def word_bounds(b: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the words in b, where texts begin at the places given."""
    inside = ~SPACE[b]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[begins] = inside[begins]
    ends = begins[begins > 0] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def bytes_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of the byte ranges of b: eight bytes at a time are mixed into the hash of their length.

    Ranges of one length up to eight bytes never share a hash. Ranges of over LONG bytes have a digest.
    """
    b = FOLD[b] if fold else b
    # the eight bytes from every place on
    eights = np.ndarray(len(b) + 1, "<u8", np.append(b, np.zeros(8, np.uint8)), strides=(1,))
    left = end - start
    h = mix((left.astype(np.uint64) + B) * A)
    long = np.flatnonzero(left > LONG)
    rows = np.flatnonzero((left > 0) & (left <= LONG))
    at, left = start[rows], left[rows]
    while len(rows):
        h[rows] = mix((h[rows] ^ eights[at] & MASKS[np.minimum(left, 8)]) * A)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in long.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(b[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def _pieces(b: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of b of BLOCK bytes or somewhat more, each after a white space or where a text begins; a longer word stays whole."""
    at, look = 0, 1 << 12
    while at < len(b):
        to = at + BLOCK
        while to < len(b):
            blank = np.flatnonzero(SPACE[b[to - 1 : to - 1 + look]])[:1] + to
            begin = begins[np.searchsorted(begins, to) :][:1]
            if len(blank) or len(begin) and begin[0] < to + look:
                to = int(min([*blank, *begin]))
                break
            to += look
        yield at, min(to, len(b))
        at = to


def trimmed(b: np.ndarray, first: np.ndarray, end: np.ndarray, marks: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges without up to `most` bytes of the table marks at either side; a range of such bytes alone keeps its last one."""
    first, end = first.copy(), end.copy()
    for _ in range(most if len(first) else 0):
        end -= marks[b[end - 1]] & (end - first > 1)
        first += marks[b[first]] & (end - first > 1)
    return first, end


def hashed_words(column: pa.Array, fold: bool = False, most: int = 2 << 20, marks: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The words of a string or binary column, some rows at a time: of about `most` bytes, or one longer text.

    Each item is (first row, end row, bytes, place of each row's first word and of the end,
    first bytes, end bytes, hashes); fold lower-cases A-Z for the hashes, marks trims bytes of
    that table for them. A null has no words.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = min(len(column), max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1))
        b = data[offsets[row] : offsets[end]]
        at = offsets[row : end + 1] - offsets[row]
        begins = np.unique(at[:-1])
        begins = begins[begins < len(b)]
        firsts, ends, hashes = [], [], []
        for x, y in _pieces(b, begins):
            inner = begins[np.searchsorted(begins, x) : np.searchsorted(begins, y)] - x
            f, e = word_bounds(b[x:y], inner)
            hashes.append(bytes_hashes(b[x:y], *((f, e) if marks is None else trimmed(b[x:y], f, e, marks)), fold))
            firsts.append(f + x)
            ends.append(e + x)
        none = np.zeros(0, np.int64)
        f = np.concatenate(firsts) if firsts else none
        yield row, end, b, np.append(np.searchsorted(f, at[:-1]), len(f)), f, np.concatenate(ends) if ends else none, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        row = end


def in_order(places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """places[i], places[i] + 1, ... of sizes[i] numbers each, one after another."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(places, sizes)
