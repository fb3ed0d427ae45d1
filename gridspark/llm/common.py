"""Shared helpers of the text operators: table access, folds, vectorised words, shared scratch space.

Null texts count as empty everywhere.  Words are maximal runs of bytes outside
``[\\x20\\x09-\\x0D]`` after lower-casing A-Z only, unless an operator says otherwise.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are handled in slices of about so many bytes, which bounds the numpy temporaries.
SLICE = 1 << 20
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder that the session names (local ones set one of their own)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir() + "/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and survives lost executors.

    The shuffle files that df was made of are of no more use; Spark deletes them once the driver's JVM has
    collected its garbage, which is asked for here.
    """
    tuned(df.sparkSession)
    spark, path, schema = df.sparkSession, scratch(df.sparkSession, name), df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    give_back()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def tuned(spark: SparkSession, rows: int = 256, size: str = "4m") -> None:
    """Arrow batches of so many rows and bytes (or one row), as rows are whole texts; once for the session, unless it has settings of its own."""
    name = "spark.sql.execution.arrow.max%sPerBatch"
    for what, default, value in (("Records", "10000", str(rows)), ("Bytes", "67108864b", size)):
        if spark.conf.get(name % what) == default:
            spark.conf.set(name % what, value)


def sized(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most ``most`` rows; else the join is left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of stored() frames that nothing will read any more."""
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def binary_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + SLICE // 4)
        inverse = np.uint64(pow(int(_ROOT), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, r, np.uint64)])) for r in (_ROOT, inverse)]
    return _powers[0], _powers[1]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows whose bytes at[0]..at[-1] are: starts and ends of words (from at[0]), 64-bit hashes, first word of each row."""
    b = LOWER[data[at[0] : at[-1]]]
    n = len(b)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), np.zeros(len(at), np.int64)
    solid = ~SPACE[b]
    edge = np.zeros(n + 1, bool)
    edge[at - at[0]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    h = token_hashes(b, starts, ends)
    return starts, ends, h, np.searchsorted(starts, at - at[0])


def token_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges."""
    power, inverse = _power(len(b) + 1)
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def grams(h: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hashes of the word tuples at i+offsets[0], i+offsets[1], ... for every i that has them all (rows are not minded)."""
    n = len(h) - max(offsets)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(len(offsets) * 0x51ED27 + sum(offsets)), np.uint64)
    for k, o in enumerate(offsets):
        out = (out + h[o : o + n]) * _MUL[k]
        out ^= out >> np.uint64(29)
    return mix(out)


def give_back() -> None:
    """Hands memory that this process has freed, or can make again at once, to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def forget(shared: Broadcast) -> None:
    """Frees what a worker has read of a broadcast; its next task reads the executor's file again."""
    shared.__dict__.pop("_value", None)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow after which its worker gives what it has freed back to the system, as workers wait for other tasks."""

    def kept_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return kept_small


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(f(batch))

    tuned(df.sparkSession)
    return df.mapInArrow(lean(run), schema)
