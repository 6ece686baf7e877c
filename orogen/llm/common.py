"""Helpers shared by the training-data operators: shared storage, Arrow buffers, word hashing."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

MIN_LONG = -(2**63)
_SCRATCH: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a local master takes a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back, which cuts its lineage."""
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``materialize``, with the folder, for tables that are given up before the result is read."""
    path = f"{_SCRATCH.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for all that is written meanwhile, to be discarded once what comes of it is stored elsewhere."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(before)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``written``; nothing that is read later may depend on it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each led by as many underscores as make it one that ``df`` has no column of, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def quoted(*names: str) -> list[str]:
    """Column names as references, whatever signs they hold."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def give_back() -> None:
    """Hand memory that is no longer used back to the system, as a worker outlives its task and waits for the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc keeps freed memory, and knows this call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives its memory back at the end of a task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any names: a name with a dot or a backtick would be taken for a path there."""
    names, plain = df.columns, [f"c{i}" for i in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=plain)
        give_back()

    result = StructType([StructField(c, f.dataType) for c, f in zip(plain, schema, strict=True)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, result).toDF(*schema.names)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and its ``len + 1`` offsets, without a copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all of its bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


class SpanHasher:
    """Polynomial prefix sums modulo 2**64, so that any byte span of a buffer hashes in constant time."""

    def __init__(self, seed: int = 20240501) -> None:
        rng = np.random.default_rng(seed)
        self.symbol = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64((int(rng.integers(2**61, 2**62)) * 8 + 5) % 2**64)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.power = np.ones(1, np.uint64)
        self.unpower = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.power) < n:
            step = len(self.power)
            self.power = np.concatenate([self.power, self.power * np.uint64(pow(int(self.base), step, 2**64))])
            self.unpower = np.concatenate([self.unpower, self.unpower * np.uint64(pow(int(self.inverse), step, 2**64))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.symbol[data] * self.power[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.unpower[start])


def byte_class(accept) -> np.ndarray:
    return np.array([bool(accept(b)) for b in range(256)])


#: Lower-case for A-Z alone; every other byte, those of multi-byte characters included, stands.
ASCII_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Letters, digits and every byte of a non-ASCII character.
WORD = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def word_spans(data: np.ndarray, offsets: np.ndarray, accept: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of accepted bytes, and per row the range of its runs; runs never cross rows."""
    inside = accept[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)
