"""What the operators of this subpackage share: session settings, shared tables, byte views of Arrow text."""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Bytes and rows in one Arrow batch: the numpy work of a batch takes some 60 times its bytes.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 4096
#: Whether Spark removes the shuffle files of a query when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Largest table, in rows, that an operator may broadcast as a Python object.
BROADCAST_ROWS = 1_000_000


def tune(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes and lets skewed joins split even where an aggregate follows."""
    for key, value in {
        "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
        "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidewright/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, free: bool = False) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder and reads it again: lineage ends there. free: the shuffle files of the
    write go as soon as it is done, not when the driver's cleaner comes by."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(FREE, None)
    if free:
        spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(FREE, before) if before is not None else spark.conf.unset(FREE)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Removes all tables that operators have left in the shared folder; results that still read them are lost."""
    drop(spark, f"{shared_dir(spark)}/tidewright")


def settle(spark: SparkSession) -> None:
    """Lets the driver's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: How to empty what an operator keeps in a worker from task to task.
KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str = "") -> None:
    """At the start of a task: what other operators have kept in this worker goes."""
    for name, clear in KEPT.items():
        if name != owner:
            clear()
    tidy()


def tidy() -> None:
    """Gives a worker's freed memory back at the end of a task: workers stay for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that further columns can't clash with an operator's own."""
    return df.select(*names)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def binary(pieces: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary column out of one buffer and its offsets."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(pieces))])


_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def held_out(doc_id: int | None, folds: int = 5) -> bool:
    """Whether crc32 of the id as text leaves remainder 0."""
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def held_out_col(col: str = "doc_id", folds: int = 5):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("None")).cast("binary")) % folds == 0
