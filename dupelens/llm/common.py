"""What several operators share: batch limits, folds, the shared folder and packed integers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds at once, one long text excepted.
BLOCK_BYTES = 8 << 20

#: Bytes of stored input that a bucket of words or strings stands for, the fewest buckets and the most. With more of them a
#: block would send rows of a few entries; beyond 256 GB of input buckets grow instead, to those of 1.6 GB of input at 100 TB.
BUCKET_BYTES = 4 << 20
LEAST_BUCKETS = 16
MOST_BUCKETS = 1 << 16


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small: texts may be long, so 10,000 of them may not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


def lean(function):
    """A batch function that gives its worker's free memory back when it ends.

    Workers are kept for later tasks. Several stages' idle workers share an executor, and freed memory that the allocators
    hold on to would add up.
    """

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, modulus: int) -> Column:
    """crc32 of the key as text, modulo the modulus; null keys count as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def use_shared_folder(spark: SparkSession) -> None:
    """checkpoint() goes to the folder in spark.checkpoint.dir; where none is set, to a temporary one in local mode, and nowhere on a cluster."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see."""
    use_shared_folder(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def estimated_bytes(df: DataFrame) -> int | None:
    """Bytes of the table as the optimizer takes them from its files; None where it doesn't know."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 55 else None


def bucket_number(df: DataFrame, each: int = BUCKET_BYTES) -> int:
    """Buckets that the words or strings of the table are dealt to, so that one holds what about `each` bytes of input hold.

    Where the size isn't known, partitions stand for it. A worker holds one bucket at a time, whatever the number of
    tasks is.
    """
    spark = df.sparkSession
    size = estimated_bytes(df)
    wanted = -(-size // each) if size is not None else 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(max(LEAST_BUCKETS, wanted), MOST_BUCKETS)


def runs(rows: Iterator[dict], key: str) -> Iterator[list[dict]]:
    """Successive rows of equal key."""
    held: list[dict] = []
    for row in rows:
        if held and held[0][key] != row[key]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows one by one: some are large, so a batch isn't turned as a whole."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sub_batches(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `limit` bytes each, a single longer text excepted."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // limit)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a partition regrouped into blocks of about `limit` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in sub_batches(batch, text, limit):
            n = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
            if held and size + n > limit:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.concat_batches(held)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**32 as variable-length bytes, seven bits each, low bits first."""
    if len(values) > 1 << 19:  # in parts, for the work space is several times the input
        return b"".join(pack(values[k : k + (1 << 19)]) for k in range(0, len(values), 1 << 19))
    values = np.asarray(values, dtype=np.uint64)
    if not len(values):
        return b""
    lengths = 1 + sum((values >= (1 << s)).astype(np.int64) for s in (7, 14, 21, 28))
    ends = np.cumsum(lengths)
    out = np.zeros(int(ends[-1]), dtype=np.uint8)
    starts = ends - lengths
    for k in range(int(lengths.max())):
        has = lengths > k
        out[starts[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(lengths[has] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def pack_parts(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """pack() of each part of the values; cuts has the parts' starts and the end of the last."""
    sizes = np.ones(len(values), np.int8)
    for shift in (7, 14, 21, 28):
        sizes += values >= (1 << shift)
    at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[cuts].tolist()
    data = pack(values)
    return [data[a:z] for a, z in zip(at, at[1:], strict=False)]


def unpack(data: bytes) -> np.ndarray:
    """The integers that pack() has packed."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.int64)
    last = raw < 128
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate(([0], ends[:-1]))
    out = np.zeros(len(ends), dtype=np.int64)
    lengths = ends - starts
    for k in range(int(lengths.max())):
        has = lengths > k
        out[has] |= (raw[starts[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A column of texts; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]
