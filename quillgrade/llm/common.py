"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SHARED: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by ``spark.checkpoint.dir``; a temporary one where all run in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL_SHARED:
        _LOCAL_SHARED["dir"] = "file://" + tempfile.mkdtemp(prefix="quillgrade-")
    return _LOCAL_SHARED["dir"]


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillgrade/{label}-{uuid.uuid4().hex}"


def bounded_batches(df: DataFrame, most: int = 4_000_000) -> DataFrame:
    """The same table; batches that the session hands to Python hold at most so many bytes from now on.

    Texts can be very long, and a batch stands in the memory of both sides. The result of a
    query is worked out after the operator has returned, so the bound is the session's; a
    lower one of its own stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    jvm = df.sparkSession._jsparkSession.sessionState().conf()
    if jvm.arrowMaxBytesPerBatch() > most:
        df.sparkSession.conf.set(name, str(most))
    return df


def materialise(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors.

    The default codec works in the heap; others hold buffers beside it.
    """
    path = scratch(df.sparkSession, label)
    bounded_batches(df).write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame):
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        yield folder, path, path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def folder_bytes(df: DataFrame) -> int:
    """Bytes of the files that a materialised table is read from."""
    return sum(fs.getContentSummary(path).getLength() for _, path, fs in _folders(df))


def discard(df: DataFrame) -> None:
    """Deletes the files behind a materialised table that nothing reads any more."""
    for folder, path, fs in _folders(df):
        if "/quillgrade/" in folder:
            fs.delete(path, True)


BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8_000_000


def sent_if_small(rows: DataFrame, most_rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast where the size and the rows of the written table show that it is small; joined by shuffle beyond."""
    return F.broadcast(rows) if folder_bytes(rows) <= most_bytes and rows.count() <= most_rows else rows


#: Rows that one step of :func:`sum_arrays` adds up.
MERGED = 64


def sum_arrays(rows: DataFrame) -> np.ndarray | None:
    """The sum of the arrays ``value``, equally long; ``some`` numbers the tasks that made them. None without rows.

    Sums of some tasks' arrays are added by many tasks before the last few come to the driver.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for some, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[some] = sums.get(some, 0.0) + own.values.to_numpy()
        for some, total in sums.items():
            yield pa.RecordBatch.from_pydict({"some": pa.array([some], pa.int64()), "value": pa.array([total], pa.list_(pa.float64()))})

    for _ in range(2):
        parts = rows.select(F.floor(F.col("some") / MERGED).cast("long").alias("some"), "value").repartition("some")
        rows = parts.mapInArrow(run, "some long, value array<double>")
    found = [np.array(r["value"]) for r in rows.collect()]
    return sum(found) if found else None


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without making Python strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def _trim() -> None:
    """Gives the allocator's free pages back, where it can be told to."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that a worker holds the Python objects of few rows at once; freed memory goes back."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        pa.default_memory_pool().release_unused()
        _trim()


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to about ``most``; a larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of many runs of a flat array, one run after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def per_group(lens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``lens``; group i holds the next counts[i] of them."""
    upto = np.r_[0, np.cumsum(lens)]
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
