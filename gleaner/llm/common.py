"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of most contracts: runs of anything but ASCII white space. bytes.split() without arguments cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys with over one in HOT of all rows are joined by broadcast; there cannot be more than HOT of them.
HOT = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_folder(spark: SparkSession) -> None:
    """Takes the shared folder from spark.checkpoint.dir; only a local session may do without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gleaner-"))


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that all executors share, so lost executors cost no more than a reread."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: The most that one Arrow batch holds between the JVM and Python, for all operators alike: rows, and bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches where the session has Spark's defaults: its 64 MB would be held several times over in each task."""
    for name, (usual, ours) in BATCH.items():
        if spark.conf.get(name) == usual:
            spark.conf.set(name, ours)
    return spark


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows with one doc_id apart by their texts; rows that agree in both share every result."""
    return F.xxhash64(doc_id, text)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts have about `most` bytes; one row at least."""
    for begin, end in bounds(batch.column(column), most):
        yield batch.slice(begin, end - begin)


def bounds(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """First and last places of slices that have about `most` bytes; one row at least."""
    sizes = pa.compute.binary_length(texts).fill_null(0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if len(sizes) > begin:
        yield begin, len(sizes)


def release() -> None:
    """Hands freed memory back to the system, since Python workers stay and wait for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def spread_join(rows: DataFrame, by: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows with `by`, which holds each key once with the number of its rows (column `size`, dropped).

    Keys with over one in HOT of all rows meet theirs by broadcast, at most HOT of them; so no task of the shuffled join
    of all others holds more than that share of the rows for one key. `by` should be durable, it is read some times.
    """
    total = by.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > max(total // HOT, HOT)
    heavy = by.filter(hot).drop(size)
    if not heavy.limit(1).count():
        return rows.join(by.drop(size), keys)
    others = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(by.filter(~hot).drop(size), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(others)
