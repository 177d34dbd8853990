"""Shared pieces of the training-data operators: materialising, Arrow text access, 64-bit hashing."""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the controls 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
U = np.uint64
#: What small_batches found, and an entry for each thread within it.
_INSIDE: list[str] = []
_LOCK = threading.Lock()
#: Folders of the tables that cut wrote and that are still referred to.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. On one machine (local mode, tests) a temporary
    folder is set where none is; on a cluster a local folder would not be shared, so that is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="marlstone-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most size bytes for what runs inside: ten thousand long texts at once fill a worker's memory. Of several
    threads the first sets it, and the last sets back what the first found."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    with _LOCK:
        if not _INSIDE:
            _INSIDE.append(spark.conf.get(key))
        _INSIDE.append("")
        spark.conf.set(key, size)
    try:
        yield
    finally:
        with _LOCK:
            _INSIDE.pop()
            if len(_INSIDE) == 1:
                spark.conf.set(key, _INSIDE.pop())


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: ends the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut wrote, once nothing that is still to be computed reads them: what an operator returns may be written
    later, so only tables that its result does not read may go."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            session = table.sparkSession
            place = session._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(session._jsc.hadoopConfiguration()).delete(place, True)


def smallest(df: DataFrame, by: Column, n: int) -> DataFrame:
    """The n rows of df with the smallest hashes by; rows whose hash is too large to be among them are left out first, so
    that no partition sends n rows to the driver."""
    share = min(1.0, (2 * n + 200) / max(1, df.count()))
    return df.where(by.cast("double") <= -(2.0**63) + share * 2.0**64).orderBy(by).limit(n)


def fingerprint(df: DataFrame) -> tuple:
    """Row count and order-free checksum, to see whether an iteration changed anything."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return row[0], row[1]


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """Gapless numbers from 0 in the given order, without one task seeing all rows.

    A range sort gives each row its partition and its place there; the table is written, so both stay fixed;
    offsets come from one count per partition (as many rows as partitions).
    """
    placed = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    counts = sorted((r["p"], r["c"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())
    start, base = {}, 0
    for p, c in counts:
        start[p], base = base, base + c
    offsets = df.sparkSession.createDataFrame(list(start.items()) or [(0, 0)], "p long, start long")
    return (
        placed.join(F.broadcast(offsets), part == F.col("p"))
        .withColumn(name, F.col("start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_m", "p", "start")
    )


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null is an empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """Runs (first, past last) of rows with at most limit bytes of text, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on as one little-endian integer, zeros behind the end; a view, no copy per place."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges (none of them empty): every eight bytes are scrambled with their place, then added.

    A sum of scrambled words, not a polynomial: texts built against polynomial hashes modulo 2**64 do not collide.
    """
    if not len(start):
        return np.zeros(0, U)
    size = end - start
    lanes = (size + 7) >> 3
    first = np.cumsum(lanes) - lanes
    own = np.repeat(np.arange(len(start)), lanes)
    k = np.arange(len(own)) - first[own]
    lane = eights(data)[start[own] + 8 * k]
    last = first + lanes - 1
    lane[last] &= U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * (size - 8 * (lanes - 1)).astype(U))
    lane = mix(mix(lane) + (k + 1).astype(U) * U(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(lane, first) + size.astype(U) * U(0xD6E8FEB86659FD93))


def words_of(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word; bounds are the rows' offsets within data; A-Z may be lower-cased."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    ink = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return span_hashes(data, start, end), np.searchsorted(bounds, start, "right") - 1


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
