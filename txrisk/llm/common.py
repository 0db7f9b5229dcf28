"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.session import checkpoint_dir

#: The white space of the word rule [^\x20\x09-\x0D]+; bytes.split() uses exactly this set.
WHITE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/txrisk-llm/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str, batch_rows: int | None = None, spread: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The shuffle files of the written plan are of no more use, so Spark is asked to remove them with it.
    ``batch_rows`` bounds the rows of an Arrow batch, for plans with large rows.  ``spread`` keeps small shuffle
    partitions apart, for plans whose work does not show in their bytes.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows:
        conf["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    if spread:
        conf["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives its freed memory back at its end, for workers are kept for later tasks."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim:
            trim(0)

    return task


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty, one at a time."""
    col = batch.column(name).cast(pa.large_binary())
    for v in col:
        yield v.as_py() or b""


def window_codes(ids: np.ndarray, size: int, k: int) -> np.ndarray:
    """Equal codes exactly for equal k-windows of ids in [0, size); ids has at least k entries."""
    n = len(ids) - k + 1
    codes, span = ids[:n].astype(np.int64), max(1, size)
    for j in range(1, k):
        if span * size >= 1 << 62:
            _, codes = np.unique(codes, return_inverse=True)
            span = int(codes.max()) + 1
        codes = codes * size + ids[j : j + n]
        span *= size
    return codes


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Boolean mask of the n places covered by the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + lengths, -1)
    return np.cumsum(d[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each maximal run of True."""
    d = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def multiply_mod_hash(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function on uint64 (wraps on purpose)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
