"""Helpers shared by the training-data operators: written tables, text batches, table readers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import remove, scratch


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data directory, whole; any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Workspace:
    """Tables written to the shared folder to cut lineage, so that lost executors cost only a reread.

    ``drop`` removes a table that no later step reads; what remains goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.n = spark, 0
        self.root = scratch(spark, label)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet and reads it again."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_tessera_path", None):
            remove(self.spark, path)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError, TypeError):  # another C library has none
    _TRIM = None

#: What operators keep in a worker process from one task to the next, by operator.
CACHES: dict[str, dict] = {}


def release(owner: str = "") -> None:
    """Drops what other operators keep in this worker process, which goes on to serve ``owner``, and gives freed memory back.

    Without the latter the process keeps most of it: objects in cycles, Arrow's pool and the C library's heap wait for later use.
    """
    dropped = False
    for name, cache in CACHES.items():
        if name != owner and cache:
            cache.clear()
            dropped = True
    if dropped:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


#: Bits of one bitmap of Spark's bitmap functions (fixed), and the most bitmaps that may be broadcast: 16 MB.
BITMAP, BITMAPS = 1 << 15, 1 << 12


def marked_by(rows: DataFrame, key: Column, wanted: DataFrame, name: str, mark: str) -> DataFrame:
    """Adds a column ``mark``: whether ``key`` (a long) may be among the values of column ``name`` of ``wanted``.

    True for all that are, and for few others. The broadcast is a hash bitmap of at most 16 MB whatever the number of values;
    where there are so many that it fills up, more rows are marked, in the end all.
    """
    n = max(1, wanted.count())
    bits = BITMAP * min(BITMAPS, 1 << max(0, (16 * n // BITMAP).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c, F.lit("slot")), F.lit(bits))
    bitmaps = wanted.select(slot(F.col(name)).alias("s")).groupBy(F.floor(F.col("s") / BITMAP).alias("__bucket")).agg(F.bitmap_construct_agg(F.pmod("s", F.lit(BITMAP))).alias("__bits"))
    columns = rows.columns
    rows = rows.withColumn("__slot", slot(key))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.pmod("__slot", F.lit(BITMAP)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, F.pmod("__slot", F.lit(8)).cast("int")) == 1
    rows = rows.join(F.broadcast(bitmaps), F.floor(F.col("__slot") / BITMAP) == F.col("__bucket"), "left")
    return rows.select(*(f"`{c}`" for c in columns), F.coalesce(held, F.lit(False)).alias(mark))


def possible(rows: DataFrame, key: Column, wanted: DataFrame, name: str) -> DataFrame:
    """The rows that ``marked_by`` marks. It spares the shuffle of a join most rows that meet nothing."""
    columns = rows.columns
    return marked_by(rows, key, wanted, name, "__maybe").where("__maybe").select(*(f"`{c}`" for c in columns))


def chunks(batch: pa.RecordBatch, column: int, limit: int = 1 << 19) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges (from, to, texts as UTF-8 bytes) of a batch, of about ``limit`` bytes or of one row; null is empty."""
    values = batch.column(column).cast(pa.binary())
    start, size, held = 0, 0, []
    for i, v in enumerate(values):
        b = v.as_py() or b""
        if held and size + len(b) > limit:
            yield start, i, held
            start, size, held = i, 0, []
        held.append(b)
        size += len(b)
    if held:
        yield start, start + len(held), held


_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: 64-bit codes of the byte values, the letters of the polynomial below.
BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULT)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16, 2 * len(_POWERS[0]))
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS[k] = np.multiply.accumulate(row)
    return _POWERS[0], _POWERS[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the polynomial of data[i:j], shifted by base**i; of length len(data) + 1."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of the bytes behind ``prefix``; equal for equal bytes wherever they are."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _MULT)
