"""Readers. All give lazy DataFrames, so that Catalyst prunes columns and pushes filters into the scan."""

from __future__ import annotations

import csv as _csv
from collections.abc import Iterable, Iterator
from os import PathLike

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from ..storage import scratch


def _head(spark: SparkSession, path: str, size: int = 4096) -> str:
    """The first bytes of the first file at a path, from whatever store Spark reads."""
    found = spark.read.format("text").load(path).limit(50).collect()  # lines, read lazily by one task
    return "\n".join(r[0] for r in found)[:size]


def sniff(head: str) -> str:
    """The delimiter of a sample: a usual one, else any sign that isn't a letter, digit or quote; a comma when none can be told."""
    for usual in (",\t;|", None):
        try:
            found = _csv.Sniffer().sniff(head, delimiters=usual).delimiter
        except _csv.Error:
            continue
        if not found.isalnum() and found not in "\"'_\r\n":
            return found
    return ","


def csv(spark: SparkSession, path: str | PathLike[str], header: bool = True, schema: T.StructType | str | None = None, sep: str | None = None) -> DataFrame:
    """Delimited text: every column a string unless a schema is given; quotes doubled, empty fields null, blank lines skipped.

    Without a header, columns are ``field_1`` to ``field_N``. The delimiter is told from the head of the file.
    """
    path = str(path)
    reader = spark.read.option("header", header).option("sep", sep or sniff(_head(spark, path))).option("quote", '"').option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", False).csv(path)
    return df if header else df.toDF(*(f"field_{i + 1}" for i in range(len(df.columns))))


def parquet(spark: SparkSession, path: str | PathLike[str]) -> DataFrame:
    """A Parquet file or folder."""
    return spark.read.parquet(str(path))


def memory(spark: SparkSession, rows: pa.Table | Iterable[object], schema: T.StructType | str | None = None) -> DataFrame:
    """An Arrow table, or rows with a schema."""
    if isinstance(rows, (pa.Table, pa.RecordBatch)):
        table = rows if isinstance(rows, pa.Table) else pa.Table.from_batches([rows])
        return spark.createDataFrame(table.combine_chunks())  # Spark makes a partition of each chunk, however small
    return spark.createDataFrame(list(rows), schema)


#: Bytes and batches of a stream that the driver holds before they go to the shared folder.
HELD_BYTES, HELD_BATCHES = 1 << 25, 1 << 16


def _held(stream: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The batches of a stream, as many together as may be held."""
    held, size = [], 0
    for batch in stream:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD_BYTES or len(held) >= HELD_BATCHES:
            yield held
            held, size = [], 0
    if held:
        yield held


def batches(spark: SparkSession, stream: Iterable[pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """The rows of a stream of Arrow batches of one schema, read once, to its end.

    What comes goes to the shared folder in files of about ``HELD_BYTES``, so the driver never holds the whole; a stream without
    batches is an empty table.
    """
    path = scratch(spark, "batches")
    spark.createDataFrame([], schema).write.parquet(path)
    for held in _held(stream):
        spark.createDataFrame(pa.Table.from_batches(held).combine_chunks(), schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
