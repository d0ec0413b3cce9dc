"""EngineContext: readers, a catalog of named frames, and SQL.

SQL is Spark's, with cast targets of the dialect (INT64, INT32, LONG, BOOL, VARCHAR, FLOAT64 and so on) mapped to Spark's
names. Names live in the session's temporary views; contexts on one session share them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from os import PathLike

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from .. import sources
from ..functions.types import TYPES
from .frame import Frame
from .result import Result

#: Quoted text or a comment (left alone), or a cast target that Spark doesn't know.
_TOKEN = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|\b(as)(\s+)(int8|int16|int32|int64|uint8|uint16|uint32|uint64|float32|float64|bool|utf8|varchar(?!\s*\())(\s*\))""", re.I | re.S)


def dialect(text: str) -> str:
    def fix(m: re.Match[str]) -> str:
        return m[0] if m[1] is None else f"{m[1]}{m[2]}{TYPES[m[3].lower()].simpleString()}{m[4]}"

    return _TOKEN.sub(fix, text)


#: The engine's own settings and their defaults; names that start with ``spark.sql.`` go to the session.
SETTINGS = {"csv.batch_size": 1024}


class EngineContext:
    """``settings``: ``csv.batch_size``, the most rows of a batch of ``execute_batches``, and any ``spark.sql.`` setting."""

    def __init__(self, spark: SparkSession, settings: dict[str, object] | None = None) -> None:
        self.spark, self.settings = spark, dict(SETTINGS)
        for name, value in (settings or {}).items():
            if name.startswith("spark.sql."):
                spark.conf.set(name, str(value))
            elif name not in SETTINGS:
                raise ValueError(f"no setting {name!r}; there are {', '.join(SETTINGS)} and those of spark.sql")
            self.settings[name] = value

    def sql(self, text: str) -> Frame:
        return Frame(self.spark.sql(dialect(text)))

    def csv(self, path: str | PathLike[str], header: bool = True, schema: T.StructType | str | None = None, sep: str | None = None) -> Frame:
        return Frame(sources.csv(self.spark, path, header, schema, sep))

    def parquet(self, path: str | PathLike[str]) -> Frame:
        return Frame(sources.parquet(self.spark, path))

    def memory(self, rows: pa.Table | list[object], schema: T.StructType | str | None = None) -> Frame:
        return Frame(sources.memory(self.spark, rows, schema))

    def batches(self, stream: Iterable[pa.RecordBatch], schema: T.StructType) -> Frame:
        """The rows of a stream of Arrow batches, through the shared folder, so that the driver never holds them all."""
        return Frame(sources.batches(self.spark, stream, schema))

    def table(self, name: str) -> Frame:
        return Frame(self.spark.table(name))

    def register(self, name: str, frame: Frame | DataFrame) -> None:
        """Names a frame; an earlier one of the name is replaced."""
        (frame.df if isinstance(frame, Frame) else frame).createOrReplaceTempView(name)

    def register_csv(self, name: str, path: str | PathLike[str], **options: object) -> None:
        self.register(name, self.csv(path, **options))  # type: ignore[arg-type]

    def register_parquet(self, name: str, path: str | PathLike[str]) -> None:
        self.register(name, self.parquet(path))

    def source(self, source: sources.DataSource, projection: list[str] | None = None) -> Frame:
        """The rows of an own source; its scan gets the projection and the comparisons that a filter makes."""
        return Frame(sources.custom(self.spark, source, projection))

    def register_data_source(self, name: str, source: sources.DataSource) -> None:
        self.register(name, self.source(source))

    def execute(self, frame: Frame | DataFrame) -> Result:
        return Result(frame.df if isinstance(frame, Frame) else frame)

    def execute_batches(self, frame: Frame | DataFrame) -> Iterator[pa.RecordBatch]:
        """The rows as a stream of batches; the driver holds one partition at a time."""
        return self.execute(frame).batches(int(self.settings["csv.batch_size"]))
