"""Own sources: a schema and a scan, read on the executors through Spark's Python data source interface.

Comparisons of a column with a value reach the scan, so that it can skip what it needn't read; Spark filters its rows again,
so a scan may ignore them. The scan is asked for the columns that were named when the source was read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource as SparkDataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass(frozen=True)
class Comparison:
    """``column sign value``, with sign one of = > >= < <=."""

    column: str
    sign: str
    value: object


class DataSource(Protocol):
    """A source of rows. It must pickle; ``splits`` says how many tasks may share the scan."""

    def schema(self) -> T.StructType | str: ...

    def scan(self, projection: Sequence[str], filters: Sequence[Comparison], split: int = 0) -> Iterator[pa.RecordBatch]: ...


class _Reader(DataSourceReader):
    def __init__(self, source: DataSource, columns: list[str]) -> None:
        self.source, self.columns, self.filters = source, columns, []

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            if type(f) in _SIGNS and len(f.attribute) == 1:
                self.filters.append(Comparison(f.attribute[0], _SIGNS[type(f)], f.value))
            yield f  # Spark applies it too

    def partitions(self):
        return [InputPartition(k) for k in range(getattr(self.source, "splits", 1))]

    def read(self, partition):
        for batch in self.source.scan(self.columns, self.filters, partition.value):
            yield batch.select(self.columns)


def custom(spark: SparkSession, source: DataSource, projection: Sequence[str] | None = None) -> DataFrame:
    """The rows of a source: all columns, or those of ``projection`` in its order; an unknown one is an error."""
    kind = source.schema()
    kind = T.StructType.fromDDL(kind) if isinstance(kind, str) else kind
    columns = list(projection or kind.names)
    if missing := [c for c in columns if c not in kind.names]:
        raise ValueError(f"no column {missing[0]!r} among {kind.names}")
    narrow = T.StructType([kind[c] for c in columns])
    label = f"tessera_{uuid.uuid4().hex}"

    class Registered(SparkDataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> T.StructType:
            return narrow

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Reader(source, columns)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Registered)
    return spark.read.format(label).load()
