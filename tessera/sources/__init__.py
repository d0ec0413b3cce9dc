"""Sources: delimited text, Parquet files and folders, rows in memory, streams of batches, and own sources."""

from .custom import Comparison, DataSource, custom
from .readers import batches, csv, memory, parquet

__all__ = ["Comparison", "DataSource", "batches", "csv", "custom", "memory", "parquet"]
