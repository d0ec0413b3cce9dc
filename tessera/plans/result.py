"""Result: what a frame gives once it runs. Each call reads the frame anew, so no limit sticks to a later call."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def _packed(size: int, limit: int = 1 << 20):
    """A row for each part of a batch, its Arrow stream. What executors run is all inside: they needn't have this package."""

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """In order, cut at multiples of ``size`` until a part has at most ``limit`` bytes or ``size`` rows."""
        if batch.num_rows <= size or batch.nbytes <= limit:
            yield batch
        else:
            half = max(1, batch.num_rows // size // 2) * size
            yield from parts(batch.slice(0, half))
            yield from parts(batch.slice(half))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch) if batch.num_rows else ():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as stream:
                    stream.write_batch(part)
                yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    return run


class Result:
    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def collect(self, limit: int | None = None) -> list[dict[str, object]]:
        """Rows as dicts; of equal names the last wins."""
        return [dict(zip(self.df.columns, r, strict=True)) for r in (self.df if limit is None else self.df.limit(limit)).collect()]

    def scalar(self) -> object:
        """The first value of the first row, None without rows."""
        row = self.df.first()
        return None if row is None else row[0]

    def to_pandas(self) -> pd.DataFrame:
        return self.df.toPandas()

    def to_batches(self) -> list[pa.RecordBatch]:
        """All batches at once, in the driver's memory; see ``batches``."""
        return self.df.toArrow().to_batches()

    def batches(self, size: int = 1024) -> Iterator[pa.RecordBatch]:
        """Batches of at most ``size`` rows. The driver holds those of one partition at a time.

        They travel many together, about a megabyte, and are cut in the driver: small ones cost no message each.
        """
        if size < 1:
            raise ValueError(f"a batch has one row at least, not {size}")
        for row in self.df.mapInArrow(_packed(size), "batch binary").toLocalIterator():
            with pa.ipc.open_stream(row["batch"]) as stream:
                for part in stream:
                    for at in range(0, part.num_rows, size):
                        yield part.slice(at, size)

    def to_markdown(self, limit: int | None = None, truncate: bool = False) -> str:
        """A pipe table; with ``truncate``, values of over 30 characters are cut to 27 and dots."""
        return self._table((self.df if limit is None else self.df.limit(limit)).collect(), truncate)

    def _table(self, rows: list, truncate: bool) -> str:
        text = lambda v: "" if v is None else str(v)
        cut = lambda s: s[:27] + "..." if truncate and len(s) > 30 else s
        table = [list(self.df.columns), *([cut(text(v)).replace("|", "\\|") for v in r] for r in rows)]
        width = [max(3, *(len(r[i]) for r in table)) for i in range(len(self.df.columns))]
        line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, width, strict=True)) + " |"
        return "\n".join([line(table[0]), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, table[1:])])

    def show(self, limit: int = 20, truncate: bool = True) -> None:
        """Prints the first rows; one job, which reads one row beyond the limit to tell whether there are more."""
        rows = self.df.limit(limit + 1).collect()
        print(self._table(rows[:limit], truncate))
        print(f"(first {limit} rows)" if len(rows) > limit else f"({len(rows)} rows)")

    def csv_lines(self, header: bool = True) -> Iterator[str]:
        """Lines of delimited text, quoted where needed; null is written ``null``. Rows stream through the driver."""

        def field(v: object) -> str:
            s = "null" if v is None else str(v)
            return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n\r') else s

        if header:
            yield ",".join(map(field, self.df.columns)) + "\n"
        for r in self.df.toLocalIterator():
            yield ",".join(map(field, r)) + "\n"

    def to_csv(self, header: bool = True) -> str:
        """The lines of ``csv_lines`` as one text, in the driver's memory."""
        return "".join(self.csv_lines(header))

    def __iter__(self) -> Iterator[dict[str, object]]:
        return (r.asDict() for r in self.df.toLocalIterator())

    def __len__(self) -> int:
        return self.df.count()

    def __repr__(self) -> str:
        return f"Result({', '.join(f'{n}: {t}' for n, t in self.df.dtypes)})"
