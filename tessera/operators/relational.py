"""Projection, filter, aggregate and join. Each is one logical node; Catalyst chooses the strategy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.expressions import Expression, col, grouped, quoted


def _all(items: Sequence[Expression | str]) -> list[Expression]:
    return [col(i) if isinstance(i, str) else i for i in items]


def project(df: DataFrame, items: Sequence[Expression | str]) -> DataFrame:
    return df.select(*(e.named(df) for e in _all(items)))


def filter_rows(df: DataFrame, predicate: Expression) -> DataFrame:
    """Rows whose predicate is true; the predicate must be boolean."""
    c = predicate.resolve(df)
    kind = df.select(c.alias("p")).schema[0].dataType
    if not isinstance(kind, T.BooleanType):
        raise ValueError(f"a filter needs a boolean, not {kind.simpleString()}")
    return df.where(c)


def aggregate(df: DataFrame, groups: Sequence[Expression | str], aggregates: Sequence[Expression]) -> DataFrame:
    """Group columns, then aggregates. Without groups: one row, also for an empty input."""
    df = grouped(df, _all(groups))
    aggs = [a.named(df) for a in aggregates]
    keys = [g.named(df) for g in _all(groups)]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def suffixed(left: Sequence[str], right: Sequence[str]) -> list[str]:
    """Names of the right side beside those of the left: a name in use gets ``_right``, then ``_right2`` and so on."""
    used, out = set(left), []
    for name in right:
        new, n = name, 1
        while new in used:
            new = f"{name}_right" if n == 1 else f"{name}_right{n}"
            n += 1
        used.add(new)
        out.append(new)
    return out


def column_of(df: DataFrame, name: str) -> str:
    """The column of that name, else the only one that differs in case, as the engine finds names elsewhere."""
    if name in df.columns:
        return name
    found = [c for c in df.columns if c.lower() == name.lower()]
    if len(found) != 1 or df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        raise ValueError(f"{'several columns' if found else 'no column'} {name!r} among {df.columns}")
    return found[0]


def join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join that keeps all columns of both sides, both copies of the keys; null keys never match."""
    if len(left_on) != len(right_on) or not left_on:
        raise ValueError("a join needs as many keys on the left as on the right, and one at least")
    left_on, right_on = ([column_of(df, n) for n in names] for names, df in ((left_on, left), (right_on, right)))
    names = suffixed(left.columns, right.columns)
    renamed = right.toDF(*names)
    to = dict(zip(right.columns, names, strict=True))
    on = reduce(lambda a, b: a & b, (F.col(f"l.{quoted(a)}") == F.col(f"r.{quoted(to[b])}") for a, b in zip(left_on, right_on, strict=True)))
    return left.alias("l").join(renamed.alias("r"), on, how)
