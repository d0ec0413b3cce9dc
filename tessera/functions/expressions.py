"""Expressions that become Spark columns once the frame they apply to is known.

Most map to one built-in. What needs the frame: a column by position, and division, which truncates for two integers and is
exact otherwise; both give null for a zero divisor, as does the remainder. Output names are those of the operator or
aggregate where no alias is given (``eq``, ``add``, ``SUM``, ``COUNT_DISTINCT``).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column as SparkColumn, DataFrame, functions as F, types as T

from .types import spark_type

__all__ = ["Expression", "col", "column_index", "lit", "cast", "try_cast", "function", "add", "subtract", "multiply", "divide", "modulus", "eq", "neq", "gt", "gteq", "lt", "lteq", "and_", "or_", "not_", "sum_", "min_", "max_", "avg", "count", "count_rows", "count_distinct", "user_aggregate"]


class Expression:
    """A deferred column: ``resolve(df)`` gives the Spark column, ``name(df)`` its output name."""

    def __init__(self, build: Callable[[DataFrame], SparkColumn], name: Callable[[DataFrame], str] | str) -> None:
        self._build, self._name = build, name

    def resolve(self, df: DataFrame) -> SparkColumn:
        return self._build(df)

    def name(self, df: DataFrame) -> str:
        return self._name if isinstance(self._name, str) else self._name(df)

    def named(self, df: DataFrame) -> SparkColumn:
        return self.resolve(df).alias(self.name(df))

    def alias(self, name: str) -> Expression:
        return Expression(self._build, name)

    def cast(self, kind: object) -> Expression:
        return cast(self, kind)

    def __eq__(self, other: object) -> Expression:  # type: ignore[override]
        return eq(self, other)

    def __ne__(self, other: object) -> Expression:  # type: ignore[override]
        return neq(self, other)

    __hash__ = None  # type: ignore[assignment]

    def __gt__(self, other: object) -> Expression:
        return gt(self, other)

    def __ge__(self, other: object) -> Expression:
        return gteq(self, other)

    def __lt__(self, other: object) -> Expression:
        return lt(self, other)

    def __le__(self, other: object) -> Expression:
        return lteq(self, other)

    def __and__(self, other: object) -> Expression:
        return and_(self, other)

    def __or__(self, other: object) -> Expression:
        return or_(self, other)

    def __invert__(self) -> Expression:
        return not_(self)

    def __add__(self, other: object) -> Expression:
        return add(self, other)

    def __sub__(self, other: object) -> Expression:
        return subtract(self, other)

    def __mul__(self, other: object) -> Expression:
        return multiply(self, other)

    def __truediv__(self, other: object) -> Expression:
        return divide(self, other)

    def __mod__(self, other: object) -> Expression:
        return modulus(self, other)


def of(value: object) -> Expression:
    """An expression from an expression, or a literal from a plain value."""
    return value if isinstance(value, Expression) else lit(value)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Expression:
    return Expression(lambda df: df[quoted(name)], name)


def column_index(i: int) -> Expression:
    return Expression(lambda df: df[quoted(df.columns[i])], lambda df: df.columns[i])


def lit(value: object) -> Expression:
    if isinstance(value, bool):
        return Expression(lambda df: F.lit(value), str(value))
    if isinstance(value, int):
        return Expression(lambda df: F.lit(value).cast("bigint"), str(value))
    if isinstance(value, (float, str)):
        return Expression(lambda df: F.lit(value), str(value))
    raise TypeError(f"no literal of {type(value).__name__}")


def cast(e: object, kind: object) -> Expression:
    e = of(e)
    return Expression(lambda df: e.resolve(df).cast(spark_type(kind)), e.name)


def try_cast(e: object, kind: object) -> Expression:
    """A cast that gives null where ``cast`` raises."""
    e = of(e)
    return Expression(lambda df: e.resolve(df).try_cast(spark_type(kind)), e.name)


def function(name: str, *args: object) -> Expression:
    """Any built-in function by its name."""
    return Expression(lambda df: F.call_function(name, *(of(a).resolve(df) for a in args)), name)


def _binary(name: str, build: Callable[[SparkColumn, SparkColumn], SparkColumn]) -> Callable[[object, object], Expression]:
    def make(left: object, right: object) -> Expression:
        a, b = of(left), of(right)
        return Expression(lambda df: build(a.resolve(df), b.resolve(df)), name)

    make.__name__ = name
    return make


eq, neq = _binary("eq", lambda a, b: a == b), _binary("neq", lambda a, b: a != b)
gt, gteq = _binary("gt", lambda a, b: a > b), _binary("gteq", lambda a, b: a >= b)
lt, lteq = _binary("lt", lambda a, b: a < b), _binary("lteq", lambda a, b: a <= b)
and_, or_ = _binary("and", lambda a, b: a & b), _binary("or", lambda a, b: a | b)
add, subtract, multiply = _binary("add", lambda a, b: a + b), _binary("subtract", lambda a, b: a - b), _binary("mult", lambda a, b: a * b)
modulus = _binary("mod", lambda a, b: a % F.nullif(b, F.lit(0).cast("int")))


def divide(left: object, right: object) -> Expression:
    a, b = of(left), of(right)

    def build(df: DataFrame) -> SparkColumn:
        x, y = a.resolve(df), F.nullif(b.resolve(df), F.lit(0).cast("int"))
        kinds = [f.dataType for f in df.select(x.alias("x"), y.alias("y")).schema]
        return F.call_function("div", x, y) if all(isinstance(k, T.IntegralType) for k in kinds) else x / y

    return Expression(build, "div")


def not_(e: object) -> Expression:
    e = of(e)
    return Expression(lambda df: ~e.resolve(df), "not")


def _aggregate(name: str, build: Callable[[SparkColumn], SparkColumn]) -> Callable[[object], Expression]:
    def make(e: object) -> Expression:
        e = of(e)
        return Expression(lambda df: build(e.resolve(df)), name)

    return make


sum_, min_, max_, avg = _aggregate("SUM", F.sum), _aggregate("MIN", F.min), _aggregate("MAX", F.max), _aggregate("AVG", F.avg)
count, count_distinct = _aggregate("COUNT", F.count), _aggregate("COUNT_DISTINCT", F.count_distinct)


def user_aggregate(name: str, reduce: Callable[..., object], kind: object, partial: Callable[..., tuple] | None = None) -> Callable[..., Expression]:
    """An aggregate of one's own: ``reduce`` gets a pandas Series for each argument and gives one value.

    Without ``partial`` these are all values of a group, which meet in one task's memory, as a median needs it. With it, values
    never meet: ``partial`` gets Series of some of a group's values, those of one batch, and gives a tuple of plain values;
    ``reduce`` gets a Series for each place of the tuples, with an entry for each batch that has the group, in any order. Without
    rows and groups the value is null. Built-in aggregates (``function``) combine before the shuffle too.
    """
    if partial is not None:
        return _combined(name, partial, reduce, kind)

    def whole(*values: pd.Series) -> float:  # the hints tell Spark that a group becomes a value, of whatever kind
        return reduce(*values)

    run = F.pandas_udf(whole, spark_type(kind))

    def make(*args: object) -> Expression:
        found = [of(a) for a in args]
        return Expression(lambda df: run(*(a.resolve(df) for a in found)), name)

    return make


def _combined(name: str, partial: Callable[..., tuple], reduce: Callable[..., object], kind: object) -> Callable[..., Expression]:
    """``user_aggregate`` by parts: in each batch the first row of a group carries the state of all its rows there, other rows null.

    What executors run is all inside: they needn't have this package.
    """

    def states(n_keys: int):
        def run(*columns: pa.Array) -> pa.Array:
            import pickle

            import numpy as np

            keys, values = columns[:n_keys], columns[n_keys:]
            group = np.zeros(len(columns[0]), np.int64)
            for key in keys:
                if pa.types.is_nested(key.type):  # equal values look equal; Spark brings together what is kept apart here
                    key = pa.array([repr(k) for k in key.to_pylist()], pa.string())
                codes = np.asarray(key.dictionary_encode("encode").indices)
                group = np.unique(group * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            out: list[bytes | None] = [None] * len(group)
            series = [v.to_pandas(date_as_object=True) for v in values]
            # local times without a zone, as pandas functions get them elsewhere
            series = [s.dt.tz_localize(None) if getattr(s.dtype, "tz", None) else s for s in series]
            for start, end in zip(starts, [*starts[1:], len(order)], strict=True):
                rows = order[start:end]
                state = partial(*(s.iloc[rows].reset_index(drop=True) for s in series))
                out[rows[0]] = pickle.dumps(tuple(x.item() if isinstance(x, np.generic) else x for x in state))
            return pa.array(out, pa.binary())

        return F.arrow_udf(run, T.BinaryType())

    def total(groups: pd.Series) -> pd.Series:
        import pickle

        found = ([pickle.loads(bytes(s)) for s in g] for g in groups)
        return pd.Series([reduce(*(pd.Series(list(place)) for place in zip(*g, strict=True))) if g else None for g in found], dtype=object)

    total = F.pandas_udf(total, spark_type(kind))

    def make(*args: object) -> Expression:
        found = [of(a) for a in args]

        def build(df: DataFrame) -> SparkColumn:
            keys = grouping(df)
            return total(F.collect_list(states(len(keys))(*keys, *(a.resolve(df) for a in found))))

        return Expression(build, name)

    return make


def grouped(df: DataFrame, keys: list[Expression]) -> DataFrame:
    """The rows of ``df`` as a frame that tells aggregates what it is grouped by."""
    out = df.select("*")
    out._tessera_keys = [k.resolve(out) for k in keys]
    return out


def grouping(df: DataFrame) -> list[SparkColumn]:
    """The keys of a frame made by ``grouped``."""
    found = getattr(df, "_tessera_keys", None)
    if found is None:
        raise ValueError("an aggregate by parts belongs into an aggregation")
    return found


def count_rows() -> Expression:
    """Rows, nulls or not: COUNT(*)."""
    return Expression(lambda df: F.count(F.lit(1)), "COUNT")
