"""Frame: an immutable, lazy relation with the engine's verbs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, types as T

from .. import operators
from ..functions.expressions import Expression


class Frame:
    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def project(self, items: Sequence[Expression | str]) -> Frame:
        return Frame(operators.project(self.df, items))

    def filter(self, predicate: Expression) -> Frame:
        return Frame(operators.filter_rows(self.df, predicate))

    def aggregate(self, groups: Sequence[Expression | str], aggregates: Sequence[Expression]) -> Frame:
        return Frame(operators.aggregate(self.df, groups, aggregates))

    def join(self, right: Frame, left_on: Sequence[str], right_on: Sequence[str], how: str = "inner") -> Frame:
        return Frame(operators.join(self.df, right.df, left_on, right_on, how))

    def order_by(self, *names: str, ascending: bool | list[bool] = True) -> Frame:
        return Frame(self.df.orderBy(*names, ascending=ascending))

    def limit(self, n: int) -> Frame:
        return Frame(self.df.limit(n))

    def distinct(self) -> Frame:
        return Frame(self.df.distinct())

    def union(self, other: Frame) -> Frame:
        return Frame(self.df.union(other.df))

    def schema(self) -> T.StructType:
        return self.df.schema

    def logical_plan(self) -> str:
        return self.df._jdf.queryExecution().analyzed().toString()

    def optimized_plan(self) -> str:
        return self.df._jdf.queryExecution().optimizedPlan().toString()

    def physical_plan(self) -> str:
        return self.df._jdf.queryExecution().executedPlan().toString()

    def pretty(self) -> str:
        """The analyzed plan, a node to a line, a tab to a level."""
        lines = self.logical_plan().rstrip("\n").split("\n")
        depth = lambda line: (len(line) - len(line.lstrip(" :+-"))) // 3
        return "\n".join("\t" * depth(line) + line.lstrip(" :+-") for line in lines)

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)
