"""Sessions over a folder of tables, and lazy frames over one."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.operators.registry import apply_step, keeps_columns
from gridspan.plans.expressions import Both, ColumnRef, Expr, Named, Predicate, compile_expr, compile_predicate, parse, references
from gridspan.sources.table import Table


class Session:
    def __init__(self, spark: SparkSession, base_path: str) -> None:
        self.spark, self.base_path = spark, base_path.rstrip("/")

    def create_dataset(self, name: str, **options: Any) -> Frame:
        return Frame(Table.create(self.spark, f"{self.base_path}/{name}", **options))

    def read(self, name: str, as_of: int | None = None) -> Frame:
        """A frame over a stored table; FileNotFoundError if there is none."""
        return Frame(Table(self.spark, f"{self.base_path}/{name}"), as_of=as_of)


class Frame:
    """An immutable query over a table: a predicate on its rows, then steps from DataFrame to DataFrame."""

    def __init__(self, table: Table, predicate: Predicate | None = None, steps: tuple = (), as_of: int | None = None, rowwise: bool = True, later: Predicate | None = None) -> None:
        self.table, self.predicate, self.steps, self.as_of = table, predicate, steps, as_of
        #: Whether all steps so far treat each row by itself and leave stored columns as they are.
        self.rowwise = rowwise
        #: What later filters say about stored columns of the rows they keep; it helps to skip partitions.
        self.later = later

    def _then(self, step: Any, rowwise: bool = False, later: Predicate | None = None) -> Frame:
        both = later if self.later is None else self.later if later is None else Both(self.later, "AND", later)
        return Frame(self.table, self.predicate, (*self.steps, step), self.as_of, self.rowwise and rowwise, both)

    def df(self) -> DataFrame:
        """The query as a DataFrame."""
        with self.table.pinned():
            out = self.table.dataframe(self.predicate, self.as_of, later=self.later).select(*self.table.schema.names)
        for step in self.steps:
            out = step(out)
        return out

    def filter(self, condition: Any) -> Frame:
        """Keep rows where the condition is true; repeated filters are joined by AND. It may use computed columns."""
        if isinstance(condition, Column):
            return self._then(lambda df: df.filter(condition), True)
        p, step = parse(condition), lambda df: df.filter(compile_predicate(p, df))
        stored = references(p) <= set(self.table.schema.names)
        if not self.steps and stored:
            return Frame(self.table, p if self.predicate is None else Both(self.predicate, "AND", p), (), self.as_of)
        return self._then(step, True, p if stored and self.rowwise else None)

    def select(self, *columns: Any) -> Frame:
        kept = all(isinstance(c, (str, ColumnRef)) or isinstance(c, Named) and c.name not in self.table.schema.names for c in columns)
        return self._then(lambda df: df.select(*(compile_expr(c, df) if isinstance(c, Expr) else c for c in columns)), kept)

    def with_column(self, name: str, expr: Any) -> Frame:
        """Add a computed column; a stored one cannot be replaced."""
        if name in self.table.schema.names:
            raise ValueError(f"{name} is a stored column")
        return self._then(lambda df: df.withColumn(name, compile_expr(expr.source if isinstance(expr, Named) else expr, df) if isinstance(expr, Expr) else expr), True)

    def apply(self, *steps: dict) -> Frame:
        """Apply named operations, each {"op": name, **args}."""
        out = self
        for step in steps:
            out = out._then(lambda df, step=step: apply_step(df, step), keeps_columns(step, self.table.schema.names))
        return out

    def transform(self, f: Any) -> Frame:
        return self._then(lambda df: df.transform(f))

    def limit(self, n: int) -> Frame:
        return self._then(lambda df: df.limit(n))

    def order_by(self, *columns: Any, ascending: bool = True) -> Frame:
        return self._then(lambda df: df.orderBy(*columns, ascending=ascending))

    def top_k(self, column: str, k: int, largest: bool = True) -> Frame:
        """The k rows with the largest (or smallest) values; ties by the id."""
        order = F.desc(column) if largest else F.asc(column)
        name = self.table.meta["global_id"]
        return self._then(lambda df: df.orderBy(order, *([name] if name in df.columns else [])).limit(k))

    def group_by(self, *keys: str) -> Grouped:
        return Grouped(self, "groupBy", keys)

    def rollup(self, *keys: str) -> Grouped:
        return Grouped(self, "rollup", keys)

    def cube(self, *keys: str) -> Grouped:
        return Grouped(self, "cube", keys)

    def agg(self, **aggregates: Column) -> Frame:
        return self._then(lambda df: df.agg(*(c.alias(n) for n, c in aggregates.items())))

    def distinct(self) -> Frame:
        return self._then(lambda df: df.distinct())

    def join(self, other: Frame | DataFrame, on: Any, how: str = "inner") -> Frame:
        return self._then(lambda df: df.join(other.df() if isinstance(other, Frame) else other, on, how))

    def union(self, other: Frame) -> Frame:
        return self._then(lambda df: df.unionByName(other.df(), allowMissingColumns=True))

    def __getitem__(self, key: Any) -> Frame:
        """frame[expr] selects; frame[a, b:c, ...] filters by position along the axes (hash keys, range keys, id).

        A number or text means equality, a slice a half-open range; an ellipsis leaves one axis free.
        """
        if isinstance(key, Expr):
            return self.select(key)
        keys, out = key if isinstance(key, tuple) else (key,), self
        for axis, k in zip(self.table.axes, keys, strict=False):
            if k is Ellipsis:
                continue
            if not isinstance(k, slice):
                out = out.filter((axis, "=", k))
                continue
            if k.start is not None:
                out = out.filter((axis, ">=", k.start))
            if k.stop is not None:
                out = out.filter((axis, "<", k.stop))
        return out

    def write(self, rows: Any) -> int:
        return self.table.write(rows)

    def _changes(self) -> Predicate | None:
        if self.steps or self.as_of is not None:
            raise ValueError("only filters on stored columns of the newest snapshot can precede a change")
        return self.predicate

    def update(self, updates: dict[str, Any], count: bool = False) -> int | None:
        return self.table.update(self._changes(), updates, count)

    def delete(self, count: bool = False) -> int | None:
        return self.table.delete(self._changes(), count)

    def collect(self) -> pa.Table:
        return self.df().toArrow()

    def to_pandas(self) -> pd.DataFrame:
        return self.df().toPandas()

    def show(self, n: int = 5) -> None:
        self.df().show(n)

    def count(self) -> int:
        return self.df().count()

    def explain(self, mode: str = "formatted") -> None:
        """Print what the frame filters by, its steps and changes, then Spark's plan."""
        with self.table.pinned():
            print(f"table: {self.table.path}, snapshot {self.table.tid if self.as_of is None else self.as_of}, changes folded in: {len(self.table.patches(self.as_of))}")
        print(f"filter: {None if self.predicate is None else json.dumps(self.predicate.to_json(), default=str)}")
        print(f"also skipping partitions by: {None if self.later is None else json.dumps(self.later.to_json(), default=str)}")
        print(f"steps: {len(self.steps)}")
        self.df().explain(mode)


class Grouped:
    def __init__(self, frame: Frame, how: str, keys: tuple[str, ...]) -> None:
        self.frame, self.how, self.keys = frame, how, keys

    def agg(self, **aggregates: Column) -> Frame:
        return self.frame._then(lambda df: getattr(df, self.how)(*self.keys).agg(*(c.alias(n) for n, c in aggregates.items())))
