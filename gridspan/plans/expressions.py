"""Expressions and predicates as small immutable trees: built by operators, kept as JSON, compiled to Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

INTEGRAL = (ByteType, ShortType, IntegerType, LongType)


def plain(value: Any) -> Any:
    """numpy scalars and arrays as Python values, for JSON and literals."""
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def wrap(value: Any) -> Expr:
    if isinstance(value, Expr):
        return value
    if callable(value):
        raise ValueError("functions cannot be kept in an expression")
    return Scalar(plain(value))


class Expr:
    """Something with a value in each row."""

    name: str | None = None

    def __add__(self, other: Any) -> Arithmetic:
        return Arithmetic(self, "+", wrap(other))

    def __radd__(self, other: Any) -> Arithmetic:
        return Arithmetic(wrap(other), "+", self)

    def __sub__(self, other: Any) -> Arithmetic:
        return Arithmetic(self, "-", wrap(other))

    def __rsub__(self, other: Any) -> Arithmetic:
        return Arithmetic(wrap(other), "-", self)

    def __mul__(self, other: Any) -> Arithmetic:
        return Arithmetic(self, "*", wrap(other))

    def __rmul__(self, other: Any) -> Arithmetic:
        return Arithmetic(wrap(other), "*", self)

    def __truediv__(self, other: Any) -> Arithmetic:
        return Arithmetic(self, "/", wrap(other))

    def __rtruediv__(self, other: Any) -> Arithmetic:
        return Arithmetic(wrap(other), "/", self)

    def __eq__(self, other: Any) -> Compare:  # type: ignore[override]
        return Compare(self, "=", plain(other))

    def __ne__(self, other: Any) -> Compare:  # type: ignore[override]
        return Compare(self, "!=", plain(other))

    def __lt__(self, other: Any) -> Compare:
        return Compare(self, "<", plain(other))

    def __le__(self, other: Any) -> Compare:
        return Compare(self, "<=", plain(other))

    def __gt__(self, other: Any) -> Compare:
        return Compare(self, ">", plain(other))

    def __ge__(self, other: Any) -> Compare:
        return Compare(self, ">=", plain(other))

    __hash__ = None  # type: ignore[assignment]

    def isin(self, *values: Any) -> Compare:
        return Compare(self, "IN", plain(values[0] if len(values) == 1 and isinstance(values[0], (list, tuple, set)) and not isinstance(values[0], str) else values))

    def between(self, low: Any, high: Any) -> Compare:
        return Compare(self, "BETWEEN", [plain(low), plain(high)])

    def alias(self, name: str) -> Expr:
        return Named(self, name)

    def vector(self, op: str, **args: Any) -> Vector:
        return Vector(op, self, plain_args(args))

    def v_slice(self, start: int | None, stop: int | None = None) -> Vector:
        return self.vector("slice", start=start, stop=stop)

    def v_slice_nd(self, shape: Any, *specs: Any) -> Vector:
        return self.vector("slice_nd", shape=list(shape), specs=[_spec(s) for s in specs])

    def v_reduce(self, method: str = "mean") -> Vector:
        return self.vector("reduce", method=method)

    def v_len(self) -> Vector:
        return self.vector("cardinality")

    def v_transform(self, op: str, value: float | None = None) -> Vector:
        return Vector("transform", self, {"op": op, "value": plain(value)})

    def cosine_sim(self, query: Any) -> Vector:
        return self.vector("cosine", query=query)

    def __getitem__(self, key: Any) -> Vector:
        if not isinstance(key, slice):
            raise TypeError("only slices of array columns are supported")
        return self.v_slice(key.start, key.stop)


def plain_args(args: dict) -> dict:
    return {k: plain(v) for k, v in args.items()}


def _spec(s: Any) -> Any:
    return ["slice", s.start, s.stop, s.step] if isinstance(s, slice) else ["slice", *s, None] if isinstance(s, tuple) else int(s)


@dataclass(frozen=True, eq=False)
class ColumnRef(Expr):
    name: str

    def to_json(self) -> dict:
        return {"type": "column_ref", "name": self.name}


@dataclass(frozen=True, eq=False)
class Scalar(Expr):
    value: Any

    def to_json(self) -> dict:
        return {"type": "scalar", "value": self.value}


@dataclass(frozen=True, eq=False)
class Arithmetic(Expr):
    left: Expr
    op: str
    right: Expr

    def to_json(self) -> dict:
        return {"type": "arithmetic_expr", "left": self.left.to_json(), "op": self.op, "right": self.right.to_json()}


@dataclass(frozen=True, eq=False)
class Vector(Expr):
    """A vector operation on an expression; chains nest."""

    op: str
    source: Expr
    args: dict = field(default_factory=dict)

    def to_json(self) -> dict:
        return {"type": "vector", "op": self.op, "source": self.source.to_json(), "args": self.args}


@dataclass(frozen=True, eq=False)
class Named(Expr):
    source: Expr
    name: str

    def to_json(self) -> dict:
        return self.source.to_json()


class Predicate:
    def __and__(self, other: Any) -> Both:
        return Both(self, "AND", parse(other))

    def __or__(self, other: Any) -> Both:
        return Both(self, "OR", parse(other))


@dataclass(frozen=True)
class Compare(Predicate):
    left: Expr
    op: str
    value: Any

    def to_json(self) -> dict:
        value = {"type": "expr", "value": self.value.to_json()} if isinstance(self.value, Expr) else self.value
        return {"type": "compare", "left": self.left.to_json(), "op": self.op, "value": value}


@dataclass(frozen=True)
class Both(Predicate):
    left: Predicate
    op: str
    right: Predicate

    def to_json(self) -> dict:
        return {"type": "logical", "left": self.left.to_json(), "op": self.op, "right": self.right.to_json()}


OPERATORS = ("=", "==", "!=", "<", "<=", ">", ">=", "IN", "BETWEEN")


def parse(given: Any) -> Predicate | None:
    """A predicate from a tree, a (column, op, value) triple, or a list of those with "AND"/"OR" between.

    Lists are read from left to right without precedence; items without a connector are joined by AND. An
    empty list is no condition.
    """
    if given is None or isinstance(given, Predicate):
        return given
    if isinstance(given, tuple) and len(given) == 3 and isinstance(given[0], (str, Expr)):
        op = str(given[1]).upper()
        if op not in OPERATORS:
            raise ValueError(f"unsupported operator: {given[1]}")
        left = ColumnRef(given[0]) if isinstance(given[0], str) else given[0]
        return Compare(left, "=" if op == "==" else op, plain(given[2]))
    if not isinstance(given, (list, tuple)):
        raise ValueError(f"not a predicate: {given!r}")
    out, connector = None, "AND"
    for item in given:
        if isinstance(item, str):
            connector = item.upper()
            if connector not in ("AND", "OR"):
                raise ValueError(f"unknown connector: {item}")
            continue
        p = parse(item)
        if p is not None:
            out = p if out is None else Both(out, connector, p)
        connector = "AND"
    return out


def from_json(d: dict) -> Any:
    kind = d["type"]
    if kind == "column_ref":
        return ColumnRef(d["name"])
    if kind == "scalar":
        return Scalar(d["value"])
    if kind == "arithmetic_expr":
        return Arithmetic(from_json(d["left"]), d["op"], from_json(d["right"]))
    if kind == "vector":
        return Vector(d["op"], from_json(d["source"]), d["args"])
    if kind == "compare":
        value = d["value"]
        return Compare(from_json(d["left"]), d["op"], from_json(value["value"]) if isinstance(value, dict) else value)
    if kind == "logical":
        return Both(from_json(d["left"]), d["op"], from_json(d["right"]))
    raise ValueError(f"unknown node: {kind}")


def references(node: Any) -> set[str]:
    """Names of the columns that an expression or predicate reads."""
    if isinstance(node, ColumnRef):
        return {node.name}
    if isinstance(node, (Arithmetic, Both)):
        return references(node.left) | references(node.right)
    if isinstance(node, (Vector, Named)):
        more = node.args.get("other") if isinstance(node, Vector) else None
        return references(node.source) | ({more} if isinstance(more, str) else set())
    if isinstance(node, Compare):
        return references(node.left) | references(node.value)
    return set()


def compile_expr(node: Any, df: DataFrame) -> Column:
    """A Column over df. Integers divided by integers truncate; fractional division by zero follows IEEE 754."""
    if isinstance(node, Named):
        return compile_expr(node.source, df).alias(node.name)
    if isinstance(node, ColumnRef):
        if node.name not in df.columns:
            raise ValueError(f"unknown column: {node.name}")
        return F.col(f"`{node.name}`")
    if isinstance(node, Scalar):
        return F.lit(node.value)
    if isinstance(node, Vector):
        from gridspan.operators.registry import vector_column

        return vector_column(node.op, compile_expr(node.source, df), node.args)
    if isinstance(node, Arithmetic):
        a, b = compile_expr(node.left, df), compile_expr(node.right, df)
        if node.op in "+-*":
            return {"+": a + b, "-": a - b, "*": a * b}[node.op]
        if node.op != "/":
            raise ValueError(f"unknown operator: {node.op}")
        kinds = [f.dataType for f in df.select(a.alias("a"), b.alias("b")).schema]
        if all(isinstance(k, INTEGRAL) for k in kinds):
            return F.call_function("div", a, b)
        return F.when(b == 0, a * F.lit(math.inf)).otherwise(a / b)
    raise ValueError(f"not an expression: {node!r}")


def compile_predicate(node: Predicate | None, df: DataFrame) -> Column:
    """A boolean Column with SQL's three-valued logic."""
    if node is None:
        return F.lit(True)
    if isinstance(node, Both):
        a, b = compile_predicate(node.left, df), compile_predicate(node.right, df)
        return a & b if node.op == "AND" else a | b
    left = compile_expr(node.left, df)
    if node.op == "IN":
        return left.isin(*node.value) if node.value else F.lit(False)
    if node.op == "BETWEEN":
        return left.between(*node.value)
    right = compile_expr(node.value, df) if isinstance(node.value, Expr) else F.lit(node.value)
    found = {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}
    if node.op not in found:
        raise ValueError(f"unsupported operator: {node.op}")
    return found[node.op]


def col(name: str) -> ColumnRef:
    return ColumnRef(name)
