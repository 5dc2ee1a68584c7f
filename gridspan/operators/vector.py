"""Vector and tensor operations on array columns as Column expressions, evaluated inside the scan's stage."""

from __future__ import annotations

import math
from functools import reduce
from operator import add, mul

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _safe(dot: Column, norms: Column) -> Column:
    """The quotient, 0 where it is undefined."""
    return F.coalesce(F.when(norms > 0, dot / norms), F.lit(0.0))


def cosine_query(x: Column, query: list[float]) -> Column:
    """Cosine of each row's array with a literal; 0 for null, empty or zero arrays; other lengths raise."""
    q = np.asarray(query, np.float32).astype(float)
    norm = float(np.sqrt((q**2).sum()))
    if norm == 0:
        return F.lit(0.0)
    literal = F.array(*map(F.lit, q.tolist()))
    dot = _sum(F.zip_with(x, literal, lambda a, b: a.cast("double") * b))
    norms = F.sqrt(_sum(F.transform(x, lambda a: a.cast("double") * a.cast("double")))) * norm
    wrong = F.raise_error(F.concat(F.lit(f"vectors of {len(q)} elements needed, not "), F.array_size(x).cast("string")))
    return F.when(x.isNull() | (F.array_size(x) == 0), 0.0).when(F.array_size(x) != len(q), wrong.cast("double")).otherwise(_safe(dot, norms))


def cosine_pair(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 for null, empty or zero arrays; unequal lengths raise."""
    norm = lambda x: F.sqrt(_sum(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    wrong = F.raise_error(F.lit("vectors of unequal lengths")).cast("double")
    none = a.isNull() | b.isNull() | (F.array_size(a) == 0) | (F.array_size(b) == 0)
    return F.when(none, 0.0).when(F.array_size(a) != F.array_size(b), wrong).otherwise(_safe(dot, norm(a) * norm(b)))


def cosine_columns(left: list[Column], right: list[Column]) -> Column:
    """Cosine of the vectors made of scalar columns; any null gives 0."""
    if len(left) != len(right) or not left:
        raise ValueError("as many columns are needed on both sides")
    a, b = ([c.cast("double") for c in side] for side in (left, right))
    dot = reduce(add, (x * y for x, y in zip(a, b, strict=True)))
    return _safe(dot, F.sqrt(reduce(add, (x * x for x in a))) * F.sqrt(reduce(add, (y * y for y in b))))


def slice_1d(x: Column, start: int | None, stop: int | None) -> Column:
    """Elements from start up to stop, clipped to the array; null stays null."""
    start = start or 0
    if start < 0 or stop is not None and stop <= start:
        raise ValueError(f"bad slice: {start}:{stop}")
    return F.slice(x, F.lit(start + 1), F.lit(stop - start) if stop is not None else F.lit(2**31 - 1 - start))


def slice_nd(x: Column, shape: list[int], specs: list) -> Column:
    """A row-major tensor's slice as a flat array; axes without a spec are whole. Arrays of another size raise."""
    if not shape:
        raise ValueError("a shape is needed")
    places = np.arange(math.prod(shape)).reshape(shape)
    keys = tuple(slice(*s[1:]) if isinstance(s, list) else s for s in specs)
    flat = np.atleast_1d(places[keys]).ravel().tolist()
    wrong = F.raise_error(F.lit(f"arrays of {math.prod(shape)} elements needed"))
    picked = F.transform(F.array(*map(F.lit, flat)), lambda i: F.get(x, i)) if flat else F.slice(x, F.lit(1), F.lit(0))
    return F.when(x.isNull(), None).when(F.array_size(x) != math.prod(shape), wrong).otherwise(picked)


def reduce_array(x: Column, method: str = "mean") -> Column:
    """mean, sum, min or max within each array; an empty array gives 0, null gives null."""
    if method not in ("mean", "sum", "min", "max"):
        raise ValueError(f"unknown reduction: {method}")
    if method in ("min", "max"):
        found = (F.array_min if method == "min" else F.array_max)(x).cast("double")
    else:
        found = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"), (lambda a: a / F.array_size(x)) if method == "mean" else (lambda a: a))
    return F.when(F.array_size(x) == 0, 0.0).otherwise(found)


def cardinality(x: Column) -> Column:
    return F.array_size(x)


def _holds(value: Column, op: str, bound) -> Column:
    op = op.upper()
    if op == "BETWEEN":
        return value.between(*bound)
    tests = {">": value > bound, ">=": value >= bound, "<": value < bound, "<=": value <= bound, "==": value == bound, "=": value == bound, "!=": value != bound}
    if op not in tests:
        raise ValueError(f"unsupported operator: {op}")
    return tests[op]


def element_is(x: Column, index: int, op: str, bound) -> Column:
    """Whether element `index` holds; null, so no match, when it is null or missing."""
    return _holds(F.get(x, F.lit(index)), op, bound)


def any_element(x: Column, start: int, stop: int, op: str, bound, quantifier: str = "ANY") -> Column:
    """Whether ANY or ALL elements of a slice hold; an empty or null slice never does."""
    if quantifier.upper() not in ("ANY", "ALL"):
        raise ValueError(f"unknown quantifier: {quantifier}")
    part = slice_1d(x, start, stop)
    found = (F.exists if quantifier.upper() == "ANY" else F.forall)(part, lambda v: _holds(v, op, bound))
    return F.coalesce((F.array_size(part) > 0) & found, F.lit(False))


def transform_elements(x: Column, op: str, value: float | None = None) -> Column:
    """add or mul a number, or the natural log (-infinity of 0, NaN of negatives), for each element."""
    if op == "log":
        return F.transform(x, lambda v: F.when(v == 0, -math.inf).when(v < 0, math.nan).otherwise(F.ln(v.cast("double"))))
    if op not in ("add", "mul"):
        raise ValueError(f"unknown transform: {op}")
    return F.transform(x, lambda v: v.cast("double") + F.lit(float(value)) if op == "add" else v.cast("double") * F.lit(float(value)))


def concat_arrays(a: Column, b: Column) -> Column:
    """Both arrays behind each other, null counting as empty."""
    return F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array()))


def matrix(x: Column, width: int) -> Column:
    """The array as an array of rows of `width` elements each; arrays of another size raise, null stays null."""
    if width < 1:
        raise ValueError(f"bad width: {width}")
    wrong = F.raise_error(F.lit(f"arrays of whole rows of {width} elements needed"))
    rows = F.transform(F.sequence(F.lit(1), F.call_function("div", F.array_size(x), F.lit(width)).cast("int")), lambda i: F.slice(x, (i - 1) * width + 1, F.lit(width)))
    none = F.slice(F.array(x), F.lit(1), F.lit(0))
    return F.when(x.isNull(), None).when(F.array_size(x) % width != 0, wrong).when(F.array_size(x) == 0, none).otherwise(rows)


def unnest(df: DataFrame, column: str) -> DataFrame:
    """A row for each element; an empty or null array gives one row with null."""
    return df.withColumn(column, F.explode_outer(column))


def scalar_op(x: Column, op: str, value: float) -> Column:
    """add, sub, mul or div of a column and a number."""
    if op not in ("add", "sub", "mul", "div"):
        raise ValueError(f"unknown operation: {op}")
    if op == "div":
        return x * F.lit(math.inf) if value == 0 else x / F.lit(value)
    return {"add": x + value, "sub": x - value, "mul": x * value}[op]


def sum_columns(columns: list[Column]) -> Column:
    return reduce(add, columns)


def product_columns(columns: list[Column]) -> Column:
    return reduce(mul, columns)


def weighted_sum(columns: list[Column], weights: list[float]) -> Column:
    if len(columns) != len(weights):
        raise ValueError("as many weights as columns are needed")
    return reduce(add, (c * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)))
