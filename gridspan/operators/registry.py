"""Operations by name: steps kept as plain dictionaries and applied to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridspan.operators import vector as v

_COLUMNS: dict[str, Callable[..., Column]] = {
    "cosine": lambda x, query: v.cosine_query(x, query),
    "cosine_with": lambda x, other: v.cosine_pair(x, F.col(other)),
    "slice": v.slice_1d,
    "slice_nd": v.slice_nd,
    "reduce": v.reduce_array,
    "cardinality": v.cardinality,
    "transform": v.transform_elements,
    "concat": lambda x, other: v.concat_arrays(x, F.col(other)),
    "matrix": v.matrix,
    "scalar": v.scalar_op,
}


def vector_column(op: str, source: Column, args: dict) -> Column:
    if op not in _COLUMNS:
        raise ValueError(f"unknown vector operation: {op}")
    return _COLUMNS[op](source, **args)


def _named(build: Callable[..., tuple[str, Column]]) -> Callable[..., DataFrame]:
    def step(df: DataFrame, **args) -> DataFrame:
        name, column = build(**args)
        return df.withColumn(name, column)

    return step


def _pairwise(symbol: str, f: Callable[[Column, Column], Column]) -> Callable[..., DataFrame]:
    return _named(lambda a, b, name=None: (name or f"{a}_{symbol}_{b}", f(F.col(a), F.col(b))))


#: Steps from DataFrame to DataFrame, with the default names of their results.
_STEPS: dict[str, Callable[..., DataFrame]] = {
    "cosine_similarity_query": _named(lambda column, query, name="cosine_sim": (name, v.cosine_query(F.col(column), query))),
    "cosine_similarity": _named(
        lambda left, right, name="cosine_sim": (
            name,
            v.cosine_pair(F.col(left[0]), F.col(right[0])) if len(left) == len(right) == 1 else v.cosine_columns([F.col(c) for c in left], [F.col(c) for c in right]),
        )
    ),
    "slice": _named(lambda column, start, stop=None, name=None: (name or f"{column}_slice_1d", v.slice_1d(F.col(column), start, stop))),
    "slice_nd": _named(lambda column, shape, specs, name=None: (name or f"{column}_slice_nd", v.slice_nd(F.col(column), shape, specs))),
    "reduce": _named(lambda column, method="mean", name=None: (name or f"{column}_{method}", v.reduce_array(F.col(column), method))),
    "cardinality": _named(lambda column, name=None: (name or f"{column}_len", v.cardinality(F.col(column)))),
    "element_transform": _named(lambda column, transform, value=None, name=None: (name or f"{column}_{transform}", v.transform_elements(F.col(column), transform, value))),
    "concat": _named(lambda a, b, name=None: (name or f"{a}_cat_{b}", v.concat_arrays(F.col(a), F.col(b)))),
    "matrix": _named(lambda column, width, name=None: (name or f"{column}_matrix", v.matrix(F.col(column), width))),
    "scalar_op": _named(lambda column, operation, value, name=None: (name or f"{column}_{operation}_{value}", v.scalar_op(F.col(column), operation, value))),
    "element_wise_add": _pairwise("plus", lambda a, b: a + b),
    "element_wise_sub": _pairwise("minus", lambda a, b: a - b),
    "element_wise_mul": _pairwise("mul", lambda a, b: a * b),
    "sum": _named(lambda columns, name=None: (name or "sum_" + "_".join(columns), v.sum_columns([F.col(c) for c in columns]))),
    "product": _named(lambda columns, name=None: (name or "prod_" + "_".join(columns), v.product_columns([F.col(c) for c in columns]))),
    "weighted_sum": _named(lambda columns, weights, name="weighted_sum": (name, v.weighted_sum([F.col(c) for c in columns], weights))),
    "filter_by_index": lambda df, column, index, condition, bound: df.filter(v.element_is(F.col(column), index, condition, bound)),
    "filter_range": lambda df, column, start, stop, condition, bound, quantifier="ANY": df.filter(v.any_element(F.col(column), start, stop, condition, bound, quantifier)),
    "unnest": lambda df, column: v.unnest(df, column),
}


#: Steps that keep some rows as they are, and steps that add a column to each row.
_FILTERS = {"filter_by_index", "filter_range"}
_ADDING = set(_STEPS) - _FILTERS - {"unnest"}


def keeps_columns(step: dict, columns: list[str]) -> bool:
    """Whether a step is known to treat each row by itself and to leave these columns as they are."""
    return step["op"] in _FILTERS or step["op"] in _ADDING and step.get("name") is not None and step["name"] not in columns


def register(name: str, step: Callable[..., DataFrame]) -> None:
    """Make step(df, **args) available by name."""
    _STEPS[name] = step
    _FILTERS.discard(name)
    _ADDING.discard(name)


def apply_step(df: DataFrame, step: dict) -> DataFrame:
    """Apply {"op": name, **args}; an empty list of columns leaves df as it is."""
    args = {k: x for k, x in step.items() if k != "op"}
    if step["op"] not in _STEPS:
        raise ValueError(f"unknown operation: {step['op']}")
    return df if args.get("columns") == [] else _STEPS[step["op"]](df, **args)


def apply_arrow(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: StructType | str) -> DataFrame:
    """Run a function from Arrow table to Arrow table on each batch; it may add columns and drop or multiply rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from f(pa.Table.from_batches([b])).to_batches()

    return df.mapInArrow(each, schema)
