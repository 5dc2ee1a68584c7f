"""The functions users build expressions with."""

from gridspan.operators.registry import apply_arrow, apply_step, register
from gridspan.operators.vector import (
    any_element,
    cardinality,
    concat_arrays,
    cosine_columns,
    cosine_pair,
    cosine_query,
    element_is,
    matrix,
    reduce_array,
    scalar_op,
    slice_1d,
    slice_nd,
    sum_columns,
    product_columns,
    transform_elements,
    unnest,
    weighted_sum,
)
from gridspan.plans.expressions import col

__all__ = [
    "any_element", "apply_arrow", "apply_step", "cardinality", "col", "concat_arrays", "cosine_columns", "cosine_pair", "cosine_query",
    "element_is", "matrix", "product_columns", "reduce_array", "register", "scalar_op", "slice_1d", "slice_nd", "sum_columns", "transform_elements",
    "unnest", "weighted_sum",
]
