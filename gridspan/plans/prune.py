"""Partition predicates that follow from a filter.

Spark prunes directories only when a filter names their columns. A filter on a dimension's source column implies
one on the bucket, which is added to it; it never changes the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, DoubleType, FloatType, LongType, StringType, TimestampNTZType, TimestampType

from gridspan.plans.expressions import INTEGRAL, Both, ColumnRef, Compare, Expr, Predicate

TIMES = (TimestampType, TimestampNTZType, DateType)


@dataclass(frozen=True)
class Dimension:
    """A partition column computed from a source column: kind "hash" (bucket number) or "range" (value over interval)."""

    kind: str
    source: str
    size: int

    @property
    def column(self) -> str:
        return f"__{self.kind}_{self.source}"

    def bucket(self, value: Column, kind: DataType) -> Column:
        """Bucket of a value of the source column's type, the same in every session.

        Minus zero counts as zero, as it does in comparisons; NaN, which is the largest number there, has the last range.
        """
        if isinstance(kind, (FloatType, DoubleType)):
            value = F.when(value == 0, F.lit(0).cast(kind)).otherwise(value)
        if isinstance(kind, TIMES) and (self.kind == "range" or not isinstance(kind, DateType)):
            value, kind = _micros(value, kind), LongType()
        size = F.lit(self.size).cast("long")
        if self.kind == "hash":
            if isinstance(kind, INTEGRAL):
                found = F.pmod(value.cast("long"), size)
            else:
                head = F.conv(F.substring(F.sha2(value.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
                found = head % size
            return F.coalesce(found.cast("long"), F.lit(0))
        if isinstance(kind, INTEGRAL):
            value = value.cast("long")
            found = F.call_function("div", value - F.pmod(value, size), size)
        else:
            found = F.floor(value / size)
        if isinstance(kind, (FloatType, DoubleType)):
            found = F.when(F.isnan(value), F.lit(2**63 - 1)).otherwise(found)
        return F.coalesce(found.cast("long"), F.lit(-(2**62)))


def _micros(value: Column, kind: DataType) -> Column:
    """Microseconds since 1970: of an instant, or of a date or wall-clock time as if read in UTC, whatever the session's time zone."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(value)
    day = F.unix_date(value.cast("date")).cast("long") * 86_400_000_000
    if isinstance(kind, DateType):
        return day
    return day + (F.hour(value) * 60 + F.minute(value)).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), value) * 1_000_000).cast("long")


def implied(node: Predicate | None, dims: list[Dimension], kinds: dict[str, DataType]) -> Column | None:
    """What a predicate on base rows says about their buckets; None if nothing."""
    if isinstance(node, Both):
        a, b = implied(node.left, dims, kinds), implied(node.right, dims, kinds)
        if node.op == "AND":
            return b if a is None else a if b is None else a & b
        return None if a is None or b is None else a | b
    if not isinstance(node, Compare) or not isinstance(node.left, ColumnRef) or isinstance(node.value, Expr):
        return None
    out = None
    for dim in dims:
        if dim.source == node.left.name and (found := _of(node.op, node.value, dim, kinds[dim.source])) is not None:
            out = found if out is None else out & found
    return out


def _of(op: str, value: Any, dim: Dimension, kind: DataType) -> Column | None:
    bucket = F.col(dim.column)
    values = value if op in ("IN", "BETWEEN") else [value]
    if op == "!=" or not values or any(not _fits(x, kind) for x in values):
        return None
    # A wall-clock time or date is compared with an instant through the session's time zone, a day away at most.
    slack = F.expr("interval 1 day") if isinstance(kind, (TimestampNTZType, DateType)) and any(isinstance(x, datetime) for x in values) else None
    if slack is not None and dim.kind == "hash":
        return None

    def place(x: Any, way: int = 0) -> Column:
        y = F.lit(x)
        if slack is not None:
            y = y.cast("timestamp") + slack if way > 0 else y.cast("timestamp") - slack
        return dim.bucket(y.cast(kind), kind)

    if op in ("=", "IN"):
        out = None
        for x in values:
            found = bucket == place(x) if slack is None else (bucket >= place(x, -1)) & (bucket <= place(x, 1))
            out = found if out is None else out | found
        return out
    if dim.kind == "hash":
        return None
    if op == "BETWEEN":
        return (bucket >= place(values[0], -1)) & (bucket <= place(values[1], 1))
    return bucket >= place(values[0], -1) if op in (">", ">=") else bucket <= place(values[0], 1)


def _fits(x: Any, kind: DataType) -> bool:
    """Whether the literal can be cast to the column's type, keeping its order among the column's values."""
    if x is None or isinstance(x, bool):
        return False
    if isinstance(kind, INTEGRAL):
        bits = 8 * {"byte": 1, "short": 2, "integer": 4, "long": 8}[kind.typeName()] - 1
        return isinstance(x, int) and -(2**bits) <= x < 2**bits
    if isinstance(kind, StringType):
        return isinstance(x, str)
    if isinstance(kind, (FloatType, DoubleType)):
        return isinstance(x, (int, float)) and (isinstance(x, float) or abs(x) < 2**63)
    if isinstance(kind, DecimalType):
        return isinstance(x, (int, Decimal)) and abs(x) < 10 ** (kind.precision - kind.scale) - 1
    return isinstance(kind, TIMES) and isinstance(x, date)
