"""Folding recorded updates and deletes into the plan of a read."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.plans.expressions import compile_expr, compile_predicate, from_json

TID = "__tid"


def make_patch(tid: int, operation: str, predicate: Any, updates: dict | None) -> dict:
    return {
        "tid": tid,
        "operation": operation,
        "predicate": None if predicate is None else predicate.to_json(),
        "updates": {name: e.to_json() for name, e in (updates or {}).items()},
    }


def fold(df: DataFrame, patches: list[dict]) -> DataFrame:
    """Apply each patch once, in order, to the rows written before it.

    A condition that is null matches nothing. All values of an update are computed from the row before it and
    cast to the column's type.
    """
    for patch in patches:
        predicate = None if patch["predicate"] is None else from_json(patch["predicate"])
        hit = F.coalesce((F.col(TID) < patch["tid"]) & compile_predicate(predicate, df), F.lit(False))
        if patch["operation"] == "delete":
            df = df.filter(~hit)
            continue
        kinds = {f.name: f.dataType for f in df.schema}
        df = df.withColumns({n: F.when(hit, compile_expr(from_json(e), df).cast(kinds[n])).otherwise(F.col(f"`{n}`")) for n, e in patch["updates"].items()})
    return df


def patched_columns(patches: list[dict]) -> set[str]:
    return {name for p in patches for name in p["updates"]}
