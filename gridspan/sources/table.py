"""Tables laid out by coordinates, with merge-on-read updates and deletes.

Rows lie in Parquet files under directories of their write's number and attempt and of their buckets: row chunk and
dimensions. Where that made too many directories, some buckets are columns of the files, which are sorted by them.
Updates and deletes are recorded as small JSON patches and folded into the plan of each read.

A write exists once the description names its attempt; that one file is replaced in one step. What a crash or a
lost executor leaves behind is never named, so never read, and vacuum() removes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gridspan.operators.registry import apply_step
from gridspan.plans.expressions import Predicate, compile_predicate, parse, references, wrap
from gridspan.plans.patches import TID, fold, make_patch, patched_columns
from gridspan.plans.prune import Dimension, implied
from gridspan.sources.files import Files, Lock

META = "_meta/table.json"
#: Partition column of a write's attempt.
TRY = "__try"
#: A write makes so many directories at most, or more if each then holds so many rows on average.
DIRECTORIES, DIRECTORY_ROWS = 1000, 100_000


class Table:
    """One stored table. What it needs to be opened again is all in its folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.files = Files(spark, path)
        if not self.files.exists(META):
            raise FileNotFoundError(path)
        self._cached: dict[tuple, DataFrame] = {}
        self._pinned: dict | None = None
        self._listed: tuple[tuple, DataFrame] | None = None

    @contextmanager
    def pinned(self) -> Iterator[None]:
        """Read the table's description once for what is planned inside, so that it all sees one state."""
        outer = self._pinned
        self._pinned = outer or self.files.read(META)
        try:
            yield
        finally:
            self._pinned = outer

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, chunk_rows: int = 100_000, chunk_cols: int = 32, hash_dims: dict[str, int] | None = None,
        range_dims: dict[str, int] | None = None, global_id: str | None = None,
    ) -> Table:
        files = Files(spark, path)
        if files.exists(META):
            raise FileExistsError(path)
        files.write(
            META,
            {"chunk_rows": chunk_rows, "chunk_cols": chunk_cols, "hash_dims": hash_dims or {}, "range_dims": range_dims or {}, "global_id": global_id or "global_id", "next_id": 0, "tid": 0, "folded": 0, "schema": None, "writes": [], "changes": [], "streams": {}},
        )
        return cls(spark, path)

    @property
    def meta(self) -> dict:
        return self._pinned or self.files.read(META)

    @property
    def dims(self) -> list[Dimension]:
        m = self.meta
        return [*(Dimension("hash", c, n) for c, n in m["hash_dims"].items()), *(Dimension("range", c, n) for c, n in m["range_dims"].items()), Dimension("range", m["global_id"], m["chunk_rows"])]

    @property
    def axes(self) -> list[str]:
        """Columns that positional indexing goes through: hash keys, range keys, the id."""
        m = self.meta
        return [*m["hash_dims"], *m["range_dims"], m["global_id"]]

    @property
    def schema(self) -> StructType:
        kept = self.meta["schema"]
        return StructType.fromJson(kept) if kept else StructType([StructField(self.meta["global_id"], LongType())])

    @property
    def tid(self) -> int:
        return self.meta["tid"]

    def column_groups(self) -> dict[str, int]:
        """Logical group of each column; files hold all of them and readers fetch only what they need."""
        return {f.name: i // self.meta["chunk_cols"] for i, f in enumerate(self.schema)}

    def _frame(self, rows: Any) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows
        if isinstance(rows, dict):
            rows = pa.table(rows)
        if isinstance(rows, (pa.Table, pd.DataFrame)):
            return self.spark.createDataFrame(rows)
        raise TypeError(f"cannot write {type(rows).__name__}")

    def _with_ids(self, df: DataFrame, name: str, first: int, stage: str) -> tuple[DataFrame, int]:
        """Consecutive ids from counts by partition: no global sort, no single task.

        Rows are first written down with their partition and place, so a task that runs again cannot number them anew.
        """
        df.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).write.parquet(f"{self.path}/{stage}")
        df = self.spark.read.parquet(f"{self.path}/{stage}")
        counts = df.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        # One row for each partition of the written rows.
        offsets = counts.select("__part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + first).alias("__first"))
        total = df.count()
        return df.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__first") + F.col("__place")).drop("__part", "__place", "__first"), first + total

    def _layout(self, df: DataFrame) -> list[str]:
        """Buckets of the rows that become directories: all, or those, in order, whose numbers multiply to few enough.

        It reads the rows once more, only the columns that dimensions come from. Numbers are estimates, those of hash buckets
        from a cheaper hash.
        """
        keys = [d.column for d in self.dims]
        counted = [F.pmod(F.xxhash64(F.col(f"`{d.source}`").cast("string")), F.lit(d.size)) if d.kind == "hash" else F.col(d.column) for d in self.dims]
        n, together, *each = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*counted)), *map(F.approx_count_distinct, counted)).first()
        most = max(DIRECTORIES, n // DIRECTORY_ROWS)
        if together <= most:
            return keys
        kept, made = [], 1
        for key, found in zip(keys, each, strict=True):
            if made * found <= most:
                kept, made = [*kept, key], made * found
        return kept

    def _put(self, df: DataFrame, tid: int) -> dict:
        """Write rows as a new attempt, which nothing reads until the description names it; a hot bucket is split over tasks."""
        kinds = {f.name: f.dataType for f in df.schema}
        df = df.withColumns({d.column: d.bucket(F.col(f"`{d.source}`"), kinds[d.source]) for d in self.dims})
        keys, attempt = self._layout(df), str(uuid.uuid4())
        inside = [d.column for d in self.dims if d.column not in keys]
        dealt = df.hint("rebalance", *map(F.col, keys)).sortWithinPartitions(*keys, *inside, self.meta["global_id"])
        dealt.write.partitionBy(*keys).parquet(f"{self.path}/{_folder(tid, attempt)}", compression="zstd")
        return {"tid": tid, "try": attempt, "keys": keys}

    def _commit(self, lock: Lock, before: dict, change: dict) -> None:
        lock.check()
        if self.files.read(META)["tid"] != before["tid"]:
            raise RuntimeError(f"{self.path} was changed by another writer")
        self.files.write(META, before | change)
        self.close()

    def write(self, rows: Any, stream: tuple[str, int] | None = None) -> int:
        """Append rows; returns the write's number. Columns may be added, then they must match.

        A batch of a stream, given as (stream, number), is recorded together with its rows; if it was before, nothing is written.
        """
        df = self._frame(rows)
        with self.files.lock() as lock:
            m, stage = self.files.read(META), f"_staging/{uuid.uuid4()}"
            if stream is not None and m["streams"].get(stream[0], -1) >= stream[1]:
                return m["tid"]
            before, name, tid = dict(m), m["global_id"], m["tid"] + 1
            if missing := [d.source for d in self.dims if d.source not in (*df.columns, name)]:
                raise ValueError(f"dimension columns are missing: {missing}")
            numbered = name not in df.columns
            if numbered:
                df, m["next_id"] = self._with_ids(df, name, m["next_id"], stage)
            if m["schema"]:
                old = StructType.fromJson(m["schema"])
                have = {f.name for f in df.schema}
                df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in old), *(c for c in df.columns if c not in old.names))
            schema = StructType([StructField(f.name, f.dataType) for f in df.schema])
            found = self._put(df, tid)
            streams = m["streams"] | ({} if stream is None else {stream[0]: stream[1]})
            self._commit(lock, before, {"tid": tid, "next_id": m["next_id"], "schema": schema.jsonValue(), "writes": [*m["writes"], found], "streams": streams})
            if numbered:
                self.files.delete(stage)
        return tid

    def patches(self, as_of: int | None = None) -> list[dict]:
        m = self.meta
        return [self.files.read(_patch(t)) for t in m["changes"] if as_of is None or t <= as_of]

    def _stored(self, as_of: int | None = None) -> DataFrame:
        m = self.meta
        if as_of is not None and as_of < m["folded"]:
            raise ValueError(f"snapshot {as_of} ended with the compaction at {m['folded']}")
        full = StructType([*self.schema, StructField(TID, LongType()), StructField(TRY, StringType()), *(StructField(d.column, LongType()) for d in self.dims)])
        writes = [w for w in m["writes"] if as_of is None or w["tid"] <= as_of]
        if not writes:
            return self.spark.createDataFrame([], full)
        if self._listed is not None and self._listed[0] == (writes, full):
            return self._listed[1]
        # Committed attempts never change, so their files are listed once. Spark reads writes together whose directories name the same buckets.
        every, alike = [d.column for d in self.dims], {}
        for w in writes:
            alike.setdefault(tuple(w.get("keys", every)), []).append(f"{self.path}/{_folder(w['tid'], w['try'])}")
        read = self.spark.read.schema(full).option("basePath", f"{self.path}/data")
        df = reduce(DataFrame.unionByName, [read.parquet(*paths) for paths in alike.values()])
        self._listed = ((writes, full), df)
        return df

    def dataframe(self, predicate: Predicate | None = None, as_of: int | None = None, prune: bool = True, later: Predicate | None = None) -> DataFrame:
        """The rows at a snapshot (the newest by default) that satisfy a predicate, with the partition columns.

        `later` is a predicate on stored columns that the caller applies itself further on; here it only helps to skip partitions.
        """
        with self.pinned():
            return self._planned(predicate, as_of, prune, later)

    def _planned(self, predicate: Predicate | None, as_of: int | None, prune: bool, later: Predicate | None = None) -> DataFrame:
        patches = self.patches(as_of)
        df = self._stored(as_of)
        if prune:
            # Buckets describe rows as written; a patched column says nothing about them.
            dims = [d for d in self.dims if d.source not in patched_columns(patches)]
            for p in (predicate, later):
                found = implied(p, dims, {f.name: f.dataType for f in df.schema})
                if found is not None:
                    df = df.filter(found)
        df = fold(df, patches)
        return df if predicate is None else df.filter(compile_predicate(predicate, df))

    def scan(self, filters: Any = None, columns: list[str] | None = None, ops: list | None = None, as_of: int | None = None) -> DataFrame:
        """Filter, then apply ops (named steps or DataFrame functions) in order, then project (all columns by default)."""
        df = self.dataframe(parse(filters), as_of).select(*self.schema.names)
        for op in ops or []:
            df = apply_step(df, op) if isinstance(op, dict) else df.transform(op)
        return df if columns is None else df.select(*columns)

    def candidates(self, filters: Any = None) -> list[str]:
        """Files with rows in the buckets that a filter implies: one name each reaches the driver. Of the files only footers and buckets are read."""
        df, predicate = self._stored(), parse(filters)
        dims = [d for d in self.dims if d.source not in patched_columns(self.patches())]
        found = implied(predicate, dims, {f.name: f.dataType for f in df.schema})
        df = df if found is None else df.filter(found)
        return sorted(r[0] for r in df.select(F.input_file_name()).distinct().collect())

    def valid_ids(self, filters: Any = None) -> DataFrame:
        return self.scan(filters, [self.meta["global_id"]])

    def _record(self, operation: str, predicate: Predicate | None, updates: dict | None, count: bool) -> int | None:
        df = self.dataframe()
        compile_predicate(predicate, df)  # unknown columns fail here, not at a later read
        if unknown := (references(predicate) | set().union(*(references(e) for e in (updates or {}).values()), set(updates or {}))) - set(self.schema.names):
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        n = self.dataframe(predicate).count() if count else None
        with self.files.lock() as lock:
            m = self.files.read(META)
            tid = m["tid"] + 1
            self.files.write(_patch(tid), make_patch(tid, operation, predicate, updates))
            self._commit(lock, m, {"tid": tid, "changes": [*m["changes"], tid]})
        return n

    def update(self, filters: Any, updates: dict[str, Any], count: bool = False) -> int | None:
        """Set columns where the filter is true; values are scalars or expressions of the row before. Optionally counts rows."""
        return self._record("update", parse(filters), {n: wrap(e) for n, e in updates.items()}, count)

    def delete(self, filters: Any = None, count: bool = False) -> int | None:
        """Delete the rows where the filter is true; without one, all of them."""
        return self._record("delete", parse(filters), None, count)

    def compact(self) -> None:
        """Fold all changes into one new write. Older snapshots end here: reading one raises an error."""
        with self.files.lock() as lock:
            m = self.files.read(META)
            found = self._put(self.dataframe().select(*self.schema.names), m["tid"])
            self._commit(lock, m, {"writes": [found], "changes": [], "folded": m["tid"]})

    def vacuum(self) -> None:
        """Remove data, staged rows and changes that no read needs any more, those of writes that never ended included."""
        with self.files.lock():
            m = self.files.read(META)
            named = {_folder(w["tid"], w["try"]) for w in m["writes"]}
            for tid in self.files.names("data"):
                for attempt in self.files.names(f"data/{tid}"):
                    if f"data/{tid}/{attempt}" not in named:
                        self.files.delete(f"data/{tid}/{attempt}")
                if not self.files.names(f"data/{tid}"):
                    self.files.delete(f"data/{tid}")
            self.files.delete("_staging")
            for name in self.files.names("_patches"):
                if f"_patches/{name}" not in map(_patch, m["changes"]):
                    self.files.delete(f"_patches/{name}")

    def cache(self) -> DataFrame:
        """The merged rows of the newest snapshot, kept by Spark until close() or a change."""
        return self._cached.setdefault((self.tid,), self.dataframe().select(*self.schema.names).persist())

    def close(self) -> None:
        for df in self._cached.values():
            df.unpersist()
        self._cached.clear()

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return f(self.scan())


def _folder(tid: int, attempt: str) -> str:
    return f"data/{TID}={tid}/{TRY}={attempt}"


def _patch(tid: int) -> str:
    return f"_patches/{tid:020d}.json"
