"""Plumbing shared by the corpus operators: code shipping, lineage cuts, sorted runs."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "gridspan_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder; a lost executor then costs a re-read, not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: below the one the session names in spark.checkpoint.dir.

    Only on a single machine, as in tests, a temporary one is made where that is unset. It is removed when the application ends.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
        _file_system(spark, sc._jsc.sc().getCheckpointDir().get(), lambda fs, path: fs.deleteOnExit(path))
    return sc._jsc.sc().getCheckpointDir().get()


def _file_system(spark: SparkSession, folder: str, act: Callable) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    act(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)


class Scratch:
    """Compressed tables in the shared folder. Spark knows their sizes, so it broadcasts small ones by itself.

    They are removed when the block ends, or without a block when the application does.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4()}"
        self.tables = 0
        _file_system(spark, self.folder, lambda fs, path: (fs.mkdirs(path), fs.deleteOnExit(path)))

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        df.write.parquet(path := f"{self.folder}/{self.tables}", compression="zstd")
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_: object) -> None:
        _file_system(self.spark, self.folder, lambda fs, path: fs.delete(path, True))


def at_most(rows: DataFrame, most: int, *keys: Column | str) -> DataFrame:
    """Those of rows whose hash of keys falls into buckets that together hold at most `most` rows: the same rows in every run."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(4096)).cast("int")
    counts = {r["b"]: r["count"] for r in rows.groupBy(bucket.alias("b")).count().collect()}
    kept, left = [], most
    for b in sorted(counts):
        if counts[b] <= left:
            kept.append(b)
            left -= counts[b]
    return rows if len(kept) == len(counts) else rows.where(bucket.isin(kept))


def tidy(each: Callable) -> Callable:
    """A function for mapInArrow that in the end gives freed memory back to the system, as its worker lives on beside others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def binary_list(column: pa.Array) -> list[bytes | None]:
    """Strings of an Arrow column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For group sizes: the group of each element, and its place within that group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def tiled(rows: DataFrame, bucket: str, spread: str, size: int) -> DataFrame:
    """Split buckets of more than `size` rows into pairs of chunks, so no task needs a whole bucket.

    Adds long columns `chunk` and `tile`, the tile of chunks a <= b being a * 2^31 + b; rows of a (bucket, tile)
    group number at most about twice `size`, and any two rows of a bucket share at least one tile. Rows of
    small buckets are not copied.
    """
    hot = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size)
    hot = hot.select(bucket, F.ceil(F.col("_n") / size).cast("long").alias("_k"))
    dealt = rows.join(hot, bucket, "left").withColumn("_k", F.coalesce("_k", F.lit(1).cast("long")))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(F.lit("tile"), F.col(spread)), F.col("_k")))
    dealt = dealt.withColumn("_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    tile = F.least("chunk", "_x") * (1 << 31) + F.greatest("chunk", "_x")
    return dealt.withColumn("tile", tile).drop("_k", "_x")


def sorted_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bring equal keys together and in order, for a streaming pass with runs()."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables made of whole runs of equal long keys, with the start of each run (and the end of the last)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        starts = _starts(table, keys)
        if len(starts) > 1:
            whole = int(starts[-1])
            yield table.slice(0, whole), starts
            rest = table.slice(whole).combine_chunks()
            held = rest.to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(_starts(table, keys), table.num_rows)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        x = table[key].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b: (member, smallest member), without the smallest itself."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def in_groups(texts: list, size: int) -> Iterator[list]:
    """Consecutive texts (bytes or None) of about `size` bytes together."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t or b"")
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group
