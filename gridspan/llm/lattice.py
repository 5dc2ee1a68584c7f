"""Embedding near-duplicates by E8 lattice hashing, every reported link being verified by cosine.

Each table projects unit vectors to some blocks of eight dimensions by a fixed random matrix, shifts and scales
them, and decodes each block to the nearest point of the lattice E8; the points of all blocks name a cell. A
vector is at home in its own cell and probes the nearest of those cells that differ by one of the 240 steps in
one block; two vectors are compared when one's home is among the other's cells in some table. Links found this
way decide the components; links are then counted within each component over all its members, in tiles, so that
no list of pairs is made and a link counts once however many tables hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.llm.common import cut, forest, runs, ship, sorted_runs, tidy, tiled
from gridspan.llm.components import connected_components

TABLES = 12
PROBES = 12
#: Blocks of eight dimensions in a table: each more makes cells rarer, so that fewer unlike vectors meet.
BLOCKS = 2
#: Edge of a lattice cell in units of the projection of a unit vector.
CELL = 1.7
#: Vectors compared in one piece.
TILE = 1024
#: Vectors hashed, or compared with a piece, at a time.
PART = 512
SEED = 20


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers with an even sum)."""
    near = np.rint(x)
    odd = near.sum(axis=1).astype(np.int64) & 1 == 1
    worst = np.abs(x - near).argmax(axis=1)
    at = np.flatnonzero(odd), worst[odd]
    near[at] += np.where(x[at] >= near[at], 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 (D8, or D8 moved by a half in every coordinate)."""
    a, b = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    halves = [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(whole + halves)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, cell: float = CELL, blocks: int = BLOCKS) -> np.ndarray:
    """Long cell numbers of unit vectors, shape (vectors, tables, 1 + probes), the home cell first."""
    dim = unit.shape[1]
    rng = np.random.default_rng([SEED, dim])
    roots, out = _roots(), np.empty((len(unit), tables, 1 + probes), np.int64)
    half = (roots**2).sum(axis=1) / 2
    for t in range(tables):
        x = unit @ rng.standard_normal((dim, 8 * blocks)) / cell + rng.random(8 * blocks)
        mix = rng.integers(1, 2**62, 8 * blocks) * 2 + 1
        home, gaps, steps = np.int64(0), [], []
        for at in (slice(8 * k, 8 * k + 8) for k in range(blocks)):
            point = decode_e8(x[:, at])
            home = home + (np.rint(2 * point).astype(np.int64) * mix[at]).sum(axis=1)
            gaps.append(half - (x[:, at] - point) @ roots.T)
            steps.append((np.rint(2 * roots).astype(np.int64) * mix[at]).sum(axis=1))
        near = np.argpartition(np.concatenate(gaps, axis=1), probes - 1, axis=1)[:, :probes]
        key = np.concatenate([home[:, None], home[:, None] + np.concatenate(steps)[near]], axis=1)
        key ^= key >> 29
        out[:, t] = (key * mix[0] ^ key >> 32) * np.int64(2 * tables + 1) + np.int64(t * 1_000_003 + dim)
    return out


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) for each length of vector in an Arrow list column without nulls."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(d))
        x = x / np.abs(x).max(axis=1, keepdims=True)  # before squaring, against overflow
        yield at, x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(shape: tuple):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column(0).to_numpy()
            for at, x in _units(b.column(1)):
                for i in range(0, len(at), PART):
                    key = cells(x[i : i + PART], *shape)
                    home = np.zeros(key.shape, bool)
                    home[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(node[at[i : i + PART]], key[0].size)), pa.array(home.ravel())], ["cell", "node", "home"])

    return each


def _near(least: float):
    """Within each cell, compare the vectors at home with all that probe it; emit spanning stars of the links."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["cell", "tile"]):
            node, home = table["node"].to_numpy(), table["home"].to_numpy(zero_copy_only=False)
            vectors = table["embedding"].combine_chunks()
            found = []
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if j - i < 2 or not home[i:j].any():
                    continue
                for at, x in _units(vectors.slice(i, j - i)):
                    at = at + i
                    h = np.flatnonzero(home[at])
                    for k in range(0, len(h), PART):
                        a, b = np.nonzero(x[h[k : k + PART]] @ x.T >= least)
                        found.append(forest(node[at[h[k + a]]], node[at[b]]))
            if found:
                a, b = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

    return each


def _count(least: float):
    """Within each tile of a component, count the links of its vectors, weighted by the copies of the other end."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["component", "tile"]):
            node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
            turn, width = table["chunk"].to_numpy(), table["tile"].to_numpy()
            vectors, total = table["embedding"].combine_chunks(), np.zeros(table.num_rows, np.int64)
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                first, second = divmod(int(width[i]), 1 << 31)
                for at, x in _units(vectors.slice(i, j - i)):
                    at = at + i
                    p, q = np.flatnonzero(turn[at] == first), np.flatnonzero(turn[at] == second)
                    for k in range(0, len(p), PART):
                        part = p[k : k + PART]
                        close = x[part] @ x[q].T >= least
                        total[at[part]] += close @ copies[at[q]]
                        if first != second:
                            total[at[q]] += copies[at[part]] @ close
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], ["node", "found"])

    return each


def embedding_groups(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.9,
    tables: int = TABLES,
    probes: int = PROBES,
    cell: float = CELL,
    blocks: int = BLOCKS,
) -> DataFrame:
    """(id, n_links, component, kept) for each row: links of cosine >= least in double precision.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows without id, link with
    nothing. Equal vectors are compared once and counted as often as they occur, repeated rows included.
    Vectors of different lengths never link. kept is id = component. An empty table gives no rows; other columns
    are not looked at, whatever their names.
    """
    ship(rows.sparkSession)
    v, shape = F.col("embedding"), (tables, probes, cell, blocks)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    fine = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # 128 bits of hash stand for a vector wherever rows are grouped or joined.
    key = ["h1", "h2"]
    told = rows.where("fine").select("id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("second"), "embedding").alias("h2"))
    nodes = told.groupBy(*key).agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    sent = cut(nodes.select("node", "embedding").mapInArrow(tidy(_hash(shape)), "cell long, node long, home boolean"))
    shared = sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).where("n > 1 and any")
    met = tiled(sent.join(shared.select("cell"), "cell", "left_semi"), "cell", "node", TILE)
    met = sorted_runs(met.join(nodes.select("node", "embedding"), "node"), ["cell", "tile"])
    links = met.select("cell", "tile", "node", "home", "embedding").mapInArrow(tidy(_near(least)), "src long, dst long")
    groups = cut(connected_components(links).join(nodes.select("node", "least_id", "copies"), "node"))
    firsts = groups.groupBy("component").agg(F.min("least_id").alias("first"))
    members = tiled(groups.select("component", "node", "copies"), "component", "node", TILE).join(nodes.select("node", "embedding"), "node")
    found = sorted_runs(members, ["component", "tile"]).mapInArrow(tidy(_count(least)), "node long, found long")
    found = found.groupBy("node").agg(F.sum("found").alias("found"))
    linked = groups.select("node", "component").join(firsts, "component").join(found, "node").select("node", "first", "found")
    per = nodes.select("node", *key, "least_id", "copies").join(linked, "node", "left")
    per = per.select(*key, (F.coalesce("found", "copies") - 1).alias("n_links"), F.coalesce("first", "least_id").alias("component"))
    out = told.select("id", *key).join(per, key).select("id", "n_links", "component")
    out = out.union(rows.where("not fine").select("id", F.lit(0).cast("long"), "id"))
    return out.withColumn("kept", F.col("id") == F.col("component"))
