"""Near copies by SimHash, completed to all documents of which four fifths or more of the word shingles are the same.

At a similarity of 0.8 about 10 of 64 SimHash bits differ, too many for a covering code, so fingerprints that link
at 2 bits only give the first candidates. The others come from prefixes: with all shingles in one order, two sets of
Jaccard similarity 0.8 or more share one of the first n - ceil(0.8 n) + 1 of each, n being the set's size. Shingles
often met in a sample of documents come last in that order, which changes how many candidates there are but never
which links are found. Every link, however proposed, is verified on the whole sets, and no pair of that similarity is missed.

Candidates of a shingle are first compared with one pivot each, then each component by its pair with the sketches most alike,
which joins large groups of near copies by few comparisons; only pairs still in different components are then all compared. Parity sketches
as wide as the sets are large tell nearly all unlike pairs apart without their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from gridspan.llm import simhash
from gridspan.llm.common import Scratch, at_most, binary_list, runs, ship, sorted_runs, tidy, tiled
from gridspan.llm.components import connected_components

WORDS = 5
#: Documents sampled for common shingles, the least number of them that makes a shingle common, and the most common shingles kept.
SAMPLE, COMMON, MOST = 20_000, 4, 1 << 18
#: Nodes of one shingle that are compared in one piece.
TILE = 1024
#: Rounds at most in which components are joined by their pairs most alike, before all pairs that are left are compared.
NEAREST = 1
#: Pairs looked at together.
PAIRS = 1 << 18
#: Bytes of a set's parity sketch: two bits or more for each shingle, within these bounds.
LEAST, WIDEST = 32, 1024

#: Columns that a row's set of shingles gets: its hash, size, fingerprint, prefix and sketch.
ADDED = [
    StructField("_sig", LongType()), StructField("_size", IntegerType()), StructField("_fp", LongType()),
    StructField("_prefix", ArrayType(LongType())), StructField("_parity", BinaryType()),
]


def shingles(text: bytes | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's word shingles; a text of fewer words is one shingle, one without words none."""
    return np.unique(np.frombuffer(simhash.word_shingles(text, width), ">u8").astype(np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have Jaccard similarity 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles by the lowest bits of their hashes: two sketches differ in no more bits than the sets do in shingles."""
    bits = 8 * min(max(LEAST, 1 << max(2 * len(s) - 1, 0).bit_length() >> 3), WIDEST)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(sketches: list[bytes], size: int = LEAST) -> np.ndarray:
    """The sketches as rows of 64-bit words, all narrowed to `size` bytes."""
    out = np.zeros((len(sketches), size // 8), np.uint64)
    widths = np.array(list(map(len, sketches)), np.int64)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        x = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint64).reshape(len(at), int(w) // size, size // 8)
        out[at] = np.bitwise_xor.reduce(x, axis=1)
    return out


def may_be_alike(size_a: np.ndarray, size_b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """False only where sets of these sizes, with sketches that differ in so many bits, cannot be alike."""
    return (5 * np.minimum(size_a, size_b) >= 4 * np.maximum(size_a, size_b)) & (9 * differ <= size_a + size_b)


def differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits pairs of sketches differ, the wider narrowed to the other."""
    out = np.zeros(len(a), np.int64)
    widths = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w).tolist()
        out[at] = np.bitwise_count(fold([a[i] for i in at], int(w)) ^ fold([b[i] for i in at], int(w))).sum(axis=1, dtype=np.int64)
    return out


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles of the set, common ones last and otherwise by hash."""
    size = len(s) - (4 * len(s) + 4) // 5 + 1 if len(s) else 0
    if len(common) and size:
        often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        s = np.concatenate([s[~often], s[often]])
    return s[:size]


def common_shingles(docs: DataFrame, text_col: str, id_col: str) -> np.ndarray:
    """Sorted hashes of at most MOST shingles that are met in COMMON or more documents of a bounded sample."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in binary_list(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], ["token"])

    few = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    few = at_most(few, SAMPLE, "id", "text")
    counts = few.select("text").mapInArrow(tidy(each), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "token").limit(MOST).select("token").toArrow()["token"].to_numpy()
    return np.sort(found.view(np.uint64))


def _sets(place: int, held):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        for b in batches:
            sig, size, fp, first, parity = [], [], [], [], []
            for t in binary_list(b.column(place)):
                hashes = simhash.word_shingles(t, WORDS)
                s = np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))
                sig.append(xxhash.xxh64_intdigest(s.tobytes(), 42))
                size.append(len(s))
                fp.append(simhash.majority(hashes))
                first.append(prefix(s, common).view(np.int64))
                parity.append(sketch(s))
            more = [
                pa.array(np.array(sig, np.uint64).view(np.int64)),
                pa.array(size, pa.int32()),
                pa.array(np.frombuffer(b"".join(fp), ">i8").astype(np.int64)),
                pa.array(first, pa.list_(pa.int64())),
                pa.array(parity, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *(f.name for f in ADDED)])

    return each


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (src, dst, a, b) whose texts a and b are alike."""
    last, held = None, np.zeros(0, np.uint64)
    for b in batches:
        src, dst, keep = b.column(0).to_pylist(), b.column(1).to_pylist(), []
        for i, (x, y) in enumerate(zip(binary_list(b.column(2)), binary_list(b.column(3)), strict=True)):
            if dst[i] != last:
                last, held = dst[i], shingles(y)
            if alike(shingles(x), held):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in keep], pa.int64()) for c in (src, dst)], ["src", "dst"])


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (src, dst, both sizes, both sketches) that may be alike."""
    for b in batches:
        a, c = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3))
        near = may_be_alike(a, c, differing(*(b.column(k).to_pylist() for k in (4, 5))))
        yield b.select(["src", "dst"]).filter(pa.array(near))


def linked(pairs: DataFrame, sets: DataFrame, rows: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """Those of pairs(src, dst) whose sets are alike: first by their sketches, then by whole texts."""
    for side in ("src", "dst"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("size").alias(f"{side}_n"), F.col("parity").alias(f"{side}_p")), side)
    pairs = pairs.select("src", "dst", "src_n", "dst_n", "src_p", "dst_p").mapInArrow(tidy(_screen), "src long, dst long")
    pairs = scratch.write(pairs)
    needed = scratch.write(pairs.select(F.explode(F.array("src", "dst")).alias("_row")).distinct())
    texts = scratch.write(rows.join(needed, "_row", "left_semi").select(F.col("_row").alias("node"), F.col(text_col).alias("text")))
    a, b = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("src", "a"), ("dst", "b")))
    pairs = pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b")
    return scratch.write(pairs.mapInArrow(tidy(_verify), "src long, dst long"))


def _candidates(nearest: bool):
    """Within each shingle, pairs of nodes of different components that may be alike: for each component that with the most alike sketches, or all."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Near copies meet in many shingles; a task tells each pair once, or once in so many.
        found = np.zeros((2, 0), np.int64)
        for table, starts in runs(batches, ["token", "tile"]):
            end = np.repeat(starts[1:], np.diff(starts))
            node, component, size = (table[c].to_numpy() for c in ("node", "component", "size"))
            size, wide = size.astype(np.int64), table["parity"].to_pylist()
            parity = fold(wide)
            best, partner = np.full(len(end), np.inf), np.full(len(end), -1)
            left, step = np.flatnonzero(np.arange(len(end)) + 1 < end), 1
            while len(left):
                for i in range(0, len(left), PAIRS):
                    x = left[i : i + PAIRS]
                    y = x + step
                    x, y = (z[component[x] != component[y]] for z in (x, y))
                    near = may_be_alike(size[x], size[y], np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64))
                    x, y = x[near], y[near]
                    differ = differing([wide[k] for k in x.tolist()], [wide[k] for k in y.tolist()])
                    near = may_be_alike(size[x], size[y], differ)
                    x, y, far = x[near], y[near], (differ / np.maximum(size[x] + size[y], 1))[near]
                    if nearest:
                        for a, b in ((x, y), (y, x)):
                            less = far < best[a]
                            best[a[less]], partner[a[less]] = far[less], b[less]
                    elif len(x):
                        found = _joined(found, node[x], node[y])
                        if found.shape[1] > PAIRS:
                            yield _pairs(found)
                            found = found[:, :0]
                step += 1
                left = left[left + step < end[left]]
            # Of each component in each shingle only its best pair.
            group = np.repeat(starts[:-1], np.diff(starts))
            order = np.lexsort((best, component, group))
            first = np.ones(len(order), bool)
            first[1:] = (component[order][1:] != component[order][:-1]) | (group[order][1:] != group[order][:-1])
            has = order[first]
            has = has[partner[has] >= 0]
            found = _joined(found, node[has], node[partner[has]])
        yield _pairs(found)

    return each


def _joined(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([found, np.stack([np.minimum(a, b), np.maximum(a, b)])], axis=1), axis=1)


def _pairs(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["src", "dst"])


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs's columns with _row, a number for each row, and _component: rows linked by similarities of 0.8 or more share one.

    Null texts count as empty; texts without words share a component. Rows, not ids, are compared: equal sets of shingles
    are one node before any comparison, so copies cost nothing, and rows of one id or without id are like others. Very long texts
    are compared whole. Columns of docs called like those added are replaced. An empty table gives no rows. The rows lie in the
    session's checkpoint folder until the application ends.
    """
    spark = docs.sparkSession
    docs = docs.drop("_row", "_component", *(f.name for f in ADDED))
    ship(spark)
    scratch = Scratch(spark)
    held = spark.sparkContext.broadcast(common_shingles(docs, text_col, id_col))
    rows = docs.mapInArrow(tidy(_sets(docs.columns.index(text_col), held)), StructType([*docs.schema.fields, *ADDED]))
    rows = scratch.write(rows.withColumn("_row", F.monotonically_increasing_id()))
    # Equal sets are one node, which one row stands for.
    nodes = scratch.write(rows.groupBy("_sig").agg(F.min("_row").alias("node")))
    one = rows.join(nodes.select(F.col("node").alias("_row")), "_row", "left_semi")
    sets = scratch.write(one.select(F.col("_row").alias("node"), *(F.col(f"_{c}").alias(c) for c in ("size", "fp", "prefix", "parity"))))
    # Fingerprints within 2 bits, one set standing for each, and the sets of equal fingerprints.
    prints = scratch.write(sets.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")))
    same = sets.join(prints.where("n > 1").select("fp", F.col("node").alias("dst")), "fp").where("node <> dst").select(F.col("node").alias("src"), "dst")
    near = simhash.link(prints.select("node", "fp")).union(same)
    # Sets that share a shingle of their prefixes, each against the shingle's pivot.
    by_token = Window.partitionBy("token")
    item = F.struct("node", "size")
    tokens = sets.select(F.explode("prefix").alias("token"), "node", "size")
    tokens = tokens.withColumns({"pivot": F.min(item).over(by_token), "other": F.max("node").over(by_token)})
    tokens = scratch.write(tokens.where("pivot.node <> other").drop("other"))
    fits = 5 * F.least("size", "pivot.size") >= 4 * F.greatest("size", "pivot.size")
    pivots = tokens.where("node <> pivot.node").where(fits).select(F.col("node").alias("src"), F.col("pivot.node").alias("dst"))
    pairs = near.union(pivots).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    links = linked(pairs, sets, rows, text_col, scratch)
    # In shingles that nodes of several components share, each component's pair with the sketches most alike, then all pairs left.
    rest, rounds = tokens.select("token", "node"), 0
    while True:
        found = scratch.write(connected_components(links))
        rest = rest.select("token", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rest = rest.withColumns({"least": F.min("component").over(by_token), "most": F.max("component").over(by_token)})
        rest = scratch.write(rest.where("least <> most").drop("least", "most"))
        nearest = rounds < NEAREST
        dealt = tiled(rest, "token", "node", TILE).join(sets.select("node", "size", "parity"), "node")
        dealt = sorted_runs(dealt.select("token", "tile", "node", "component", "size", "parity"), ["token", "tile"])
        pairs = dealt.mapInArrow(tidy(_candidates(nearest)), "src long, dst long").distinct()
        new = linked(pairs, sets, rows, text_col, scratch)
        if nearest:
            # Once nothing more is found this way, all pairs that are left are compared.
            rounds = NEAREST if new.isEmpty() else rounds + 1
        links = links.union(new)
        if not nearest:
            break
    found = scratch.write(connected_components(links))
    groups = nodes.join(found, "node", "left").select("_sig", F.coalesce("component", "node").alias("_component"))
    return rows.join(groups, "_sig").select(*docs.columns, "_row", "_component")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies left: the one with the smallest id, or one without id if none has any."""
    rows = similar_rows(docs, id_col, text_col)
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row")))
    kept = rows.select(id_col, "_row", "_component").groupBy("_component").agg(best.alias("best")).select(F.col("best.row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)
