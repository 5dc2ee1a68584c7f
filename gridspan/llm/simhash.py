"""SimHash near-duplicates, linked exactly through anchors of a covering code.

A covering code of radius R has a codeword (an anchor) within R bits of every word. Two fingerprints at
most T bits apart therefore meet at the first one's nearest anchor when the second is sent to every anchor
within R + T bits. The code used is a product of binary Golay codes (23 bits, 4096 anchors, R = 3, each word
having exactly one nearest anchor) and single bits (R = 0), in one of two layouts:

* halves: a link of at most 2 bits leaves one 32-bit half with at most 1, so each half is covered with T = 1
  (21-bit anchors, about 29 copies of a fingerprint);
* whole: all 64 bits are covered with T = 2 (42-bit anchors, about 390 copies), for so many distinct
  fingerprints that the anchors of a half would become crowded.

Both find every link; only the amount of work differs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.llm.common import binary_list, cut, forest, ragged, runs, ship, sorted_runs, tidy, tiled
from gridspan.llm.components import connected_components

#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0xC75
RADIUS = 3
#: Blocks of each layout: (first bit, bits, Golay?), and the number of bits that may differ in it.
HALVES = [([(0, 23, True), (23, 9, False)], 1), ([(32, 23, True), (55, 9, False)], 1)]
WHOLE = [([(0, 23, True), (23, 23, True), (46, 18, False)], 2)]
#: Distinct fingerprints from which the anchors of halves hold too many of them.
CROWDED = 50_000_000
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
BLOCK = 1 << 16
#: Fingerprints of one anchor that are compared in one piece.
TILE = 1024


def word_shingles(text: bytes | None, shingle: int = 3) -> bytes:
    """XXH64 of each word shingle of a UTF-8 text, repeats included, eight bytes each, big-endian.

    A text of fewer words is one shingle, one without words none.
    """
    words = (text or b"").lower().split()
    if not words:
        return b""
    parts = [words] if len(words) <= shingle else zip(*(words[i:] for i in range(shingle)), strict=False)
    digest, join = xxhash.xxh64_digest, b" ".join
    return b"".join([digest(join(p), 42) for p in parts])


def majority(hashes: bytes) -> bytes:
    """The 64-bit SimHash of hashes, big-endian: each bit is 1 if it is in over half of them; of none it is zero."""
    bits = np.frombuffer(hashes, np.uint8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(bits), 8 * BLOCK):
        ones += np.unpackbits(bits[i : i + 8 * BLOCK]).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(bits) // 8).tobytes()


def fingerprint(text: bytes | None, shingle: int = 3) -> bytes:
    """The 64-bit SimHash of a UTF-8 text's word shingles; null and wordless texts give zero."""
    return majority(word_shingles(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) for each row: fp holds the fingerprint's 64 bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b"".join([fingerprint(t, shingle) for t in binary_list(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], ["id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(each), "id long, fp long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of 12-bit halves of a word; error patterns of up to 5 bits and their weights by syndrome; first place of each syndrome."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    of_bit = [syndrome(1 << b) for b in range(23)]
    tables = np.zeros((2, 4096), np.int64)
    for part in range(2):
        for bit in range(12 if part == 0 else 11):
            tables[part] ^= np.where(np.arange(4096) >> bit & 1, of_bit[12 * part + bit], 0)
    found = []
    for weight in range(RADIUS + 3):
        for bits in combinations(range(23), weight):
            s = e = 0
            for b in bits:
                s ^= of_bit[b]
                e |= 1 << b
            found.append((s, weight, e))
    found.sort()
    s, weight, error = np.array(found, np.int64).T
    return tables, error, weight, np.searchsorted(s, np.arange(2049))


def _block(x: np.ndarray, golay: bool, bits: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a block near each word: (place of the word, anchor, bits beyond the radius)."""
    if golay:
        tables, error, weight, first = _golay()
        s = tables[0][x & 4095] ^ tables[1][x >> 12]
        row, place = ragged(first[s + 1] - first[s])
        at = first[s][row] + place
        over = np.maximum(weight[at] - RADIUS, 0)
        keep = over <= most
        return row[keep], (x[row] ^ error[at])[keep] >> 11, over[keep]
    flips = [0] + [sum(1 << b for b in c) for k in range(1, most + 1) for c in combinations(range(bits), k)]
    row = np.repeat(np.arange(len(x)), len(flips))
    return row, x[row] ^ np.tile(np.array(flips, np.int64), len(x)), np.tile([f.bit_count() for f in flips], len(x))


def anchors(fps: np.ndarray, layout: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the fingerprint, anchor, whether it is the nearest one) for every anchor a fingerprint is sent to."""
    out = []
    u = fps.view(np.uint64)
    for part, (blocks, most) in enumerate(layout):
        row, key, over = np.arange(len(u)), np.full(len(u), part, np.int64), np.zeros(len(u), np.int64)
        for low, bits, golay in blocks:
            x = (u >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64)
            r, anchor, extra = _block(x, golay, bits, most)
            counts = np.bincount(r, minlength=len(u))
            first = np.cumsum(counts) - counts
            old, place = ragged(counts[row])
            at = first[row][old] + place
            total = over[old] + extra[at]
            keep = total <= most
            row, over = row[old][keep], total[keep]
            key = (key[old] << (12 if golay else bits) | anchor[at])[keep]
        out.append((row, key, over == 0))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _replicate(layout: list):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i in range(0, len(fp), 4096):
                row, key, home = anchors(fp[i : i + 4096], layout)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[i + row]), pa.array(fp[i + row]), pa.array(home)], ["anchor", "node", "fp", "home"])

    return each


def _compare(threshold: int):
    """Within each anchor, compare every fingerprint at home there with every one sent there; emit spanning stars."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["anchor", "tile"]):
            size = np.diff(starts)
            end = np.repeat(starts[1:], size)
            node, home = table["node"].to_numpy(), table["home"].to_numpy(zero_copy_only=False)
            fp = table["fp"].to_numpy().view(np.uint64)
            a = b = np.zeros(0, np.int64)
            left, step = np.flatnonzero(np.arange(len(end)) + 1 < end), 1
            while len(left):
                near = np.bitwise_count(fp[left] ^ fp[left + step]) <= threshold
                near &= home[left] | home[left + step]
                a, b = np.concatenate([a, node[left[near]]]), np.concatenate([b, node[left[near] + step]])
                if len(a) > 1_000_000:
                    a, b = forest(a, b)
                step += 1
                left = left[left + step < end[left]]
            a, b = forest(a, b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

    return each


def link(nodes: DataFrame, threshold: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Spanning links (src, dst) among nodes(node, fp), fp being distinct: the same components as all links within `threshold` bits."""
    if threshold != 2:
        raise ValueError("the covering layouts are made for a threshold of 2 bits")
    layout = WHOLE if nodes.count() > crowded else HALVES
    ship(nodes.sparkSession)
    sent = nodes.select("node", "fp").mapInArrow(tidy(_replicate(layout)), "anchor long, node long, fp long, home boolean")
    dealt = sorted_runs(tiled(sent, "anchor", "node", TILE), ["anchor", "tile"])
    return dealt.mapInArrow(tidy(_compare(threshold)), "src long, dst long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """(id, fp, component) for each row of docs, component being the smallest id reachable over links of at most `threshold` bits.

    Null texts count as empty; texts without words have fingerprint zero and link like any other. Equal
    fingerprints become one node before any comparison, so copies cost nothing. Rows of one id are one
    document. A row without id takes the component of its fingerprint, null if no row with an id has it, and
    makes no links itself. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("node")))
    named = nodes.where(F.col("node").isNotNull())
    same = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    twice = rows.join(same.select("id"), "id", "left_semi").join(named, "fp").select(F.col("id").alias("src"), F.col("node").alias("dst"))
    found = connected_components(link(named, threshold).union(twice))
    final = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return rows.join(final, "fp").select("id", "fp", "component")
