"""Document fingerprints that subtract: invertible Bloom lookup sketches of paragraph digests.

A text is the multiset of its passages: lines, cut at sentence ends and every WORDS words. Each passage, with
the number of its occurrence, has a 64-bit digest; a sketch adds every digest to one cell in each of its three
parts. A fingerprint is such a sketch written as a string. Subtracting two fingerprints leaves the digests they do not
share, and peeling cells that hold a single one recovers them. When peeling gets stuck, both texts are sketched again
with GROW times the cells, until it does not.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.llm.common import ship, tidy

PARTS = 3
#: Cells in each part of the sketch that is returned as a fingerprint.
WIDTH = 8
WORDS = 16
#: Times the cells of a sketch after peeling got stuck.
GROW = 4
#: Rows of a range that is put in order by one task, about; ranges at most; rows of a shuffle partition, about.
RANGE_ROWS = 1000
MOST_RANGES = 20_000
PARTITION_ROWS = 10_000
#: A cell as it is written, with the bits of the check sum that are.
_CELL = np.dtype([("count", "<i4"), ("keys", "<u8"), ("checks", "<u4")])
_LOW = np.uint64(0xFFFFFFFF)
_SENTENCE = re.compile(rb"(?<=[.!?])[\x20\t]+|[\n\r]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def passages(text: bytes) -> Iterator[bytes]:
    at = 0
    for cut in _SENTENCE.finditer(text):
        yield from _sixteens(text[at : cut.start()])
        at = cut.end()
    yield from _sixteens(text[at:])


def _sixteens(part: bytes) -> Iterator[bytes]:
    words = part.split()
    for i in range(0, len(words), WORDS):
        yield b" ".join(words[i : i + WORDS])


def digests(text: bytes) -> np.ndarray:
    """Distinct 64-bit digests of the passages; the k-th copy of a passage has a digest of its own."""
    seen: dict[int, int] = {}
    out = array("Q")
    for p in passages(text):
        first = xxhash.xxh64_intdigest(p, 0)
        k = seen[first] = seen.get(first, -1) + 1
        out.append(xxhash.xxh64_intdigest(p, k) if k else first)
    return np.unique(np.frombuffer(out, np.uint64))


def _hash(x: np.ndarray, k: int) -> np.ndarray:
    y = x * _MIX[k]
    y = (y ^ y >> np.uint64(31)) * _MIX[3]
    return y ^ y >> np.uint64(29)


def _cells(keys: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Places of each digest's PARTS cells in sketches of `width` cells a part that lie one behind the other."""
    cell = [(_hash(keys, k) >> np.uint64(11 * k)) % np.uint64(width) for k in range(PARTS)]
    return np.stack([owner * (PARTS * width) + k * width + c.astype(np.int64) for k, c in enumerate(cell)])


class Sketches:
    """Counts, digest sums and check sums (modulo 2^64) of `n` sketches of PARTS x width cells."""

    def __init__(self, n: int, width: int) -> None:
        self.n, self.width = n, width
        self.count = np.zeros(n * PARTS * width, np.int64)
        self.keys, self.checks = np.zeros_like(self.count, np.uint64), np.zeros_like(self.count, np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        """Add (sign 1) or take out (-1) digests of the sketches `owner`."""
        at = _cells(keys, owner, self.width).ravel()
        np.add.at(self.count, at, np.tile(sign, PARTS))
        np.add.at(self.keys, at, np.tile(sign.astype(np.uint64) * keys, PARTS))
        np.add.at(self.checks, at, np.tile(sign.astype(np.uint64) * _hash(keys, 0), PARTS))

    def texts(self, sizes: np.ndarray) -> list[str]:
        """Of each sketch the number of digests, then in base 64 count, digest sum and low check bits of its cells."""
        cells = np.rec.fromarrays([self.count, self.keys, self.checks & _LOW], dtype=_CELL)
        raw, step = cells.tobytes(), cells.itemsize * PARTS * self.width
        return [f"{k}:{base64.b64encode(raw[i * step : (i + 1) * step]).decode()}" for i, k in enumerate(sizes.tolist())]

    @classmethod
    def parse(cls, fingerprints: list[str]) -> tuple[Sketches, np.ndarray]:
        """Sketches of one width, and their numbers of digests, from their strings."""
        parts = [f.split(":") for f in fingerprints]
        cells = np.frombuffer(b"".join([base64.b64decode(p[1]) for p in parts]), _CELL)
        out = cls(len(parts), len(cells) // (PARTS * max(len(parts), 1)))
        out.count, out.keys, out.checks = (cells[c].astype(x.dtype) for c, x in zip(("count", "keys", "checks"), (out.count, out.keys, out.checks), strict=True))
        return out, np.array([int(p[0]) for p in parts], np.int64)

    def subtract(self, other: Sketches) -> None:
        self.count -= other.count
        self.keys -= other.keys
        self.checks -= other.checks

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests recovered from differences: (digest, owner, sign), and which owners got stuck."""
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            keys = sign.astype(np.uint64) * self.keys[at]
            right = (sign.astype(np.uint64) * self.checks[at] ^ _hash(keys, 0)) & _LOW == 0
            keys, owner, sign = keys[right], at[right] // (PARTS * self.width), sign[right]
            order = np.lexsort((keys, owner))
            keys, owner, sign = keys[order], owner[order], sign[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            if not len(keys):
                break
            found.append((keys[new], owner[new], sign[new]))
            self.add(keys[new], owner[new], -sign[new])
        rest = ((self.count != 0) | (self.keys != 0) | (self.checks & _LOW != 0)).reshape(self.n, -1).any(axis=1)
        return *(np.concatenate(x) for x in zip(*found, strict=True)), rest


def subtracted(first: list[str], second: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What pairs of fingerprints tell by themselves: (digest, pair, sign: 1 only in the first), and which pairs got stuck."""
    (a, _), (b, _) = Sketches.parse(first), Sketches.parse(second)
    a.subtract(b)
    return a.peel()


def differences(first: list[str], second: list[str], keys_a: list[np.ndarray], keys_b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of digests only in the first and only in the second of each pair of texts.

    They are recovered from the fingerprints; where peeling those gets stuck, from ever larger sketches of the digests.
    """
    n = len(first)
    only = np.zeros((2, n), np.int64)
    _, owner, sign, stuck = subtracted(first, second)
    width, todo = WIDTH, np.arange(n)
    while True:
        done = ~stuck
        for side, s in enumerate((1, -1)):
            only[side, todo[done]] = np.bincount(owner[sign == s], minlength=len(todo))[done]
        todo, width = todo[stuck], width * GROW
        if not len(todo):
            return only[0], only[1]
        found, step = [], max(1, (1 << 20) // width)
        for i in range(0, len(todo), step):
            part = todo[i : i + step]
            sketches = Sketches(len(part), width)
            for side, s in ((keys_a, 1), (keys_b, -1)):
                sizes = [len(side[k]) for k in part]
                keys = np.concatenate([side[k] for k in part])
                sketches.add(keys, np.repeat(np.arange(len(part)), sizes), np.full(len(keys), s))
            _, owner, sign, rest = sketches.peel()
            found.append((owner + i, sign, rest))
        owner, sign, stuck = (np.concatenate(x) for x in zip(*found, strict=True))


def likenesses(first: list[str], second: list[str], keys_a: list[np.ndarray], keys_b: list[np.ndarray]) -> list[float]:
    """Share of common passages among all of each pair of texts, from the difference of their fingerprints; 1 if neither has any."""
    if not first:
        return []
    only_a, only_b = differences(first, second, keys_a, keys_b)
    shared = np.array([int(f.split(":")[0]) for f in first]) - only_a
    total = shared + only_a + only_b
    return np.where(total > 0, shared / np.maximum(total, 1), 1.0).tolist()


def sketch_texts(keys: list[np.ndarray], width: int = WIDTH) -> list[str]:
    sizes = np.array([len(k) for k in keys], np.int64)
    out = Sketches(len(keys), width)
    joined = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    out.add(joined, np.repeat(np.arange(len(keys)), sizes), np.ones(len(joined), np.int64))
    return out.texts(sizes)


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (range, id, text, guest): each row but the guests, with the row after it."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: list[tuple] = []  # (range, id, text, guest, digests), the last one waiting for the row after it
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            for where, doc, text, guest in zip(*(c.to_pylist() for c in part.columns), strict=True):
                held.append((where, doc, text, guest, digests(text.encode())))
            pairs = [(a, b) for a, b in zip(held, held[1:], strict=False) if a[0] == b[0] and not a[3]]
            held = held[-1:]
            if not pairs:
                continue
            edited = [a[2][: len(a[2]) - len(a[2]) // 3] + b[2][: len(a[2]) // 3] for a, b in pairs]
            raw = [e.encode() for e in edited]
            old, new, after = [a[4] for a, _ in pairs], [digests(e) for e in raw], [b[4] for _, b in pairs]
            own, other = sketch_texts(old), sketch_texts(new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[1] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in raw]),
                    pa.array(own),
                    pa.array(other),
                    pa.array(likenesses(own, other, old, new)),
                    pa.array(likenesses(own, sketch_texts(after), old, after)),
                ],
                names,
            )


def compare_editions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """For every row of docs: its fingerprint, that of its edited text, and how alike they are.

    Gives (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Rows are ordered
    by descending id, nulls last, ties by text hash, and each is paired with the row after it, the last with
    the first. The edited text has the last third of the row's code points replaced by the first as many of
    the next row. A null text counts as empty; two texts without passages have likeness 1. An only row is its
    own next. Other columns are left out. An empty table gives no rows.

    Rows are dealt into ranges of ids at quantiles, an id with very many rows into several by text hash; the first rows of each
    range are also sent to the end of the one before as guests, so one pass over each sorted range sees every pair. The
    number of ranges is bounded.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce(-F.col("id"), F.lit(_LAST)).alias("minus"), F.xxhash64("text").alias("h"), "id", "text")
    keys, total = rows.select("minus", "h"), rows.count()
    count = min(MOST_RANGES, max(1, total // range_rows))
    cuts = keys.select(F.col("minus").cast("double")).approxQuantile("minus", [i / count for i in range(1, count)], 0.1 / count) if count > 1 else []
    edges = np.sort(np.array(cuts, np.float64))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_range(edges, b)), *b.columns], ["range", "minus", "h"])

    first = keys.mapInArrow(tidy(dealt), "range long, minus long, h long").groupBy("range").agg(F.min(F.struct("minus", "h")).alias("first")).collect()
    first = sorted((r["range"], r["first"]["minus"], r["first"]["h"]) for r in first)
    host = {(m, h): first[i - 1][0] for i, (_, m, h) in enumerate(first)}  # the first range's rows go to the last one

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(sorted(m for m, _ in host), np.int64)
        for b in batches:
            x, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            names = ["range", "guest", *b.schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(_range(edges, b)), pa.array(np.zeros(len(x), bool)), *b.columns], names)
            at = [i for i in np.flatnonzero(np.isin(x, starts)).tolist() if (int(x[i]), int(h[i])) in host]
            if at:
                more = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([host[int(x[i]), int(h[i])] for i in at], pa.int64()), pa.array(np.ones(len(at), bool)), *more.columns], names)

    keyed = rows.mapInArrow(tidy(place), "range long, guest boolean, minus long, h long, id long, text string")
    parts = max(total // PARTITION_ROWS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = keyed.repartition(min(parts, MOST_RANGES), "range").sortWithinPartitions("range", "guest", "minus", "h")
    kinds = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return keyed.select("range", "id", "text", "guest").mapInArrow(tidy(_pair_up), kinds)


#: Place of rows without id.
_LAST = (1 << 63) - 1


def _range(edges: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
    """Number of the range of each row (minus, h, ...). Between equal edges, which one value fills, rows are dealt by h."""
    exact, h = b.column(0).to_numpy(), b.column(1).to_numpy()
    x = exact.astype(np.float64)
    low, high = np.searchsorted(edges, x, "left"), np.searchsorted(edges, x, "right")
    # Numbers that are equal only as doubles keep their order: they lie before the others.
    alone = (np.abs(x) < 2.0**53) | (exact == _LAST)
    part = np.minimum(((h.astype(np.float64) + 2.0**63) / 2.0**64 * (high - low)).astype(np.int64), high - low - 1)
    return np.where(high > low, low + 1 + np.where(alone, part, 0), high).astype(np.int64)
