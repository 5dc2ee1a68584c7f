"""Packing of documents into training sequences along a space-filling curve.

A document's vector of hashed 4-byte windows is projected to four dimensions; its direction gives a Hilbert
key. Documents are range-sorted by that key, tokenised, and laid end to end along the curve, so neighbours
share sequences. Within a range every sequence is full; what is left at its end is cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.llm.common import binary_list, ship, tidy

DIMENSIONS, BITS = 4, 8
LENGTH = 4096
END = 2
#: Words whose ids a worker remembers; then it keeps those of the texts at hand.
REMEMBERED = 500_000
SEED = 6
#: Ranges of the curve for each shuffle partition, and most rows whose places set their bounds.
RANGES = 4
SAMPLE = 100_000
BLOCK = 1 << 20


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of integer points, shape (n, dimensions), with coordinates of `bits` bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _projection() -> np.ndarray:
    """For each hash of a window its four random coordinates of 0 to 255, in the four 16-bit lanes of a number."""
    lanes = np.random.default_rng(SEED).integers(0, 256, (1 << 16, DIMENSIONS)).astype(np.uint64)
    return (lanes << np.arange(0, 64, 16, np.uint64)).sum(axis=1, dtype=np.uint64)


def curve_keys(texts: list[bytes | None], table: np.ndarray) -> np.ndarray:
    """Hilbert keys of texts; texts of fewer than four bytes lie at the centre."""
    sums, shifts = np.zeros((len(texts), DIMENSIONS)), np.arange(0, 64, 16, np.uint64)
    for k, text in enumerate(texts):
        low = (text or b"").lower()
        for i in range(0, max(len(low) - 3, 0), BLOCK):
            for offset in range(i, min(i + 4, len(low) - 3)):
                grams = np.frombuffer(low, "<u4", (min(len(low), i + BLOCK + 3) - offset) // 4, offset)
                lanes = table[grams * np.uint32(2654435761) >> np.uint32(16)]
                whole = len(lanes) & ~255  # 256 coordinates fit into a lane
                parts = np.append(lanes[:whole].reshape(-1, 256).sum(axis=1, dtype=np.uint64), lanes[whole:].sum(dtype=np.uint64))
                sums[k] += (parts[:, None] >> shifts & np.uint64(0xFFFF)).sum(axis=0) - 127.5 * len(grams)
    size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
    unit = sums / np.where(size > 0, size, 1)
    return hilbert_key(np.minimum(((unit + 1) * (1 << BITS - 1)).astype(np.int64), (1 << BITS) - 1))


class WordTokenizer:
    """Ids of whole texts, put together from remembered ids of their space-separated words.

    The vocabulary drops white space before anything else, so a text's ids are those of its words; a final
    full stop or comma after an ASCII letter is a token of its own there and is split off too.
    """

    SEPARATOR = "<|startoftext|>"
    _letters = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
    _stop = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(self.SEPARATOR)
        self.known: dict[bytes, bytes] = {}
        self.ends = np.zeros(1 << 16, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of words. Words of Latin letters alone end with the one id that holds a word end."""
        plain, rest = [], []
        for w in words:
            (plain if self._letters.fullmatch(w) else rest).append(w)
        for group, glue in ((plain, " "), (rest, self.SEPARATOR)):
            for i in range(0, len(group), 500):
                part = group[i : i + 500]
                joined = glue.join([w.decode("utf-8", "replace") for w in part])
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u2")
                if glue == " ":
                    stops, skip = np.flatnonzero(self.ends[ids]) + 1, 0
                else:
                    stops, skip = np.append(np.flatnonzero(ids == self.separator), len(ids)), 2
                raw, at = ids.tobytes(), 0
                for w, stop in zip(part, (2 * stops).tolist(), strict=True):
                    self.known[w] = raw[at:stop]
                    at = stop + skip

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian 16-bit ids of each text; null counts as empty. Copies are encoded once."""
        split = {}
        for t in dict.fromkeys(texts):
            # A special token's own string must not arise from, or be lost by, lower-casing and splitting.
            split[t] = None if t and b"<|" in t else self._stop.sub(rb" \1", (t or b"").lower()).split()
        distinct, known = set().union(*filter(None, split.values())), self.known
        if len(known) > REMEMBERED:
            known = self.known = {w: known[w] for w in distinct if w in known}
        self.learn([w for w in distinct if w not in known])
        ids = {t: self._encode(t.decode("utf-8", "replace")) if words is None else b"".join(map(known.__getitem__, words)) for t, words in split.items()}
        return [ids[t] for t in texts]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _pieces(parts: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The first `size` ids of a list of (doc, start, ids, total), and the rest."""
    taken, left = [], size
    for k, (doc, start, ids, total) in enumerate(parts):
        n = len(ids)
        if n <= left:
            taken.append((doc, start, ids, total))
            left -= n
            if not left:
                return taken, parts[k + 1 :]
        else:
            taken.append((doc, start, ids[:left], total))
            return taken, [(doc, start + left, ids[left:], total), *parts[k + 1 :]]
    return taken, []


def _pack(path: str, length: int, end: int):
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, sequence = _tokenizer(path), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        waiting: list[tuple] = []
        held = 0

        def put(parts: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for doc, start, ids, total in parts:
                rows.append((doc, start, ids.astype("<u4").tobytes(), total, sequence, at))
                at += len(ids)
            sequence += 1

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), binary_list(batch.column(1))
            for i in range(0, len(docs), 500):
                for doc, raw in zip(docs[i : i + 500], tokenizer.encode(texts[i : i + 500]), strict=True):
                    ids = np.append(np.frombuffer(raw, "<u2"), np.uint16(end))
                    waiting.append((doc, 0, ids, len(ids)))
                    held += len(ids)
                    while held >= length:
                        full, waiting = _pieces(waiting, length)
                        held -= length
                        put(full)
                if rows:
                    yield out()
        while held:
            size = 1 << held.bit_length() - 1
            full, waiting = _pieces(waiting, size)
            held -= size
            put(full)
        if rows:
            yield out()

    return each


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece of a document in a sequence: (id, start, ids, doc_tokens, sequence_id, offset).

    `ids` holds the piece's ids as little-endian unsigned 32-bit numbers, `start` counts the document's ids
    before it, `offset` the ids before it in its sequence. Each document ends with the id `end`; a null or
    empty text is that id alone. Rows are packed one by one, repeated rows and null ids included. Ranges are cut
    by (curve key, row hash), so copies of one text spread over several. An empty table gives no rows.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, edges = _projection(), np.array(bounds, np.int64)
        for b in batches:
            # The curve key, then bits of the row's hash: copies of one text can be cut apart.
            place = curve_keys(binary_list(b.column(1)), table) << 31 | b.column(2).to_numpy() >> 33 & 0x7FFFFFFF
            part = np.searchsorted(edges, place, "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(part)], ["id", "text", "tie", "place", "part"])

    spark = docs.sparkSession
    ship(spark)
    kinds = "id long, text string, tie long, place long, part long"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("id", "text"))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, bounds = rows.count(), []
    share = min(1.0, min(SAMPLE, 20 * ranges) / max(total, 1))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Only the sizes of the ranges depend on this sample.
    places = np.sort(some.mapInArrow(tidy(keyed), kinds).select("place").toArrow()["place"].to_numpy())
    bounds = np.unique(places[np.arange(1, ranges) * len(places) // ranges]).tolist() if len(places) else []
    rows = rows.mapInArrow(tidy(keyed), kinds).repartition("part").sortWithinPartitions("part", "place", "tie").select("id", "text")
    return rows.mapInArrow(tidy(_pack(tokenizer_path, length, end)), "id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")
