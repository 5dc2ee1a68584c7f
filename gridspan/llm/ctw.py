"""Context-tree weighting over bytes, trained on part of a corpus and applied to all of it.

A text is the sequence of its tokens: lower-cased words joined by single spaces, then an end byte that no
UTF-8 text contains. Each byte is eight binary decisions; for every decision (a node of the byte's binary
tree) and every context of 0 to DEPTH preceding bytes, the training counts give a Krichevsky-Trofimov
estimate. The weighted probability of a context is half its own estimate and half the product of its longer
contexts' weighted probabilities; what share of that is its own decides how much weight prediction leaves at
each depth. A context never seen in training has the estimate one half for either bit, as any without counts.

The model is not cut: it grows with the corpus. All distinct (context, byte) pairs of the corpus are dealt by the last
SPLIT bytes of their context and sorted, so one pass over a partition builds the longer contexts' part of the
tree, and a second scores every pair once what the shorter contexts say has come back to it. A text's score adds up
those of its pairs. The commonest are broadcast, as many as have a proven bound, so that few are joined; both
ways give the same scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.llm.common import Scratch, binary_list, in_groups, runs, ship, tidy

#: Bytes of the longest context; seven bytes, it and the one that follows, are the most that a pair's number holds.
DEPTH = 5
#: Bytes of context by which pairs are dealt to tasks.
SPLIT = 3
#: Commonest pairs whose scores are broadcast (16 bytes each); the others are joined.
COMMONEST = 1 << 21
#: Most frequent words whose counts are broadcast; the rest are joined.
HEAD = 1 << 18
END = b"\xff"
#: Bytes scored or counted at once.
BLOCK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def token_bytes(text: bytes | None) -> tuple[list[bytes], bytes]:
    words = (text or b"").lower().split()
    return words, b" ".join(words)


def context_keys(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts and their ends: depth context bytes, the latest highest, then the byte; and the number of bytes of each text."""
    pad = END * depth
    x = np.frombuffer(pad + pad.join(texts) + pad, np.uint8).astype(np.uint64)
    key = x[depth:].copy()
    for d in range(1, depth + 1):
        key |= x[depth - d : len(x) - d] << np.uint64(8 * (depth - d + 1))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    keep = np.ones(len(key), bool)
    ends = np.cumsum(sizes + depth - 1)
    for d in range(1, depth):
        keep[ends - d] = False
    return key[keep], sizes


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (1, 2))


def _count_pairs(depth: int):
    """(key, n, m) of the pairs of texts(text, train): in how many places of training texts and of all texts each is, by parts of the input."""

    def out(part: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(part[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000].astype(np.int64)) for x in part], ["key", "n", "m"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            train, at = b.column(1).to_numpy(zero_copy_only=False).astype(bool), 0
            for group in in_groups(binary_list(b.column(0)), BLOCK):
                own, at = train[at : at + len(group)], at + len(group)
                for flat, some in _flat(group):
                    key, sizes = context_keys(flat, depth)
                    key, where, m = np.unique(key, return_inverse=True, return_counts=True)
                    parts.append((key, np.bincount(where, np.repeat(own[some], sizes), len(key)).astype(np.int64), m))
                if sum(len(p[0]) for p in parts) > 1_500_000:
                    parts = [_merge(parts)]
                    if len(parts[0][0]) > 1_000_000:
                        yield from out(parts.pop())
        if parts:
            yield from out(_merge(parts))

    return each


def _flat(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], list[int]]]:
    """The token bytes of texts and their numbers, texts that are much longer than a block apart from the others."""
    flat = [token_bytes(t)[1] for t in texts]
    short = [i for i, x in enumerate(flat) if len(x) <= BLOCK]
    yield [flat[i] for i in short], short
    for i, x in enumerate(flat):
        if len(x) > BLOCK:
            yield [x], [i]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words, n = list(found), list(found.values())
        for i in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()), pa.array(n[i : i + 50_000], pa.int64())], ["word", "n"])
        found.clear()

    for b in batches:
        for t in binary_list(b.column(0)):
            found.update(token_bytes(t)[0])
            if len(found) > 250_000:
                yield from out()
    yield from out()


_GAMMA = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096)))]), math.lgamma(0.5) + np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096) - 0.5))])


def _log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """ln Gamma(n + 1), or ln Gamma(n + 1/2), for whole n: from a table, or Stirling's series."""
    out = _GAMMA[int(half)][np.minimum(n, 4095).astype(np.int64)]
    large = n > 4095
    if large.any():
        x = n[large] + (0.5 if half else 1.0)
        out[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with n0 zeros and n1 ones."""
    return _log_gamma(n0, True) + _log_gamma(n1, True) - math.log(math.pi) - _log_gamma(n0 + n1, False)


def weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability of contexts whose own estimate and whose longer contexts' product are given, and the share of the former."""
    both = math.log(0.5) + np.logaddexp(own, below)
    return both, np.exp(math.log(0.5) + own - both)


class Stems:
    """The part of the tree above whole stems (the last `split` bytes of contexts), from all their pairs in order."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, split: int) -> None:
        #: By level from the longest contexts: pairs, their counts, and the place in this level of each pair of the one before.
        self.levels = [(key, n.astype(np.float64), np.arange(len(key)))]
        for _ in range(depth - split):
            key, n, _ = self.levels[-1]
            shorter, at = np.unique(key >> np.uint64(16) << np.uint64(8) | key & np.uint64(255), return_inverse=True)
            self.levels.append((shorter, np.bincount(at, n, len(shorter)), at))

    def decisions(self, j: int) -> list[tuple[np.ndarray, ...]]:
        """Of bit j by level: the decision of each pair, each decision's counts of 0 and 1, weighted ln probability and own share."""
        out = []
        for key, n, at in self.levels:
            prefix = key >> np.uint64(8 - j)
            new = np.ones(len(key), bool)
            new[1:] = prefix[1:] != prefix[:-1]
            of = np.cumsum(new) - 1
            bit = (key >> np.uint64(7 - j) & np.uint64(1)).astype(np.float64)
            ones = np.bincount(of, n * bit)
            zeros = np.bincount(of, n) - ones
            own = log_kt(zeros, ones)
            if out:
                under, _, _, weighted, _ = out[-1]
                first = np.flatnonzero(np.concatenate([[True], under[1:] != under[:-1]]))
                both, share = weigh(own, np.bincount(of[at[first]], weighted, len(own)))
            else:
                both, share = own, np.ones(len(own))
            out.append((of, zeros, ones, both, share))
        return out

    def tops(self) -> list[np.ndarray]:
        """(node_key, zeros, ones, ln probability) of all decisions of the stems; node_key holds the stem, then the node."""
        found, key = [], self.levels[-1][0]
        for j in range(8):
            of, zeros, ones, both, _ = self.decisions(j)[-1]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            found.append((_node_keys(key[first], j), zeros, ones, both))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def scores(self, node_key: np.ndarray, done: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 probability of each pair's byte, given for each decision of a stem (sorted) what shorter contexts add and the weight they leave."""
        key, total = self.levels[0][0], np.zeros(len(self.levels[0][0]))
        for j in range(8):
            at, now = np.arange(len(key)), None
            for (_, _, back), (of, zeros, ones, _, share) in zip(self.levels, self.decisions(j), strict=True):
                at = back[at]
                p = ((ones + 0.5) / (zeros + ones + 1))[of[at]]
                now = p if now is None else share[of[at]] * p + (1 - share[of[at]]) * now
            place = np.searchsorted(node_key, _node_keys(self.levels[-1][0], j))[at]
            now = done[place] + left[place] * now
            total += np.log10(np.where(key >> np.uint64(7 - j) & np.uint64(1), now, 1 - now))
        return total


def _node_keys(key: np.ndarray, j: int) -> np.ndarray:
    """Number of the decision of bit j for pairs (context << 8 | byte): the context, then the node of the byte's tree."""
    return (key >> np.uint64(8) << np.uint64(8) | np.uint64(1 << j) + ((key & np.uint64(255)) >> np.uint64(8 - j))).astype(np.int64)


_DEALT = "stem long, kind int, key long, n long, m long, x double, y double"


def _dealt(rows: list[tuple], names: list[str] = ["stem", "kind", "key", "n", "m", "x", "y"]) -> Iterator[pa.RecordBatch]:  # noqa: B006
    for i in range(0, len(rows[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in rows], names)


def _build(depth: int, split: int):
    """Pairs in order of their stems pass through (kind 1); beside them, the decisions of the stems (kind 0) with counts and ln probability."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in runs(batches, ["stem"]):
            stem, key, n, m = (table[c].to_numpy() for c in ("stem", "key", "n", "m"))
            none = np.zeros(len(key))
            yield from _dealt([stem, np.ones(len(key), np.int32), key, n, m, none, none])
            top, zeros, ones, both = Stems(key.view(np.uint64), n, depth, split).tops()
            yield from _dealt([top >> 8, np.zeros(len(top), np.int32), top, zeros.astype(np.int64), ones.astype(np.int64), both, np.zeros(len(top))])

    return each


def _finish(depth: int, split: int):
    """(key, m, score) of the pairs, from rows in order of stems: their decisions with what shorter contexts say (kind 0), then the pairs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in runs(batches, ["stem"]):
            kind, key, n, m, x, y = (table[c].to_numpy() for c in ("kind", "key", "n", "m", "x", "y"))
            top, pair = kind == 0, kind == 1
            score = Stems(key[pair].view(np.uint64), n[pair], depth, split).scores(key[top], x[top], y[top])
            yield from _dealt([key[pair], m[pair], score], ["key", "m", "score"])

    return each


def pair_scores(pairs: DataFrame, scratch: Scratch, depth: int = DEPTH, split: int = SPLIT) -> DataFrame:
    """pairs(key, n, m), partial counts, -> (key, m, score): the model's log10 probability of each distinct pair's byte after its context."""
    split = min(split, depth)
    stem = F.expr(f"shiftright(key, {8 * (depth + 1 - split)})")
    dealt = pairs.withColumn("stem", stem).repartition("stem").groupBy("stem", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    built = scratch.write(dealt.sortWithinPartitions("stem", "key").mapInArrow(tidy(_build(depth, split)), _DEALT))
    # From the stems to the empty context, then back again with what each context adds and the weight it leaves to longer ones.
    tops = [built.where("kind = 0").select(F.col("key").alias("node_key"), F.col("n").alias("zeros"), F.col("m").alias("ones"), F.col("x").alias("both"))]
    level = tops[0]
    kind = "node_key long, zeros long, ones long, both double, share double"
    for _ in range(split):
        up = F.expr("shiftleft(shiftright(node_key, 16), 8) | (node_key & 255)")
        level = level.groupBy(up.alias("node_key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("both").alias("below"))
        level = scratch.write(level.mapInArrow(tidy(_weigh), kind))
        tops.append(level)
    p = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    said = None
    for level in reversed(tops[1:]):
        rows = level.select("node_key", p.alias("p"), "share")
        if said is None:
            said = rows.select("node_key", (F.col("share") * F.col("p")).alias("x"), (1 - F.col("share")).alias("y"))
        else:
            rows = rows.withColumn("up", up).join(said.withColumnRenamed("node_key", "up"), "up")
            said = rows.select("node_key", (F.col("x") + F.col("y") * F.col("share") * F.col("p")).alias("x"), (F.col("y") * (1 - F.col("share"))).alias("y"))
        said = scratch.write(said)
    if said is None:
        said = tops[0].select("node_key", F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
    else:
        said = tops[0].select("node_key", up.alias("up")).join(said.withColumnRenamed("node_key", "up"), "up").select("node_key", "x", "y")
    none = F.lit(0).cast("long")
    said = said.select(F.expr("shiftright(node_key, 8)").alias("stem"), F.lit(0).alias("kind"), F.col("node_key").alias("key"), none.alias("n"), none.alias("m"), "x", "y")
    rows = said.union(built.where("kind = 1")).repartition("stem").sortWithinPartitions("stem", "kind", "key")
    return scratch.write(rows.mapInArrow(tidy(_finish(depth, split)), "key long, m long, score double"))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        zeros, ones, below = (b.column(k).to_numpy().astype(np.float64) for k in (1, 2, 3))
        both, share = weigh(log_kt(zeros, ones), below)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(both), pa.array(share)], ["node_key", "zeros", "ones", "both", "share"])


class Commonest:
    """Scores of the commonest pairs, found by a hash."""

    def __init__(self, key: np.ndarray, score: np.ndarray) -> None:
        mixed = key.astype(np.uint64) * _MIX
        order = np.argsort(mixed)
        self.key, self.score = key.astype(np.uint64)[order], score[order]
        self.bits = max(len(key).bit_length(), 1)
        self.first = np.searchsorted(mixed[order] >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1)).astype(np.int32)

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores of pairs, 0 where they are not among these, and the places of those that are not."""
        bucket = (key * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[bucket].astype(np.int64), self.first[bucket + 1].astype(np.int64)
        out, left, missing = np.zeros(len(key)), np.arange(len(key)), []
        while len(left):
            over = at[left] >= end[left]
            missing.append(left[over])
            left = left[~over]
            hit = self.key[at[left]] == key[left]
            out[left[hit]] = self.score[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
        return out, np.sort(np.concatenate(missing)) if missing else left


def commonest(counts: DataFrame, count: str, most: int) -> DataFrame:
    """The most frequent rows by steps of an eighth of a power of two: as many steps as fit into `most` rows."""
    step = F.floor(F.log2(count) * 8)
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if (left := left - r["count"]) < 0:
            break
        least = r["step"]
    return counts.where(step >= least) if least is not None else counts.limit(0)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the words of texts(text), the end not included."""
    ship(texts.sparkSession)
    return texts.select("text").mapInArrow(tidy(_count_words), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score(
    docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, split: int = SPLIT, head: int = HEAD, most: int = COMMONEST
) -> DataFrame:
    """Score every row of docs with a model of the rows where `train_on` holds.

    Gives (id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): base_score is the sum
    of log10((c + 1) / (N + V + 1)) over the text's words and its end, by training counts; score the model's
    log10 probability; bits_per_byte the same as a code length per byte of the scored sequence. A null or empty
    text is its end alone. Repeated rows train and are scored each. Rows where train_on is null are held
    out. With nothing to train on, every bit has probability one half and all counts are 0. Very long texts are taken whole.
    Other columns are left out. An empty table gives no rows. Scratch tables stay until the application ends.
    """
    if not 1 <= depth <= 6:
        raise ValueError(f"a depth from 1 to 6 is needed, not {depth}")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train_on, F.lit(False)).alias("train"))
    chosen = rows.where("train")
    pairs = rows.select("text", "train").mapInArrow(tidy(_count_pairs(depth)), "key long, n long, m long")
    scores = pair_scores(pairs, scratch, depth, split)
    table = commonest(scores, "m", most).select("key", "score").toArrow()
    model = spark.sparkContext.broadcast(Commonest(table["key"].to_numpy(), table["score"].to_numpy()))
    counts = scratch.write(word_counts(chosen))
    n_docs = chosen.count()
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, n_words = size.n + n_docs, size.v + (n_docs > 0)
    norm = math.log10(n_all + n_words + 1)
    table = commonest(counts, "n", head).toArrow()
    known = spark.sparkContext.broadcast(dict(zip(table["word"].to_pylist(), (np.log10(table["n"].to_numpy() + 1) - norm).tolist(), strict=True)))
    del table
    end_score = math.log10(n_docs + 1) - norm

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_of, common = known.value, model.value
        for b in batches:
            ids, held, at = b.column(0), b.column(2), 0
            for group in in_groups(binary_list(b.column(1)), BLOCK):
                cols: list[list] = [[], [], [], [], [], []]
                for text in group:
                    words, flat = token_bytes(text)
                    base, hits, tail, often = end_score, int(n_docs > 0), [], []
                    for w, k in Counter(words).items():
                        v = base_of.get(w)
                        if v is None:
                            tail.append(w)
                            often.append(k)
                        else:
                            base += k * v
                            hits += k
                    for c, x in zip(cols, (len(words) + 1, hits, base, len(flat) + 1, tail, often), strict=True):
                        c.append(x)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                n = len(group)
                found, rare, times = np.zeros(n), [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
                for flat, some in _flat(group):
                    if not some:
                        continue
                    key, sizes = context_keys(flat, depth)
                    ends = np.cumsum(sizes)
                    value, missing = common(key)
                    found[some] = np.add.reduceat(value, ends - sizes)
                    edges = np.searchsorted(missing, np.concatenate([[0], ends]))
                    for i, low, high in zip(some, edges, edges[1:], strict=False):
                        rare[i], times[i] = np.unique(key[missing[low:high]].view(np.int64), return_counts=True)
                more = [pa.array(found), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
                names = ["id", "train", "n_tokens", "hits", "base", "bytes", "tail", "often", "score", "rare", "times"]
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), held.slice(at, n), *arrays, *more], names)
                at += n

    kinds = "id long, train boolean, n_tokens long, hits long, base double, bytes long, tail array<binary>, often array<long>, score double, rare array<long>, times array<long>"
    scored = scratch.write(rows.mapInArrow(tidy(each), kinds).withColumn("row", F.monotonically_increasing_id()))
    words = scored.select("row", F.explode(F.arrays_zip("tail", "often")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.often").alias("k"))
    words = words.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("k") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - norm)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("seen")
    )
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("k"))
    rare = rare.join(scores.select("key", F.col("score").alias("s")), "key").groupBy("row").agg(F.sum(F.col("k") * F.col("s")).alias("rest"))
    out = scored.drop("tail", "often", "rare", "times").join(words, "row", "left").join(rare, "row", "left")
    zero, whole = F.lit(0), F.col("score") + F.coalesce("rest", F.lit(0.0))
    return out.select(
        "id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("hits") + F.coalesce("seen", zero)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        whole.alias("score"),
        (-whole * math.log2(10) / F.col("bytes")).alias("bits_per_byte"),
    )
