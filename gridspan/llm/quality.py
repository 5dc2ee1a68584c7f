"""Quality classifier from weak labels.

Labellers vote reject, keep or abstain on every document. Most are heuristics; where some documents have labels, two
more are learned from a bounded sample of those: word stems that are far commoner in abusive documents, whatever the
language, and a linear model. Votes are counted by pattern over the whole corpus, and expectation-maximisation over those
counts estimates how often each labeller that votes rejects documents to be kept and those that fail each test, and
so the posterior of every pattern. Posterior labels of a bounded sample of documents train a linear scorer over hashed words,
word shapes and votes, which decides.

Both trainings run in one task each, over a number of rows that a parameter bounds; only weights reach the driver.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from gridspan.llm.common import at_most, binary_list, in_groups, ship, tidy

REJECT, KEEP, ABSTAIN = "R", "K", "-"
#: Tests of the labellers, in the order of their votes.
LABELLERS = ("symbols", "capitals", "repeated lines", "repeated words", "odd word lengths", "little text", "abusive stems", "learned")
SYMBOLS = b"#$%&*|~^_<>=+@\\{}[]!"
FEATURES = 1 << 18
#: Most documents whose posterior labels train the scorer.
SAMPLE = 12_000
#: Most labelled rows that the learned labellers are fitted to; a quarter of them only chooses their cuts.
LABELLED = 12_000
HELD_OUT = 4
#: Share of the clean rows of that quarter above a cut, at most.
WRONGLY = 0.002
#: Bytes of a word that a stem may have. A stem is kept if its words are so many times commoner in abusive documents and met in so many of those.
STEMS, TIMES, MET = range(3, 9), 30.0, 5
ROUNDS = 60
STEM = 5
RARE = 10
DECAY = 0.3
SCALE = 4.0
#: Bytes of texts that are looked at together, which bounds memory: longer texts are taken in parts, cut between words.
CHUNK = 1 << 18
#: Training rows whose features are multiplied at once.
ROWS = 500
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_UPPER = bytes(range(65, 91))
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_SHAPE = bytes(ord("A") if chr(c).isupper() else ord("a") if c >= 128 or chr(c).isalpha() else ord("0") if chr(c).isdigit() else c for c in range(256))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x in (_BASE, _INVERSE):
        power = np.full(2 * CHUNK + 2, x, np.uint64)
        power[0] = 1
        out.append(np.cumprod(power, dtype=np.uint64))
    return tuple(out)


class _Hashed:
    """Hashes of stretches of bytes by running polynomial sums modulo 2^64: equal stretches have equal hashes wherever they lie."""

    def __init__(self, x: np.ndarray) -> None:
        power, self.back = _powers()
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[: len(x)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.back[start]


def _parts(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in groups of about CHUNK bytes: (number of the text, its bytes or a part of them)."""
    owner, parts, held = [], [], 0
    for i, t in enumerate(texts):
        t = t or b""
        while len(t) > CHUNK:
            at = max(t.rfind(b"\n", 0, CHUNK), t.rfind(b" ", 0, CHUNK)) + 1 or CHUNK
            yield [i], [t[:at]]
            t = t[at:]
        owner.append(i)
        parts.append(t)
        held += len(t) + 1
        if held > CHUNK - 1:
            yield owner, parts
            owner, parts, held = [], [], 0
    if parts:
        yield owner, parts


def _places(hashes: np.ndarray, kind: int, size: int) -> np.ndarray:
    mixed = (hashes ^ np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(65 - size.bit_length())


class Looked:
    """What one look at texts finds: counts of bytes, words and lines, hits of a lexicon of stems, and hashed features.

    Lines and repetitions of a text longer than CHUNK are counted part by part, except that distinct lines are so over all of it.
    """

    def __init__(self, texts: list[bytes | None], lexicon: dict[int, np.ndarray] | None = None, features: bool = True, stems: bool = False, size: int = FEATURES) -> None:
        n = self.n = len(texts)
        self.bytes = np.array([len(t or b"") for t in texts], np.int64)
        self.symbols, self.upper, self.letters, self.words, self.same, self.lines, self.hits = (np.zeros(n, np.int64) for _ in range(7))
        seen, keys, found = [], [], {k: [] for k in STEMS}
        for owner, parts in _parts(texts):
            for i, t in zip(owner, parts, strict=True):
                self.symbols[i] += len(t) - len(t.translate(None, SYMBOLS))
                self.upper[i] += len(t) - len(t.translate(None, _UPPER))
                self.letters[i] += len(t.translate(None, _NOT_LETTERS))
            raw = b"\n".join(parts) + b"\n"
            low = np.frombuffer(raw.lower(), np.uint8)
            space = (low == 32) | ((low >= 9) & (low <= 13))
            edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
            start, end = edge[::2], edge[1::2]
            owners, ends = np.array(owner, np.int64), np.cumsum([len(t) + 1 for t in parts])
            of = owners[np.searchsorted(ends, start, "right")]
            hashed = _Hashed(low)
            words = hashed(start, end)
            self.words += np.bincount(of, minlength=n)
            again = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
            self.same += np.bincount(of[1:][again], minlength=n)
            stop = np.flatnonzero(low == 10)
            begin = np.concatenate([[0], stop[:-1] + 1])
            full = np.searchsorted(start, stop) > np.searchsorted(start, begin)
            lines, line_of = hashed(begin[full], stop[full]), owners[np.searchsorted(ends, begin[full], "right")]
            self.lines += np.bincount(line_of, minlength=n)
            seen.append(np.unique(np.stack([line_of.astype(np.uint64), lines], 1), axis=0) if len(owner) < 2 else np.stack([line_of.astype(np.uint64), lines], 1))
            if lexicon or stems:
                hit = np.zeros(len(start), bool)
                for k in STEMS:
                    long = np.flatnonzero(end - start >= k)
                    h = hashed(start[long], start[long] + k)
                    if stems:
                        found[k].append((of[long], h))
                    if lexicon and len(known := lexicon[k]):
                        hit[long] |= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                self.hits += np.bincount(of[hit], minlength=n)
            if features:
                shape = np.frombuffer(raw.translate(_SHAPE), np.uint8)
                kinds = (
                    _places(words, 1, size),
                    _places(hashed(start, np.minimum(end, start + STEM)), 2, size),
                    _places(_Hashed(shape)(np.maximum(start, end - 4), end) * np.uint64(257) + shape[start], 3, size),
                )
                keys.append(np.unique(np.concatenate([of.astype(np.uint64) * np.uint64(size) + x for x in kinds]), return_counts=True))
        self.stems = found
        both = np.concatenate(seen) if seen else np.zeros((0, 2), np.uint64)
        order = np.lexsort((both[:, 1], both[:, 0]))
        both = both[order]
        new = np.ones(len(both), bool)
        new[1:] = (both[1:] != both[:-1]).any(axis=1)
        self.distinct = np.bincount(both[new, 0].astype(np.int64), minlength=n)
        if features:
            key, at = np.unique(np.concatenate([k for k, _ in keys]) if keys else np.zeros(0, np.uint64), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in keys]) if keys else None, len(key))
            self.row, self.place = (key // np.uint64(size)).astype(np.int64), (key % np.uint64(size)).astype(np.int32)
            self.value = SCALE * np.sqrt(counts / np.maximum(self.words, 1)[self.row])

    def abuse(self) -> np.ndarray:
        """Share of words that begin with a stem of the lexicon; 0 for a single one."""
        return np.where(self.hits >= 2, self.hits / np.maximum(self.words, 1), 0.0)

    def votes(self, cut: float | None = None) -> np.ndarray:
        """One letter (as a byte) of each labeller but the learned model for each text; without a cut, there is no lexicon to judge by."""
        n, m = np.maximum(self.bytes, 1), np.maximum(self.words, 1)
        abstain = np.full(self.n, ord(ABSTAIN), np.uint8)

        def vote(x: np.ndarray, reject: float, keep: float, when: np.ndarray | None = None) -> np.ndarray:
            found = np.where(x > reject, ord(REJECT), np.where(x <= keep, ord(KEEP), ord(ABSTAIN))).astype(np.uint8)
            return found if when is None else np.where(when, found, abstain)

        some = self.words > 3
        return np.stack(
            [
                vote(self.symbols / n, 0.02, 0.002),
                vote(self.upper / np.maximum(self.letters, 1), 0.3, 0.12),
                vote(1 - self.distinct / np.maximum(self.lines, 1), 0.45, 0.05, self.lines > 3),
                vote(self.same / m, 0.08, 0.03, some),
                vote(np.abs(self.bytes / m - 7.5), 6.0, 3.0, some),
                vote(4.0 - self.letters, 0.0, -36.0),
                abstain if cut is None else vote(self.abuse(), cut, cut / 3),
            ],
            axis=1,
        )


def vote_text(votes: np.ndarray) -> list[str]:
    raw, k = votes.tobytes().decode("ascii"), votes.shape[1]
    return [raw[i : i + k] for i in range(0, len(raw), k)]


def fit_labellers(patterns: dict[str, int], rounds: int = 200, prior: float = 0.2) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Posterior of rejection by vote pattern; P(reject | class, a vote was given), shape (labellers, classes); the classes' shares.

    Class 0 is to be kept; class i + 1 fails the test of labeller i. Documents fail in different ways, so a
    single class of bad ones would make their votes look independent of it. Bounds keep the classes' meaning: what is
    to be kept is seldom rejected, and what fails a labeller's test mostly is. Votes to reject and to keep both count;
    an abstention says nothing about the class.
    """
    width = len(next(iter(patterns), ""))
    own = np.arange(width), np.arange(width) + 1
    table = np.full((width, width + 1), 0.015)
    table[own] = 0.9
    shares = np.append(1 - prior, np.full(width, prior / max(width, 1)))
    if not patterns:
        return {}, table, shares
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    bad, good = (np.array([[v == vote for v in p] for p in names], float) for vote in (REJECT, KEEP))
    start = table.copy()
    for _ in range(rounds):
        logs = bad @ np.log(table) + good @ np.log(1 - table) + np.log(shares)
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        both = post * n[:, None]
        table = (bad.T @ both + start) / ((bad + good).T @ both + 1)
        table[:, 0] = np.minimum(table[:, 0], 0.02)
        table[own] = np.maximum(table[own], 0.6)
        table = np.clip(table, 1e-4, 1 - 1e-4)
        shares = both.sum(axis=0) + 0.1
        shares /= shares.sum()
    return dict(zip(names, (1 - post[:, 0]).tolist(), strict=True)), table, shares


def vote_places(pattern: str, size: int = FEATURES) -> np.ndarray:
    return np.array([zlib.crc32(b"vote %d %d" % (i, ord(v))) & size - 1 for i, v in enumerate(pattern)], np.int32)


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, size: int = FEATURES, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of a logistic scorer on soft labels with a squared penalty, by L-BFGS; places met in fewer than RARE rows get none."""
    if not rows:
        return np.zeros(size)
    out, met, blocks = np.zeros(size), np.zeros(size, np.int64), []
    for i in range(0, len(rows), ROWS):
        met += np.bincount(np.concatenate([at for at, _ in rows[i : i + ROWS]]), minlength=size)
    used = np.flatnonzero(met >= RARE)
    number = np.zeros(size, np.int32)
    number[used] = np.arange(len(used))
    for i in range(0, len(rows), ROWS):
        some = rows[i : i + ROWS]
        at, x = (np.concatenate(c) for c in zip(*some, strict=True))
        row = np.repeat(np.arange(len(some), dtype=np.int16), [len(r[0]) for r in some])
        often = met[at] >= RARE
        blocks.append((target[i : i + ROWS], number[at[often]], x[often], row[often]))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = DECAY / 2 * (w @ w), DECAY * w
        for t, at, x, row in blocks:
            z = np.bincount(row, w[at] * x, len(t))
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            value += (np.logaddexp(0, z) - t * z).sum()
            slope += np.bincount(at, (p - t)[row] * x, len(used))
        return value, slope

    w = np.zeros(len(used))
    value, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, kept = -slope, []
        for s, y in reversed(steps):
            k = s @ way / (s @ y)
            way = way - k * y
            kept.append(k)
        if steps:
            s, y = steps[-1]
            way = way * (s @ y / (y @ y))
        for (s, y), k in zip(steps, reversed(kept), strict=True):
            way = way + (k - y @ way / (s @ y)) * s
        rate = 1.0 if steps else 1.0 / max(np.sqrt(slope @ slope), 1e-12)
        while rate > 1e-10:
            new = w + rate * way
            new_value, new_slope = loss(new)
            if new_value <= value + 1e-4 * rate * (slope @ way):
                break
            rate /= 2
        else:
            break
        s, y = new - w, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps[-7:], (s, y)]
        done = value - new_value < 1e-7 * abs(value)
        w, value, slope = new, new_value, new_slope
        if done:
            break
    out[used] = w
    return out


def find_stems(abusive: list[bytes], others: list[bytes]) -> dict[int, np.ndarray]:
    """By length, the sorted hashes of the stems whose words are TIMES as common in abusive texts, MET of those at least having one."""

    def gather(texts: list[bytes], known: dict[int, np.ndarray] | None) -> tuple[dict, int]:
        counts, words = {k: [] for k in STEMS}, 0
        for group in in_groups(texts, CHUNK):
            looked = Looked(group, features=False, stems=True)
            words += int(looked.words.sum())
            for k in STEMS:
                if not looked.stems[k]:
                    continue
                of, h = (np.concatenate(x) for x in zip(*looked.stems[k], strict=True))
                if known is not None:
                    wanted = np.isin(h, known[k])
                    of, h = of[wanted], h[wanted]
                key, at, n = np.unique(h, return_inverse=True, return_counts=True)
                docs = np.bincount(np.unique(np.stack([at, of]), axis=1)[0], minlength=len(key)) if len(h) else n
                counts[k].append((key, n, docs))
        out = {}
        for k, found in counts.items():
            key, at = np.unique(np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.uint64), return_inverse=True)
            out[k] = (key, *(np.bincount(at, np.concatenate([x[i] for x in found]) if found else None, len(key)) for i in (1, 2)))
        return out, words

    met, total = gather(abusive, None)
    often = {k: (key[docs >= MET], n[docs >= MET]) for k, (key, n, docs) in met.items()}
    beside, rest = gather(others, {k: key for k, (key, _) in often.items()})
    out = {}
    for k, (key, n) in often.items():
        m = np.zeros(len(key))
        m[np.searchsorted(key, beside[k][0])] = beside[k][1]
        out[k] = key[n / max(total, 1) >= TIMES * (m + 0.5) / max(rest, 1)]
    return out


def _cut(values: np.ndarray, least: float) -> float:
    """The smallest cut, `least` or more, above which lie at most a share of WRONGLY of the values."""
    x = np.sort(values)[::-1]
    return max(least, float(x[int(WRONGLY * len(x))])) if len(x) else least


class Judge:
    """Votes, features and probabilities of rejection for groups of texts.

    learned: the lexicon, its cut, the linear model's weights and its cut, of which None stands for not enough labels.
    """

    def __init__(self, learned: tuple | None = None, weights: np.ndarray | None = None) -> None:
        self.lexicon, self.cut, self.model, self.model_cut = learned or (None, None, None, None)
        self.weights = weights

    def _probabilities(self, w: np.ndarray, looked: Looked, votes: np.ndarray) -> np.ndarray:
        z = np.bincount(looked.row, w[looked.place] * looked.value, looked.n)
        for i in range(votes.shape[1]):
            for v in (REJECT, KEEP, ABSTAIN):
                z[votes[:, i] == ord(v)] += w[zlib.crc32(b"vote %d %d" % (i, ord(v))) & len(w) - 1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, Looked, np.ndarray | None]:
        """Votes (the learned model's last, an abstention if there is none), what was looked at, and the scorer's probabilities if it has weights."""
        looked = Looked(texts, self.lexicon, self.model is not None or self.weights is not None)
        votes = looked.votes(self.cut)
        last = np.full(looked.n, ord(ABSTAIN), np.uint8)
        if self.model is not None:
            p = self._probabilities(self.model, looked, votes)
            last = np.where(p > self.model_cut, ord(REJECT), np.where(p <= self.model_cut / 3, ord(KEEP), ord(ABSTAIN))).astype(np.uint8)
        votes = np.column_stack([votes, last])
        return votes, looked, None if self.weights is None else self._probabilities(self.weights, looked, votes)


def _rows_of(looked: Looked, votes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    edges = np.searchsorted(looked.row, np.arange(looked.n + 1))
    out = []
    for pattern, i, j in zip(vote_text(votes), edges, edges[1:], strict=False):
        places = vote_places(pattern)
        out.append((np.concatenate([looked.place[i:j], places]), np.concatenate([looked.value[i:j], np.ones(len(places))]).astype(np.float32)))
    return out


def learn(texts: list[bytes], bad: list[bool], abusive: list[bool]) -> tuple | None:
    """The learned labellers from labelled texts in a fixed order; every HELD_OUT-th row only chooses their cuts. None without rows of both kinds."""
    place = np.arange(len(texts)) % HELD_OUT
    fit, held = np.flatnonzero(place != 0).tolist(), np.flatnonzero(place == 0).tolist()
    if not 0 < sum(bad[i] for i in fit) < len(fit):
        return None
    lexicon = find_stems([texts[i] for i in fit if abusive[i]], [texts[i] for i in fit if not abusive[i]])
    clean = [texts[i] for i in held if not bad[i]]
    cut = _cut(np.concatenate([Looked(g, lexicon, False).abuse() for g in in_groups(clean, CHUNK)] or [np.zeros(0)]), 0.004)
    rows = []
    for group in in_groups([texts[i] for i in fit], CHUNK):
        looked = Looked(group, lexicon)
        rows += _rows_of(looked, looked.votes(cut))
    model = train_scorer(rows, np.array([bad[i] for i in fit], float)).astype(np.float32)
    judge = Judge((lexicon, cut, model, 1.0))
    scores = [judge._probabilities(model, (looked := Looked(g, lexicon)), looked.votes(cut)) for g in in_groups(clean, CHUNK)]
    return lexicon, cut, model, _cut(np.concatenate(scores or [np.zeros(0)]), 0.1)


def _in_one_task(rows: DataFrame, order: list[str], work) -> bytes:
    """work(batches) on a bounded number of rows in one task, whose only result is its bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(batches))], pa.binary())], ["made"])

    found = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(tidy(each), "made binary").first()
    return pickle.dumps(work(iter([]))) if found is None else found.made  # no rows, no task


def learn_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED) -> tuple | None:
    """The learned labellers, fitted to at most `most` rows of labels(doc_id, bad[, abusive]), chosen by a hash of the id.

    Ids that docs lacks count for nothing; of several texts of one id the least is taken, and of several labels the worse.
    """
    if "abusive" not in labels.columns:
        labels = labels.withColumn("abusive", F.lit(False))
    labels = labels.where("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"), F.coalesce(F.max("abusive"), F.lit(False)).alias("abusive"))
    labels = at_most(labels, most, "doc_id")
    known = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id")).join(F.broadcast(labels), "doc_id")  # at most `most` rows
    known = known.groupBy("doc_id", "bad", "abusive").agg(F.min("text").alias("text")).withColumn("h", F.xxhash64("doc_id"))

    def work(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        rows = [r for b in batches for r in zip(binary_list(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        return learn(*([t or b"" for t in c] if i == 0 else list(c) for i, c in enumerate(zip(*rows, strict=True)))) if rows else None

    return pickle.loads(_in_one_task(known.select("text", "bad", "abusive", "h", "doc_id"), ["h", "doc_id"], work))


def fit(
    docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> tuple[dict[str, float], np.ndarray, tuple | None]:
    """Posteriors by vote pattern, the scorer's weights and the learned labellers. Pattern counts (3^8 at most) and weights reach the driver."""
    spark = docs.sparkSession
    ship(spark)
    learned = None if labels is None else learn_labels(docs, labels, id_col, text_col)
    held = spark.sparkContext.broadcast(learned)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value)
        for b in batches:
            for group in in_groups(binary_list(b.column(0)), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(vote_text(judge(group)[0]), pa.string())], ["votes"])

    texts = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    counted = texts.select("text").mapInArrow(tidy(voted), "votes string").groupBy("votes").count().collect()
    patterns = {r["votes"]: r["count"] for r in counted}
    posterior, _, _ = fit_labellers(patterns)
    few = texts if sum(patterns.values()) <= sample else at_most(texts, sample, "id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        judge, rows, target = Judge(held.value), [], []
        for b in batches:
            for group in in_groups(binary_list(b.column(0)), CHUNK):
                votes, looked, _ = judge(group)
                if judge.model is None:
                    looked = Looked(group)
                rows += _rows_of(looked, votes)
                target += [posterior[p] for p in vote_text(votes)]
        return train_scorer(rows, np.array(target)).astype(np.float32)

    few = few.select("text", F.xxhash64("id", "text").alias("h"))
    return posterior, pickle.loads(_in_one_task(few, ["h", "text"], work)), learned


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """docs's columns with votes (string), weak_reject, score (double: probability of rejection) and keep (score < 0.5).

    labels(doc_id, bad boolean[, abusive boolean]) may judge some documents; it can hold ids that docs lacks. Null texts count as
    empty, and very long ones are looked at part by part. Repeated rows are judged alike. Columns of docs with the new names are
    replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    posterior, weights, learned = fit(docs, labels, id_col, text_col, sample)
    held = spark.sparkContext.broadcast((posterior, weights, learned))
    new = ["votes", "weak_reject", "score", "keep"]
    kept = docs.drop(*new)
    place = kept.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, weights, learned = held.value
        judge = Judge(learned, weights)
        for b in batches:
            v, score = [], []
            for group in in_groups(binary_list(b.column(place)), CHUNK):
                votes, _, p = judge(group)
                v += vote_text(votes)
                score += p.tolist()
            more = [pa.array(v, pa.string()), pa.array([posterior[p] for p in v], pa.float64()), pa.array(score, pa.float64()), pa.array([p < 0.5 for p in score], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *new])

    kinds = (StringType(), DoubleType(), DoubleType(), BooleanType())
    return kept.mapInArrow(tidy(each), StructType([*kept.schema.fields, *map(StructField, new, kinds)]))
