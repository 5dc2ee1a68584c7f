"""SentencePiece encoding and decoding, word by word over a trie of the distinct marked words.

A text's spaces become marks and it is cut before each run of marks; no piece crosses such a cut. Distinct
words are sorted, which is a depth-first walk of their trie, and the forward states of the prefix a word
shares with the one before it are kept. A state is the best segmentation of a prefix: in mode "unigram" the one
with the highest sum of piece scores; in mode "bpe" the one that merging by rank gives. The latter also
follows from states alone: a merged segmentation cut after any piece is that of the shorter prefix, so the last
piece of a prefix is the one that merging would leave standing next to the last piece before it.
"""

from __future__ import annotations

import math
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridspan.llm.common import binary_list, in_groups, ship, tidy

MARK = "▁"
_LINES = re.compile(r"\n+|[^\n]+")
_RUNS = re.compile(" +[^ ]*")
_SPLIT = "\0"
#: Bytes of words and their ids that a worker remembers in each of two generations; longer words are not remembered.
REMEMBERED, LONGEST_REMEMBERED = 80 << 20, 64
#: Bytes that one remembered word takes besides its letters and ids.
OVERHEAD = 180
#: Pairs of pieces of which a worker remembers whether merging leaves them apart, and ends of words of which it remembers the
#: lengths of pieces that end so; each takes about 100 bytes.
PAIRS, TAILS = 200_000, 100_000
#: Bytes of texts that are encoded together.
GROUP = 1 << 21


class Pieces:
    """The vocabulary of a SentencePiece model and the two passes over it."""

    def __init__(self, path: str, mode: str = "bpe") -> None:
        import sentencepiece

        if mode not in ("bpe", "unigram"):
            raise ValueError(f"unknown mode: {mode}")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.mode = mode
        # A space stands for the mark here, which keeps words of ASCII or Latin-1 at a byte a character.
        self.piece = [sp.id_to_piece(i).replace(MARK, " ") for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.score = [sp.get_score(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        self.text = [b"" if sp.is_control(i) else p.encode() for i, p in enumerate(self.piece)]
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        #: Line ends are cut off where no piece holds one: they are coded byte by byte and merge with nothing.
        self.lines = not any("\n" in p for p in self.id)
        #: ASCII punctuation that no piece joins to a letter or digit; words are cut there too, so more of them are equal.
        joined = {c for p in self.id for a, b in zip(p, p[1:], strict=False) if a.isalnum() != b.isalnum() for c in (a, b)}
        self.loose = frozenset(string.punctuation) - joined
        loose = re.escape("".join(sorted(self.loose)))
        self.cuts = re.compile(f"(?<=[^\\W_])(?=[{loose}])|(?<=[{loose}])(?=[^\\W_])") if loose else None
        self.unknown = sp.unk_id()
        #: Lengths of the pieces of three or more characters by their last three.
        self.ending: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 2:
                self.ending.setdefault(p[-3:], set()).add(len(p))
        self.tails: dict[str, tuple[int, ...]] = {}
        self.stands: dict[int, bool] = {}
        #: Ids of the words met lately, and of those met before; a word that is met again moves to the first.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def _merge(self, parts: list[str]) -> list[str]:
        """Merge neighbours by the best score of what they make, the leftmost first."""
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stand(self, a: int, b: int) -> bool:
        """Whether merging the characters of two pieces, or of one if a is -1, ends with just them."""
        key = a * len(self.piece) + b
        found = self.stands.get(key)
        if found is None:
            if len(self.stands) > PAIRS:
                self.stands.clear()
            want = [self.piece[i] for i in (a, b) if i >= 0]
            found = self.stands[key] = self._merge(list("".join(want))) == want
        return found

    def _lengths(self, tail: str) -> tuple[int, ...]:
        """Lengths, the largest first, of the pieces that may end a prefix whose last characters, three at most, are `tail`."""
        found = self.tails.get(tail)
        if found is None:
            if len(self.tails) > TAILS:
                self.tails.clear()
            short = [n for n in (2, 1) if tail[-n:] in self.id and n <= len(tail)]
            found = self.tails[tail] = (*sorted(self.ending.get(tail, ()), reverse=True), *short)
        return found

    def _grow(self, word: str, states: list[int], totals: list[float]) -> None:
        """Add the states of the prefixes of `word` that have none yet: the id of the last piece of each, -1 if it is a character without one."""
        find, stands, many, merging = self.id.get, self.stands, len(self.piece), self.mode == "bpe"
        for end in range(len(states), len(word) + 1):
            tail = word[end - 3 : end] if end > 3 else word[:end]
            state, total = -1, -math.inf if merging else totals[end - 1] - 1e6
            for n in self.tails.get(tail) or self._lengths(tail):
                i = find(word[end - n : end]) if n <= end else None
                if i is None:
                    continue
                before = states[end - n]
                if merging:
                    # A character without a piece merges with nothing.
                    if n == end or before < 0 or (stands[key] if (key := before * many + i) in stands else self._stand(before, i)):
                        state = i
                        break
                elif (sum_ := totals[end - n] + self.score[i]) >= total:
                    state, total = i, sum_
            states.append(state)
            if not merging:
                totals.append(total)

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, walking them in order and keeping the states of shared prefixes."""
        states, totals, last, found = [-1], [0.0], "", {}
        for word in sorted(words):
            shared = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :], totals[shared + 1 :]
            self._grow(word, states, totals)
            last, end, ids = word, len(word), array("I")
            while end:
                i = states[end]
                if i >= 0:
                    ids.append(i)
                    end -= len(self.piece[i])
                else:
                    end -= 1
                    ids.extend([self.byte[b] for b in reversed(word[end].encode())] if self.byte else [self.unknown])
            ids.reverse()
            found[word] = ids.tobytes()
        return found

    def words(self, text: str) -> list[str]:
        """The marked words of a text: a mark, shown as a space, for the start and for each space, cut where no piece reaches across.

        Such places are before runs of marks, around line ends, and between letters and punctuation.
        """
        if not text:
            return []
        # A literal mark and a space are the same to the model.
        text = " " + text.replace(MARK, " ")
        if "  " in text or text[-1] == " " or _SPLIT in text:
            marked = _RUNS.findall(text)
        else:
            marked = text.replace(" ", _SPLIT + " ").split(_SPLIT)[1:]
        out, loose = [], self.loose
        for w in marked:
            if w[1:].isalnum():
                out.append(w)
            elif w[-1] in loose and w[1:-1].isalnum():
                out += w[:-1], w[-1]
            else:
                for x in _LINES.findall(w) if self.lines and "\n" in w else (w,):
                    out += (x,) if self.cuts is None else self.cuts.split(x)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. An empty text has none."""
        split = [self.words(t) for t in texts]
        known, before = self.known, self.before
        fresh = set().union(*split).difference(known)
        new = {w: before[w] for w in fresh if w in before}
        new |= self.encode_words([w for w in fresh if w not in new])
        short = {w: ids for w, ids in new.items() if len(w) <= LONGEST_REMEMBERED}
        known |= short
        find = known.__getitem__
        if len(short) < len(new):
            find = lambda w: known.get(w) or new[w]
        out = [b"".join(map(find, words)) for words in split]
        self.held += sum(map(len, short)) * 4 + sum(map(len, short.values())) + OVERHEAD * len(short)
        if self.held > REMEMBERED:
            self.known, self.before, self.held = {}, known, 0
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; control ids are left out."""
        out = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (out[1:] if out.startswith(b" ") else out).decode("utf-8", "replace")


_models: dict[tuple[str, str], Pieces] = {}


def _model(path: str, mode: str) -> Pieces:
    if (path, mode) not in _models:
        _models[path, mode] = Pieces(path, mode)
    return _models[path, mode]


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "bpe", decoded: bool = False
) -> DataFrame:
    """(id, text, ids) for each row: ids as little-endian unsigned 32-bit numbers, as binary; with decoded, also the text they stand for.

    A null or empty text has no ids and is decoded as an empty one. Words are remembered within a worker, up to a number of
    bytes, so copies and repeated words cost a look-up. A text without spaces is one word, walked with eight bytes a
    character. Repeated rows are encoded each; null ids stay null. Other columns are left out. An empty table gives no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path, mode)
        for b in batches:
            at = 0
            for group in in_groups(binary_list(b.column(1)), GROUP):
                part = b.slice(at, len(group))
                at += len(group)
                ids = model.encode([(t or b"").decode("utf-8", "replace") for t in group])
                columns, names = [*part.columns, pa.array(ids, pa.binary())], ["id", "text", "ids"]
                if decoded:
                    columns, names = [*columns, pa.array(map(model.decode, ids), pa.string())], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    ship(docs.sparkSession)
    kinds = "id long, text string, ids binary" + (", decoded string" if decoded else "")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(each), kinds)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", mode: str = "bpe") -> DataFrame:
    """encoded's columns and `decoded`: the text that the ids stand for (null for null ids). A column of that name is replaced."""
    rest = encoded.drop("decoded")
    place = rest.columns.index(ids_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path, mode)
        for b in batches:
            texts = [None if ids is None else model.decode(ids) for ids in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    ship(encoded.sparkSession)
    return rest.mapInArrow(tidy(each), StructType([*rest.schema.fields, StructField("decoded", StringType())]))
