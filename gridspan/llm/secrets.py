"""Secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean query: alternatives, each a set of trigrams that a match must
contain. Postings of the rules' trigrams are built over all distinct texts, intersected alternative by
alternative, and only the candidate texts are searched with the rule's regex. Rules without mandatory
trigrams scan every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.llm.common import cut


@dataclass(frozen=True)
class Rule:
    """kind names the rule in spans; a match counts if its `group` has `least` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    any_case: bool = False


#: The first three are the base rules; runs of one character class have their least length written into the regex.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Candidate texts up to which their keys (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
MOST_ALTERNATIVES = 64


def _literals(parsed: object) -> list[list[str]]:
    """Alternatives of a parsed regex, each a list of the literal runs of any match; a gap ends a run.

    A run is marked "open" at its ends by being kept as a plain string in a list where "" stands for a gap.
    """
    out: list[list[str]] = [[""]]

    def joined(a: list[str], b: list[str]) -> list[str]:
        return [*a[:-1], a[-1] + b[0], *b[1:]]

    for op, arg in parsed:
        if op is sre.LITERAL:
            parts = [[chr(arg)]]
        elif op is sre.SUBPATTERN:
            parts = _literals(arg[3])
        elif op is sre.BRANCH:
            parts = [x for branch in arg[1] for x in _literals(branch)]
        elif op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
            parts = [[chr(c)] for _, c in arg]
        elif op is sre.MAX_REPEAT and (arg[0], arg[1]) == (0, 1) and all(o is sre.LITERAL for o, _ in arg[2]):
            parts = [[""], *_literals(arg[2])]
        elif op is sre.MAX_REPEAT and arg[0] >= 1 and all(o is sre.LITERAL for o, _ in arg[2]):
            parts = [[x[0] * arg[0], ""] if arg[1] != arg[0] else [x[0] * arg[0]] for x in _literals(arg[2])]
        elif op is sre.AT:
            parts = [[""]]
        else:
            parts = [["", ""]]
        if len(out) * len(parts) > MOST_ALTERNATIVES:
            parts = [["", ""]]
        out = [joined(a, b) for a in out for b in parts]
    return out


def trigram_query(rule: Rule) -> list[set[str]] | None:
    """Alternatives of which one must have all its trigrams in the lower-cased text; None if some match needs none."""
    found = []
    for runs in _literals(sre_parser.parse(rule.regex)):
        grams = {x[i : i + 3].lower() for x in runs for i in range(len(x) - 2)}
        if not grams:
            return None
        if grams not in found:
            found.append(grams)
    return [g for g in found if not any(h < g for h in found)]


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """(key, trigram, number) for texts(key, text): which of `grams` the lower-cased text of each key contains."""
    low = texts.select("key", F.lower("text").alias("low"))
    hits = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(g)), F.struct(F.lit(g).alias("trigram"), F.lit(n).alias("number"))) for n, g in enumerate(grams))))
    return low.select("key", F.explode(hits).alias("x")).select("key", "x.trigram", "x.number")


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds) of the texts whose postings satisfy the query of at least one rule that has one."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r)) is not None}
    if not queries:
        return texts.select("key", F.array(F.lit("")).alias("kinds")).limit(0)
    grams = sorted({g for q in queries.values() for a in q for g in a})
    words = (len(grams) + 61) // 62
    # A posting list may name every text, so the lists are intersected as rows: each text gathers the
    # trigrams that list it as bits, pre-aggregated before the shuffle.
    bits = [F.bit_or(F.expr(f"if(number div 62 = {i}, shiftleft(1L, cast(number % 62 as int)), 0L)")).alias(f"m{i}") for i in range(words)]
    met = postings(texts, grams).groupBy("key").agg(*bits)
    kinds = []
    for kind, alternatives in queries.items():
        tests = []
        for alternative in alternatives:
            masks = [sum(1 << n % 62 for n, g in enumerate(grams) if g in alternative and n // 62 == i) for i in range(words)]
            tests.append(_all([F.col(f"m{i}").bitwiseAND(F.lit(m).cast("long")) == m for i, m in enumerate(masks)]))
        kinds.append(F.when(_any(tests), F.lit(kind)))
    met = met.select("key", F.array_compact(F.array(*kinds)).alias("kinds"))
    return met.where(F.size("kinds") > 0)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's leftmost non-overlapping matches in code points."""
    regex = ("(?i)" if rule.any_case else "") + rule.regex
    none = "cast(array() as array<struct<start:int,end:int,kind:string>>)"
    pieces = F.struct(F.split(text, regex).alias("gap"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(regex), F.lit(rule.group)).alias("part"))

    def place(p: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            start = a["at"] + F.length(p["gap"][i])
            end = start + F.length(p["hit"][i])
            span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind")))
            good = F.length(p["part"][i]) >= rule.least
            return F.struct(end.alias("at"), F.when(good, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.expr(none).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(p["hit"]) - 1), begin, step, lambda a: a["out"])

    found = F.transform(F.array(pieces), lambda p: F.when(F.size(p["hit"]) > 0, place(p)).otherwise(F.expr(none)))[0]
    return F.when(F.regexp_like(text, F.lit(regex)), found).otherwise(F.expr(none))


def scan_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a column `secrets`: array<struct<start, end, kind>> by start, then rule order; code points, end exclusive.

    Spans of different kinds may overlap. A null or empty text has none. Repeated rows are each scanned; the
    index holds each distinct text once, so large groups of copies do not lengthen posting lists. A column
    of docs named `secrets` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Equal keys of unequal texts would only add a candidate; the regex decides.
    keyed = docs.drop("secrets").withColumn("__key", F.xxhash64(text))
    met = cut(candidates(docs.select(F.xxhash64(text).alias("key"), text.alias("text")), rules))
    met = met.select(F.col("key").alias("__key"), F.col("kinds").alias("__kinds"))
    keyed = keyed.join(F.broadcast(met) if met.count() <= BROADCAST_KEYS else met, "__key", "left")
    order = {r.kind: i for i, r in enumerate(rules)}
    parts = []
    for rule in rules:
        spans = _spans(text, rule)
        if trigram_query(rule) is not None:
            spans = F.when(F.array_contains("__kinds", rule.kind), spans).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)"))
        rank = F.lit(order[rule.kind])
        parts.append(F.transform(spans, lambda s, rank=rank: F.struct(s["start"], rank.alias("rank"), s["end"], s["kind"])))
    merged = F.array_sort(F.concat(*parts))
    merged = F.transform(merged, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return keyed.withColumn("secrets", merged).select(*[c for c in docs.columns if c != "secrets"], "secrets")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], gap).otherwise(a["out"]).alias("out"))

    # From the code point after the last span to the end.
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))
