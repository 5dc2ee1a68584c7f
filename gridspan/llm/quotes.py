"""Quotation linking: what each message quotes, whom it answers, and what it says itself.

Lines that start with ">" are quotes; the number of marks is the level. Consecutive quoted lines of one level
are a passage. Passages and the unquoted lines, paragraphs and texts of messages are normalised (case and white
space) and hashed; a passage links to the latest earlier message of its conversation that says it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspan.llm.common import cut

#: Turns that are put in order by one task; longer conversations are split and joined through block totals.
BLOCK = 256
_MARKS = r"^(?:>\x20?)+"


def _normal(text: Column) -> Column:
    """Lower-cased, with runs of white space as single spaces and none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def own_text(text: Column) -> Column:
    """A message without its quoted lines and without white space at its ends."""
    kept = F.filter(_lines(text), lambda x: ~F.startswith(x, F.lit(">")))
    return F.btrim(F.array_join(kept, "\n"), F.lit(" \t\r\n"))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, line, level, whole, head) for messages(conv_id, turn, mark, text), the mark telling messages of one turn apart.

    line is the passage's first line, whole and head are the hashes of the passage and of its first line.
    """
    key = ["conv_id", "turn", "mark"]
    rows = messages.where(F.regexp_like("text", F.lit(r"(?m)^>"))).select(*key, F.posexplode(_lines(F.col("text"))).alias("line", "content"))
    rows = rows.where(F.startswith("content", F.lit(">")))
    rows = rows.withColumn("level", F.length(F.replace(F.regexp_extract("content", _MARKS, 0), F.lit(" "), F.lit(""))))
    rows = rows.withColumn("content", _normal(F.regexp_replace("content", _MARKS, ""))).where("content <> ''")
    # Lines follow each other within a level exactly while line minus rank stays the same.
    rank = F.row_number().over(Window.partitionBy(*key, "level").orderBy("line"))
    rows = rows.withColumn("run", F.col("line") - rank)
    found = rows.groupBy(*key, "level", "run").agg(F.sort_array(F.collect_list(F.struct("line", "content"))).alias("x"))
    whole = F.md5(F.array_join(F.col("x.content"), " ").cast("binary"))
    return found.select(*key, F.col("x")[0]["line"].alias("line"), "level", whole.alias("whole"), F.md5(F.col("x")[0]["content"].cast("binary")).alias("head"))


def sayings(messages: DataFrame) -> DataFrame:
    """Distinct (conv_id, hash, turn): the hashes of each message's own text, paragraphs and lines."""
    own = messages.select("conv_id", "turn", own_text(F.col("text")).alias("text"))
    parts = F.concat(F.array("text"), _lines(F.col("text")), F.split("text", r"\n[\x20\t\r]*\n\s*"))
    rows = own.select("conv_id", "turn", F.explode(F.transform(parts, _normal)).alias("part")).where("part <> ''")
    return rows.select("conv_id", F.md5(F.col("part").cast("binary")).alias("hash"), "turn").distinct()


def _latest_before(asked: DataFrame, said: DataFrame, keys: list[str]) -> DataFrame:
    """asked(keys, turn, ...) with `before`: the greatest turn of said(keys, turn) with equal keys that is less than turn.

    Works through blocks of turns, so one key's many turns are not ordered in one task.
    """
    block = F.floor(F.col("turn") / BLOCK)
    asked = asked.withColumn("block", block)
    said = said.select(*keys, "turn", block.alias("block")).distinct()
    both = asked.select(*keys, "block", "turn", F.lit(None).cast("long").alias("own")).union(said.select(*keys, "block", "turn", F.col("turn").alias("own"))).distinct()
    inside = Window.partitionBy(*keys, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("own").over(inside)).where("own is null").drop("own")
    blocks = both.groupBy(*keys, "block").agg(F.max("own").alias("top"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("far", F.max("top").over(earlier)).drop("top")
    found = near.join(blocks, [*keys, "block"]).select(*keys, "turn", F.coalesce("near", "far").alias("before"))
    return asked.join(found, [*keys, "turn"]).drop("block")


def link_quotes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each message, in reply order, without quotes.

    Gives (conv_id, position, turn, role, text, reply_to, by_quote, n_quotes, n_linked, max_level). position
    counts the messages of a conversation from 0 by (turn, role, text), so each comes after what it answers.
    reply_to is the turn of the message that the first linked passage quotes (by_quote true), else the turn
    before (false); null for a first turn. A null text is kept as null and quotes nothing. Messages without conversation or
    turn get null position and reply_to, and are quoted by none. Repeated rows are each returned. Passages that no
    earlier message of the conversation says count in n_quotes only. Empty texts say and quote nothing, long ones are used whole, and
    other columns are not looked at, whatever their names. An empty table gives no rows.
    """
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    rows = rows.withColumn("mark", F.md5(F.concat_ws("|", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).cast("binary")))
    sound = rows.where("conv_id is not null and turn is not null")
    asking = sound.where(F.regexp_like("text", F.lit(r"(?m)^>"))).select("conv_id", "turn", "mark", "text").distinct()
    quotes = cut(quoted_passages(asking))
    asked = quotes.select("conv_id", "turn", F.explode(F.array("whole", "head")).alias("hash")).distinct()
    # Only what conversations with quotes say is hashed, and only what is asked for is kept.
    talk = sound.where("text is not null").join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    said = sayings(talk).join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    answers = cut(_latest_before(asked, said, ["conv_id", "hash"]))
    links = quotes
    for name in ("whole", "head"):
        found = answers.select("conv_id", "turn", F.col("hash").alias(name), F.col("before").alias(f"{name}_turn"))
        links = links.join(found, ["conv_id", "turn", name])
    links = links.withColumn("source", F.coalesce("whole_turn", "head_turn"))
    stats = links.groupBy("conv_id", "turn", "mark").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"), F.max("level").alias("max_level"), F.min(F.when(F.col("source").isNotNull(), F.struct("line", "source"))).alias("first")
    )
    block = F.floor(F.col("turn") / BLOCK)
    blocks = sound.groupBy("conv_id", block.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("top"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.max("top").over(earlier).alias("far"))
    here = Window.partitionBy("conv_id", "block")
    place = F.row_number().over(here.orderBy("turn", "role", "text"))
    near = F.max("turn").over(here.orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    placed = sound.withColumn("block", block).withColumns({"place": place, "near": near}).join(blocks, ["conv_id", "block"])
    placed = placed.withColumn("before", F.coalesce("near", "far")).join(cut(stats), ["conv_id", "turn", "mark"], "left")
    zero = F.lit(0).cast("long")
    out = placed.select(
        "conv_id",
        (F.col("base") + F.col("place") - 1).alias("position"),
        "turn",
        "role",
        own_text(F.col("text")).alias("text"),
        F.coalesce("first.source", "before").alias("reply_to"),
        F.col("first").isNotNull().alias("by_quote"),
        F.coalesce("n_quotes", zero).alias("n_quotes"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        F.coalesce(F.col("max_level").cast("long"), zero).alias("max_level"),
    )
    none = F.lit(None).cast("long")
    odd = rows.where("conv_id is null or turn is null")
    return out.union(odd.select("conv_id", none, "turn", "role", own_text(F.col("text")), none, F.lit(False), zero, zero, zero))


#: The same result in DuckDB, for tables without null conversations or turns.
SQL = r"""
WITH base AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text,
         md5(concat_ws('|', coalesce(role, ''), coalesce(text, ''))) AS mark,
         trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '>')), chr(10)), ' ' || chr(9) || chr(13) || chr(10)) AS own
  FROM conversations
), talk AS (SELECT DISTINCT conv_id, turn, mark, text, own FROM base WHERE text IS NOT NULL),
lines AS (
  SELECT conv_id, turn, mark, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS line FROM talk
), quoted AS (
  SELECT conv_id, turn, mark, line, length(replace(regexp_extract(content, '^(?:>\x20?)+'), ' ', '')) AS level,
         trim(regexp_replace(lower(regexp_replace(content, '^(?:>\x20?)+', '')), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS content
  FROM lines WHERE starts_with(content, '>')
), ranked AS (
  SELECT *, line - row_number() OVER (PARTITION BY conv_id, turn, mark, level ORDER BY line) AS run FROM quoted WHERE content <> ''
), passages AS (
  SELECT conv_id, turn, mark, level, min(line) AS line, md5(string_agg(content, ' ' ORDER BY line)) AS whole, md5(arg_min(content, line)) AS head
  FROM ranked GROUP BY conv_id, turn, mark, level, run
), parts AS (
  SELECT conv_id, turn, unnest(list_concat([own], string_split(own, chr(10)), regexp_split_to_array(own, '\n[\x20\t\r]*\n\s*'))) AS part FROM talk
), said AS (
  SELECT DISTINCT conv_id, turn, md5(trim(regexp_replace(lower(part), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS hash
  FROM parts WHERE trim(regexp_replace(part, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') <> ''
), linked AS (
  SELECT p.*, coalesce((SELECT max(s.turn) FROM said s WHERE s.conv_id = p.conv_id AND s.hash = p.whole AND s.turn < p.turn),
                       (SELECT max(s.turn) FROM said s WHERE s.conv_id = p.conv_id AND s.hash = p.head AND s.turn < p.turn)) AS source
  FROM passages p
), stats AS (
  SELECT conv_id, turn, mark, count(*) AS n_quotes, count(source) AS n_linked, max(level) AS max_level,
         arg_min(source, line) FILTER (WHERE source IS NOT NULL) AS first
  FROM linked GROUP BY conv_id, turn, mark
)
SELECT b.conv_id, row_number() OVER (PARTITION BY b.conv_id ORDER BY b.turn, b.role NULLS FIRST, b.text NULLS FIRST) - 1 AS position,
       b.turn, b.role, b.own AS text,
       coalesce(s.first, (SELECT max(p.turn) FROM base p WHERE p.conv_id = b.conv_id AND p.turn < b.turn)) AS reply_to,
       s.first IS NOT NULL AS by_quote, coalesce(s.n_quotes, 0) AS n_quotes, coalesce(s.n_linked, 0) AS n_linked,
       CAST(coalesce(s.max_level, 0) AS BIGINT) AS max_level
FROM base b LEFT JOIN stats s ON b.conv_id = s.conv_id AND b.turn = s.turn AND b.mark = s.mark
"""
