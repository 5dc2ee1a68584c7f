"""Contiguous shards with the smallest possible largest shard.

The atomic groups are the distinct texts, ordered by their hash (equal 64-bit hashes count as equal texts). The
smallest capacity with which greedy filling needs no more shards than allowed is found by binary search. The ordered list
of sizes is never gathered: the search runs on the totals of ranges of hashes, and whenever a cut would fall
inside a range of several texts, that range alone is divided further, by a query over the distinct texts, until
every cut of the smallest capacity, and of the next smaller one that fails, lies between two single texts. The ranges
number CELLS and PARTS more for each range divided, whatever the corpus.

A text whose copies exceed that capacity has a shard to itself, so one large group of copies does not widen the others;
within the capacity, shards are then cut near equal shares of what is left, and none stays empty while texts suffice.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspan.llm.common import Scratch

#: Bits of a hash that number the first ranges, and further bits by which a range is divided.
CELL_BITS, PART_BITS = 14, 8
OVERHEAD = 16

Range = tuple[int, int, int, int]  # first hash, bits of it that all its texts share, total size, number of texts


def _ranges(groups: DataFrame, bits: Column) -> list[Range]:
    """Totals of groups(hash, size) by the first `bits` bits of the hash, in order."""
    low = F.expr("shiftleft(shiftright(hash, 64 - bits), 64 - bits)")
    low = F.when(F.col("bits") >= 64, F.col("hash")).otherwise(low)
    found = groups.withColumn("bits", bits).groupBy(low.alias("low"), "bits").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return sorted((r["low"], r["bits"], r["size"], r["n"]) for r in found.collect())


def _cuts(prefix: list[int], capacity: int, most: int) -> list[int]:
    """Places at which greedy filling begins a new shard, up to `most` + 1 of them; an element above the capacity is alone."""
    out, at, n = [], 0, len(prefix) - 1
    while at < n and len(out) <= most:
        at = max(at + 1, bisect_right(prefix, prefix[at] + capacity) - 1)
        if at < n:
            out.append(at)
    return out


def capacity_of(prefix: list[int], shards: int) -> int:
    """The smallest capacity with which greedy filling packs elements with these sums into `shards` shards, larger ones being alone in one."""
    low, high = 0, prefix[-1]
    while low < high:
        middle = (low + high) // 2
        if len(_cuts(prefix, middle, shards)) < shards:
            high = middle
        else:
            low = middle + 1
    return low


def _unsure(ranges: list[Range], prefix: list[int], capacity: int, shards: int) -> set[int]:
    """Ranges of several texts that a cut of this capacity might fall into: those before which one lies, and those alone above the capacity."""
    cuts = _cuts(prefix, capacity, shards)
    begins = [0, *cuts][: shards + 1]
    return {i for i in {*cuts, *begins} if ranges[i][3] > 1 and (i in cuts or ranges[i][2] > capacity)}


def search(groups: DataFrame, shards: int) -> tuple[int, list[Range]]:
    """The smallest capacity over single groups(hash, size), and ranges in order between which its cuts lie."""
    ranges = _ranges(groups, F.lit(CELL_BITS))
    while ranges:
        prefix = list(accumulate((r[2] for r in ranges), initial=0))
        capacity = capacity_of(prefix, shards)
        unsure = _unsure(ranges, prefix, capacity, shards) | _unsure(ranges, prefix, capacity - 1, shards)
        if not unsure:
            return capacity, ranges
        inside, bits = F.lit(False), F.lit(None).cast("int")
        for i in sorted(unsure):
            low, known, _, _ = ranges[i]
            within = F.col("hash").between(low, low + (1 << (64 - known)) - 1)
            inside, bits = inside | within, F.when(within, min(known + PART_BITS, 64)).otherwise(bits)
        parts = _ranges(groups.where(inside), bits)
        ranges = sorted([r for i, r in enumerate(ranges) if i not in unsure] + parts)
    return 0, []


def fill(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Places at which shards after the first begin: within the capacity near equal shares of what is left, none empty while elements suffice."""
    n, left = len(sizes), sum(x for x in sizes if x <= capacity)
    alone = sum(x > capacity for x in sizes)
    # Element k: the first place from which k + 1 shards suffice.
    last, load = [], 0
    for i in range(n - 1, -1, -1):
        if load and load + sizes[i] > capacity:
            last.append(i + 1)
            load = 0
        load += sizes[i]
    starts, load = [], 0
    for i, x in enumerate(sizes):
        open_ = shards - len(starts)
        share = left / max(open_ - alone, 1)
        suffice = i >= (last[open_ - 2] if 0 <= open_ - 2 < len(last) else 0)
        early = open_ > 1 and (n - i < open_ or (2 * load + x > 2 * share and suffice))
        if load and (load + x > capacity or early):
            if load > capacity:
                alone -= 1
            else:
                left -= load
            starts.append(i)
            load = 0
        load += x
    return starts


def shard_starts(groups: DataFrame, shards: int) -> list[int]:
    """First hash of each shard after shard 0, for groups(hash, size): contiguous in hash order, the largest shard as small as possible."""
    capacity, ranges = search(groups, shards)
    return [ranges[i][0] for i in fill([r[2] for r in ranges], capacity, shards)]


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs.

    Law "bytes": shards are near equal in bytes, as far as copies of one text allow, which all go to one shard.
    A row's size is its UTF-8 length plus 16; a null text counts as empty, and very long ones are only hashed. Slots number the
    rows of a shard from 0 without gaps, by input partition, then id, checksum and size, ties in any order. They are found from
    counts by input partition, so neither a shard nor a group of copies is ever gathered in one task. Null ids are numbered like
    others. Other columns are left out. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        F.spark_partition_id().alias("part"),
    )
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(rows)
    groups = scratch.write(rows.groupBy("hash").agg(F.sum("size").alias("size")))
    reached = [F.when(F.col("hash") >= s, 1).otherwise(0) for s in shard_starts(groups, shards)]
    rows = rows.withColumn("shard", sum(reached, F.lit(0)))
    counts = rows.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("part", "shard").orderBy("id", "text_crc32", "size")
    rows = rows.withColumn("place", F.row_number().over(within)).join(counts, ["part", "shard"])
    return rows.select(
        "id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
