"""Minimax contiguous sharding of documents, with groups of equal texts kept whole.

Equal texts have the same hash; the groups, in hash order, are the ordered atomic groups whose sizes
are to be cut. There are too many for the driver, so it sees them as blocks: ranges of hashes, at
first by their first bits. A block of one group is atomic, any other could be cut somewhere inside.
The smallest capacity for which a greedy cut needs no more than the wanted shards is found by binary
search, as if such blocks could be cut anywhere: no true partition has a smaller one. The blocks that
its cuts fall into, and some around them, are then counted by further bits, until all cuts lie
between blocks. So the capacity is the least one for the groups themselves, though only a few blocks
were ever looked into. The cuts, at most ``shards - 1`` numbers, go back into the plan as a literal.

Everything that touches rows is DataFrame expressions. A row's slot comes from counts by (shard,
part), where parts are the tasks that read the rows, and a rank within these: no key gathers rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import materialize, table, text_or_empty

#: Hash bits that tell the first blocks apart, and those that a further count adds.
FIRST_BITS, MORE_BITS = 16, 10
#: Blocks with so many rows together are taken apart into their groups at once.
SINGLE_ROWS = 100_000
#: Blocks on either side of a cut's block that are counted with it.
AROUND = 4


class Block(NamedTuple):
    """A range of hashes: its least and greatest one, the size of its rows, their number, and how many bits it may still be told apart by."""

    low: int
    high: int
    size: int
    rows: int
    bits: int

    @property
    def atomic(self) -> bool:
        return self.low == self.high


def fits(prefix: list[int], capacity: int, shards: int) -> bool:
    """Whether greedy cutting needs at most that many shards of that capacity."""
    at = 0
    for _ in range(shards):
        at = bisect_right(prefix, prefix[at] + capacity) - 1
        if at == len(prefix) - 1:
            return True
    return False


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The smallest largest shard of any contiguous partition."""
    prefix = [0, *accumulate(sizes)]
    low, high = max([0, *sizes, -(-prefix[-1] // shards)]), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(prefix, middle, shards) else (middle + 1, high)
    return low


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Where each shard but the first begins. No shard exceeds the smallest capacity.

    Greedy cuts fill the first shards and starve the last; among the cuts that keep the capacity,
    each one is therefore put nearest to an equal share of what is left.
    """
    prefix = [0, *accumulate(sizes)]
    capacity, n = smallest_capacity(sizes, shards), len(sizes)
    least = [n]  # by shards left: from where on these hold all that follows
    for _ in range(shards):
        least.append(bisect_left(prefix, prefix[least[-1]] - capacity))
    cuts, at = [], 0
    for left in range(shards - 1, 0, -1):
        share = prefix[at] + (prefix[-1] - prefix[at]) / (left + 1)
        near = bisect_left(prefix, share)
        if near > at and share - prefix[near - 1] <= prefix[min(near, n)] - share:
            near -= 1
        at = min(max(near, least[left], at), bisect_right(prefix, prefix[at] + capacity) - 1)
        cuts.append(at)
    return cuts


def divided(blocks: list[Block], prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """The blocks that greedy cuts of that capacity fall into, if blocks that aren't atomic can be cut anywhere; None if it needs more shards."""
    at, inside = 0, []
    for _ in range(shards):
        at += capacity
        if at >= prefix[-1]:
            return inside
        i = bisect_right(prefix, at) - 1
        if at > prefix[i]:
            if blocks[i].atomic:
                at = prefix[i]
            else:
                inside.append(i)
    return None


def open_blocks(blocks: list[Block], shards: int) -> list[int]:
    """The blocks to look into: none if the smallest capacity is known."""
    prefix = [0, *accumulate(b.size for b in blocks)]
    low, high = -(-prefix[-1] // shards), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if divided(blocks, prefix, middle, shards) is not None else (middle + 1, high)
    inside = divided(blocks, prefix, low, shards)
    near = {j for i in inside for j in range(max(0, i - AROUND), min(len(blocks), i + AROUND + 1))}
    return sorted(j for j in near if not blocks[j].atomic)


def counted(rows: DataFrame, bits: int, *keys) -> list[Block]:
    found = rows.groupBy(*keys).agg(F.min("h").alias("low"), F.max("h").alias("high"), F.sum("size").alias("size"), F.count("*").alias("rows"))
    return [Block(r.low, r.high, r.size, r.rows, bits) for r in found.select("low", "high", "size", "rows").collect()]


def looked_into(rows: DataFrame, blocks: list[Block], chosen: list[int]) -> list[Block]:
    """The blocks with the chosen ones replaced by smaller ones: their groups, if these are few, else by more bits."""
    parts = [blocks[i] for i in chosen]
    bits = min(b.bits for b in parts)
    bits = 0 if sum(b.rows for b in parts) <= SINGLE_ROWS else max(0, bits - MORE_BITS)
    nth = F.coalesce(*[F.when(F.col("h").between(b.low, b.high), i) for i, b in enumerate(parts)])  # a few dozen
    smaller = counted(rows.withColumn("nth", nth).where("nth IS NOT NULL"), bits, "nth", F.shiftright("h", bits))
    left = set(chosen)
    return sorted([b for i, b in enumerate(blocks) if i not in left] + smaller)


def cuts_of(rows: DataFrame, shards: int, first_bits: int = FIRST_BITS) -> list[int]:
    """The hash that each shard but the first begins with; shards without rows at the end have none."""
    bits = 64 - first_bits
    blocks = sorted(counted(rows, bits, F.shiftright("h", bits)))  # at most 2 ** first_bits
    while chosen := open_blocks(blocks, shards) if blocks else []:
        blocks = looked_into(rows, blocks, chosen)
    return [blocks[i].low for i in minimax_cuts([b.size for b in blocks], shards) if i < len(blocks)]


def shard(docs: DataFrame, shards: int = 8, first_bits: int = FIRST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    A null text counts as empty; empty and null texts are one group; a null id is an id like others.
    Repeated rows each get a slot. Texts of any length are hashed whole, and none is shuffled.
    Columns besides id and text are ignored. A table without rows gives none. One group larger than
    a shard's share makes a shard of its own as far as its order allows.
    """
    text = text_or_empty(text_col)
    size = (F.octet_length(text) + 1).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.spark_partition_id().alias("part"))
    rows = materialize(rows, "shard-rows")
    passed = [F.when(F.col("h") >= low, 1).otherwise(0) for low in cuts_of(rows, shards, first_bits)]
    rows = rows.withColumn("shard", reduce(Column.__add__, passed, F.lit(0)))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("h", "doc_id")) - 1
    slot = (F.col("first") + F.col("rank")).cast("long").alias("slot")
    return rows.withColumn("rank", rank).join(first, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))


def op4_minimax_shards(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
