"""What the corpus operators share: range bounds and ranks; tables in the shared folder are the library's."""

from __future__ import annotations

import bisect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.work import discard, materialize, session_of, settle, work_dir

__all__ = ["discard", "materialize", "session_of", "settle", "work_dir"]

#: Ids that may be gathered to place range bounds, whatever the size of the table.
BOUND_SAMPLE = 50_000


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Ranges:
    """Where rows go that are dealt by ranges of (key, fraction): ``pid`` rises with both, ``count`` is one more than its greatest value.

    A key that has more rows than a range should have is a range of its own, cut by the fraction (a
    uniform number in [0, 1) that follows the rows' order within a key) into as many as it needs.
    """

    def __init__(self, cuts: list[int], pieces: dict[int, int], null_pieces: int, nulls_first: bool) -> None:
        """``pieces``: by position among the ranges between the cuts, into how many it is cut."""
        self.cuts, self.nulls_first = cuts, nulls_first
        own = [pieces.get(i, 1) for i in range(len(cuts) + 1)]
        self.pieces = [null_pieces, *own] if nulls_first else [*own, null_pieces]
        self.first = [sum(self.pieces[:i]) for i in range(len(self.pieces))]
        self.count = sum(self.pieces)

    def pid(self, key: Column, fraction: Column) -> Column:
        null = F.lit(0 if self.nulls_first else len(self.cuts) + 1)
        base = F.when(key.isNull(), null).otherwise(range_index(key, self.cuts) + (1 if self.nulls_first else 0))
        of = lambda numbers: F.get(F.lit(numbers), base)
        if self.count == len(self.pieces):
            return of(self.first)
        return of(self.first) + F.least(F.floor(fraction * of(self.pieces)).cast("int"), of(self.pieces) - 1)


def ranges(keys: DataFrame, column: str, parts: int, nulls_first: bool = False) -> Ranges:
    """About ``parts`` ranges of about as many rows each, which depend on the rows only and not on how they were spread.

    Bounds are chosen among a hash-selected, bounded set of keys, weighed by their rows. At most
    ``parts`` keys have more than a range's rows.
    """
    counts = keys.groupBy(F.col(column).cast("long").alias("v")).agg(F.count("*").alias("n"))
    total, n_keys = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not total:
        return Ranges([], {}, 1, nulls_first)
    share = total / parts
    heavy = {r.v: r.n for r in counts.where(F.col("n") > share).collect()}  # at most `parts` rows
    hot = {v: -(-n * parts // total) for v, n in heavy.items()}
    step = max(1, n_keys // BOUND_SAMPLE)
    some = counts.where(F.col("v").isNotNull() & (F.col("n") <= share) & (F.pmod(F.xxhash64("v"), F.lit(step)) == 0))
    seen = sorted((r.v, r.n) for r in some.collect())  # about BOUND_SAMPLE rows, or 2 BOUND_SAMPLE
    weight, cuts = sum(n for _, n in seen), set()
    upto, left = 0, -(-(total - sum(heavy.values())) * parts // total)
    for v, n in seen:
        if left > 1 and upto * left // weight != (upto + n) * left // weight and v != seen[0][0]:
            cuts.add(v)
        upto += n
    cuts |= {x for v in hot if v is not None for x in (v, min(v + 1, 2**63 - 1))}
    ordered = sorted(cuts)
    at = {bisect.bisect_right(ordered, v): n for v, n in hot.items() if v is not None}
    return Ranges(ordered, at, hot.get(None, 1), nulls_first)


def range_index(column: Column, cuts: list[int]) -> Column:
    """How many cuts are at most the value: a binary search over a literal array; null gives 0."""
    if not cuts:
        return F.lit(0)
    bounds = F.lit([int(x) for x in cuts])
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]

    def step(low: Column, width: Column) -> Column:
        within = low + width <= len(cuts)
        return F.when(within & (F.get(bounds, F.when(within, low + width - 1).otherwise(0)) <= column.cast("long")), low + width).otherwise(low)

    return F.coalesce(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


Query = Callable[[SparkSession, str], DataFrame]
