"""Packing token sequences into windows, best fit decreasing.

Documents are tokenised once, cut into full windows and a rest, and the pieces written down. Of a
piece only its length matters for the packing, so best fit decreasing is run on the driver over the
counts by length: at most ``window`` numbers, whatever the table's size. A segment tree indexed by
remaining capacity gives the tightest open windows; equal windows are filled together, exactly as
one after another would be. The plan that comes out maps (length, rank among the pieces of that
length) to a window and an offset.

The cutting task numbers its pieces of each length as it goes; a piece's rank is that number and the
count of such pieces in the tasks before. So no rows are sorted or shuffled for it, and the number of
parts grows with the table. Full windows take no part in the packing: their rank is their window.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import materialize, session_of, table, text_or_empty

WINDOW = 2048
#: Ends every document.
END = 1
#: The public tokenizer, and the same vocabulary as ranks.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Texts that the fast encoder can't take: with the added token's string, or a run of white space that its pattern can't hold.
ADDED, LONG_RUN = "<|endoftext|>", 100_000
_RUN = re.compile(rf"\s{{{LONG_RUN}}}")

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def encoder(tokenizer: str | None = None, ranks: str | None = None) -> Callable[[str], list[int]]:
    """Text to the ids of ``tokenizers`` without special tokens around it.

    Ordinary texts are encoded from the same vocabulary's ranks, which takes a third of the time;
    the others by the tokenizer itself. The paths are those of the public files by default.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("bytes-50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary
    whole: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if ADDED not in text and (len(text) < LONG_RUN or not _RUN.search(text)):
            return fast(text)
        if not whole:
            whole.append(Tokenizer.from_file(tokenizer or public_tokenizers.path(TOKENIZER)))
        return whole[0].encode(text, add_special_tokens=False).ids

    return encode


_encoders: dict = {}


def _cutter(window: int, paths: tuple[str | None, str | None]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if paths not in _encoders:
            _encoders[paths] = encoder(*paths)
        encode, part, seen = _encoders[paths], TaskContext.get().partitionId(), Counter()
        for batch in batches:
            row, start, length, crc, total, nth = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py())
                ids.append(END)
                held = np.array(ids, "<u4")
                for at in range(0, len(held), window):
                    piece = held[at : at + window]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    total.append(len(held))
                    nth.append(seen[len(piece)])
                    seen[len(piece)] += 1
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            numbers = [pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *longs, *numbers], names=[x.split()[0] for x in PIECE.split(", ")])

    return cut


def pieces(docs: DataFrame, window: int = WINDOW, paths: tuple[str | None, str | None] = (None, None), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut into full windows and a rest; ``nth`` counts the task's pieces of that length."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_cutter(window, paths), PIECE)


class CapacityTree:
    """A segment tree over remaining capacities 0..n: which is the smallest one, at least r, with open windows."""

    def __init__(self, n: int) -> None:
        self.size = 1 << n.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, r: int, open_: bool) -> None:
        at = r + self.size
        self.open[at] = open_
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, r: int) -> int | None:
        at = r + self.size
        if self.open[at]:
            return at - self.size
        while at > 1:  # up to the first ancestor with something open to the right, then down to its leftmost
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


@dataclass
class Plan:
    """Runs: pieces of ``length`` with ranks from ``rank`` on, ``count`` of them, ``each`` to a window, go to windows from ``window`` on, from ``offset`` on."""

    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    windows: int = 0


def best_fit_decreasing(counts: dict[int, int], window: int) -> Plan:
    """The windows that best fit decreasing fills from so many pieces of each length.

    Windows of equal remaining capacity are equal, so they are kept as ranges of window numbers.
    With best fit a window that still holds another piece of the same length is the tightest one,
    so a range is filled with as many pieces a window as go in.
    """
    plan, tree, held = Plan(), CapacityTree(window), {}

    def put(r: int, first: int, n: int) -> None:
        if n and r:
            held.setdefault(r, []).append((first, n))
            tree.set(r, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                each = window // length
                r, first, n = window, plan.windows, -(-left // each)
                plan.windows += n
            else:
                each = r // length
                first, n = held[r].pop()
                if not held[r]:
                    tree.set(r, False)
                need = -(-left // each)
                if need < n:
                    put(r, first + need, n - need)
                    n = need
            used = min(left, n * each)
            plan.runs.append((length, rank, used, first, each, window - r))
            full, rest = divmod(used, each)
            put(r - each * length, first, full)
            if rest:
                put(r - rest * length, first + full, 1)
            left, rank = left - used, rank + used
    return plan


def packed(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with sequence_id and offset. Pieces must be at most a window long."""
    cut = materialize(cut, "pieces")
    counts = materialize(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    full = lengths.pop(window, 0)
    plan = best_fit_decreasing(lengths, window)
    names = "of long, rank long, count long, first long, each long, base long"
    runs = session_of(cut).createDataFrame(plan.runs, names)  # follows from lengths only, a few thousand rows at any size
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(first, ["length", "part"]).withColumn("place", F.col("nth") + F.col("before"))
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = ranked.where(F.col("length") == window).select(*own, F.col("place").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = ranked.where(F.col("length") < window)
    found = rest.join(F.broadcast(runs), (F.col("length") == F.col("of")) & (F.col("place") >= F.col("rank")) & (F.col("place") < F.col("rank") + F.col("count")))
    nth = F.col("place") - F.col("rank")
    sequence = F.lit(full) + F.col("first") + F.floor(nth / F.col("each"))
    found = found.select(*own, sequence.cast("long").alias("sequence_id"), (F.col("base") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"))
    return whole.unionByName(found)


def pack(docs: DataFrame, window: int = WINDOW, paths: tuple[str | None, str | None] = (None, None), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of each row.

    A null or empty text is the end id alone. A null id and repeated rows are packed like any other;
    other columns are ignored; no rows give no rows. Which of the pieces of one length goes to which
    of their places follows the tasks' order; a text of any length is held by one task, with its ids.
    """
    return packed(pieces(docs, window, paths, id_col, text_col), window)


def op3_pack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
