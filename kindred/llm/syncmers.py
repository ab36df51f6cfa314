"""Document fingerprints of closed syncmers.

A window of ``K`` code points is chosen if the least of its inner substrings of ``S`` code points is
its first or last one. That depends on the window alone, so equal passages give equal anchors
wherever they stand, and anchors of two texts can be matched with their positions. A fingerprint is
the ``KEPT`` least hashes of a text's anchors; two fingerprints' likeness estimates the Jaccard
similarity of the texts' anchors.

Positions tell more than the sketch: ``aligned`` is the share of a text's anchors that another text
has in the same order, found among all anchors that are unique in both. A passage that two long texts
share is seen there however small a part of them it is.

The query also fingerprints each text with its end replaced by the beginning of the next document.
Rows are dealt by ranges of descending doc_id and sorted; neighbours then meet in one task, and the
first row of each range travels to the range before as well, so that texts are shuffled once. An id
that many rows have, or null, is spread over several ranges by the hash of its texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import partitions_of, ranges, session_of, table, text_or_empty
from kindred.llm.hashing import BASE, GOLD, U, mix

K, S = 16, 8
KEPT = 64
#: Texts are hashed in blocks of so many code points, so that memory is bounded by the text itself.
BLOCK = 1 << 20


def _rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of each run of ``width`` codes, by doubling; width is a power of two."""
    out, done, factor = codes.astype(U), 1, int(BASE)
    while done < width:
        out = out[:-done] * U(factor) + out[done:]
        factor, done = factor * factor % (1 << 64), 2 * done
    return out


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers; a text shorter than k is one anchor, an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(codes) < k:
        whole = int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=8).digest(), "little")
        return (np.zeros(1, np.int64), np.array([whole], U)) if len(codes) else (np.empty(0, np.int64), np.empty(0, U))
    places, hashes = [], []
    for at in range(0, len(codes) - k + 1, BLOCK):
        part = codes[at : at + BLOCK + k - 1]
        inner, inside, n = mix(_rolling(part, s)), k - s + 1, len(part) - k + 1
        least = inner[:n]
        for i in range(1, inside):
            least = np.minimum(least, inner[i : i + n])
        chosen = np.flatnonzero((least == inner[:n]) | (least == inner[inside - 1 : inside - 1 + n]))
        # the first and the last inner substring cover the window if it isn't longer than both
        window = inner[chosen] * BASE + inner[chosen + k - s] if 2 * s >= k else _rolling(part, k)[chosen]
        places.append(chosen + at)
        hashes.append(mix(window + GOLD))
    return np.concatenate(places), np.concatenate(hashes)


def least_hashes(hashes: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The least distinct 32-bit hashes of the anchors, ascending."""
    found = (hashes >> U(32)).astype(np.uint32)
    if len(found) > 4 * kept:
        some = np.unique(np.partition(found, 2 * kept)[: 2 * kept])
        if len(some) >= kept:
            return some[:kept]
    return np.unique(found)[:kept]


def sketch(text: str, kept: int = KEPT) -> np.ndarray:
    return least_hashes(anchors(text)[1], kept)


def fingerprint(held: np.ndarray) -> str:
    """Eight hexadecimal digits a hash."""
    return held.astype(">u4").tobytes().hex()


def parsed(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Of the least ``kept`` hashes of both together, the share that both have; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:kept]
    return float(np.isin(union, a, assume_unique=True).astype(int) @ np.isin(union, b, assume_unique=True).astype(int)) / len(union)


Anchors = tuple[np.ndarray, np.ndarray]


def single(found: Anchors) -> Anchors:
    """The anchors that occur once in their text: hashes ascending, and their positions."""
    places, hashes = found
    keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
    return keys[n == 1], places[first[n == 1]]


def met(a: Anchors, b: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two texts of the anchors that are single in either, by position in the first. Both are given as ``single`` gives them."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    order = np.argsort(a[1][i])
    return a[1][i][order], b[1][j][order]


def matches(a: str, b: str) -> list[tuple[int, int]]:
    """Positions of equal anchors that are unique in either text, by position in a."""
    left, right = met(single(anchors(a)), single(anchors(b)))
    return list(zip(left.tolist(), right.tolist(), strict=True))


def in_order(places: np.ndarray) -> int:
    """How many of the places at most rise one after the other."""
    if (places[1:] > places[:-1]).all():
        return len(places)
    ends: list[int] = []
    for x in places.tolist():
        if not ends or x > ends[-1]:
            ends.append(x)
        else:
            ends[bisect_left(ends, x)] = x
    return len(ends)


def aligned(a: Anchors, b: Anchors) -> float:
    """The share of the first text's single anchors that the second has in the same order; texts without any are alike."""
    if not len(a[0]):
        return float(not len(b[0]))
    return in_order(met(a, b)[1]) / len(a[0])


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the next one's beginning, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, aligned_edited double, aligned_next double"


def _pairer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, doc_id, text, extra) in order; extra rows only follow the last row of their range."""
    names = [x.split()[0] for x in OUT.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in OUT.split(", ")]
    before, out = None, []

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for pid, key, value, extra in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            text = value.as_py()
            found = anchors(text)
            held, own = least_hashes(found[1]), single(found)
            if before and before[0] == pid:
                _, last, old, first, once, done = before
                if not done:
                    changed = edited(old, text)
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    new = anchors(changed) if changed != old else None
                    later, after = (least_hashes(new[1]), single(new)) if new else (first, once)
                    near = (likeness(first, later), likeness(first, held), aligned(once, after), aligned(once, own))
                    out.append((last, len(old), sha, fingerprint(first), fingerprint(later), *near))
            before = (pid, key, text, held, own, extra)
            if len(out) >= 1000:
                yield emit()
                out = []
    if out:
        yield emit()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``OUT`` for every row.

    The next document is the next row by descending id, nulls last, rows of one id by their text's
    hash; after the last row comes the first. A null text counts as empty; an empty text's
    fingerprint is empty. A table of one row follows itself. Other columns are ignored; no rows
    give no rows. Texts of any length are taken whole, hashed in blocks; a text and the next one are
    held by one task. Rows equal in id and text can't be told apart and share a range.
    """
    spark = session_of(docs)
    rows = docs.select(F.bitwise_not(F.col(id_col).cast("long")).alias("down"), text_or_empty(text_col).alias("text"))
    # `down` rises as the id falls; null ids are behind all others
    cut = ranges(rows.select("down"), "down", partitions_of(spark))
    tie = F.xxhash64("text")
    fraction = (tie.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    rows = rows.withColumn("pid", cut.pid(F.col("down"), fraction)).withColumn("tie", tie)
    # the first row of each range that has rows; at most one a range
    heads = rows.select("pid", "down", "tie").groupBy("pid").agg(F.min(F.struct(F.col("down").isNull().alias("z"), F.col("down"), F.col("tie"))).alias("h"))
    known = sorted((r.pid, r.h.down, r.h.tie) for r in heads.collect())
    if not known:
        return rows.select("down", "text").limit(0).mapInArrow(lambda batches: (b for b in ()), OUT)
    back = [(pid, down, tie, known[i - 1][0]) for i, (pid, down, tie) in enumerate(known)]
    lookup = F.broadcast(spark.createDataFrame(back, "pid int, down long, tie long, into int"))  # as many rows as ranges
    extra = rows.join(lookup, (rows.pid == lookup.pid) & rows.down.eqNullSafe(lookup.down) & (rows.tie == lookup.tie)).select(rows.down, "text", lookup.into.alias("pid"), rows.tie)
    extra = extra.dropDuplicates(["pid"]).withColumn("extra", F.lit(True))
    both = rows.withColumn("extra", F.lit(False)).unionByName(extra.select("down", "text", "pid", "tie", "extra"))
    dealt = both.repartitionById(cut.count, F.col("pid").cast("int")).sortWithinPartitions("pid", "extra", F.col("down").asc_nulls_last(), "tie")
    return dealt.select("pid", F.bitwise_not("down").alias("doc_id"), "text", "extra").mapInArrow(_pairer, OUT)


def op6_syncmers(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
