"""Near-duplicate classes by DartMinHash signatures, banded joining and exact checks.

A text's elements are its distinct five-word shingles, weighing 1 + ln(count). An element with
weight x is the region [0, x) of a plane of weight by rank; darts fall on it as a Poisson process
that depends on the element alone (one process for each unit of weight), and a dart within the
weight counts. Darts are thrown up to a rank at which about k (ln k + 2) of them hit the text, so a
long text needs no more darts than a short one. Each dart is hashed to one of k coordinates, and the
earliest one of each coordinate is the signature: two texts agree in a coordinate with the
probability of their weighted Jaccard similarity.

Signatures are cut into bands; texts that share a band are candidates. Within a bucket each text is
checked against one member drawn by hash (another in every band), which ties large groups together
with a number of pairs linear in the group. What can still be missing are links between texts of one
bucket that are in different components. In buckets of a few texts these are compared directly. In
larger ones all texts are written as differences from one hub, the text with most links: two texts
are similar enough only if their differences share so much that one of the rarest shared elements
lies at the beginning of both, in an order by rarity (``across``). That leaves out no link, and a
group of variants that are all alike, but not alike enough, costs no square of its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import materialize, table, text_or_empty
from kindred.llm.components import components
from kindred.llm.hashing import GOLD, U, groups, mix, shingles, word_hashes

COORDINATES, ROWS = 120, 5
WORDS, SIMILAR = 5, 0.8
#: Buckets of up to so many texts are compared directly.
DIRECT = 16
#: Weights are kept as single-precision numbers; this much is allowed for their rounding.
SLACK = 1e-3
#: Tables of ids are broadcast up to so many rows; beyond, they are joined by shuffling.
SMALL = 500_000


Weighted = tuple[np.ndarray, np.ndarray]


def weighted(texts: list[str], words: int = WORDS) -> list[Weighted]:
    """For each text its distinct shingle hashes, ascending, and their weights."""
    out = []
    for i, j in groups(texts):
        hashes, begin = word_hashes(texts[i:j])
        for a, b in zip(begin, begin[1:]):
            keys, counts = np.unique(shingles(hashes[a:b], words), return_counts=True)
            out.append((keys, 1 + np.log(counts)))
    return out


def darts(elements: list[Weighted], upto: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, coordinate, rank and id of the darts on each text's elements up to that text's rank.

    Each unit of an element's weight is a strip with its own process: ranks advance by exponential
    steps until they pass the limit; a dart beyond the weight, in the last strip, doesn't count.
    """
    sizes = [len(x[0]) for x in elements]
    owner = np.repeat(np.arange(len(elements)), sizes)
    keys, weights = np.concatenate([x[0] for x in elements]), np.concatenate([x[1] for x in elements])
    strips = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.arange(len(keys)), strips)
    floor = np.arange(len(of)) - np.repeat(np.cumsum(strips) - strips, strips)
    owner, seed, room = owner[of], mix(keys[of] + floor.astype(U) * GOLD), weights[of] - floor
    rank, throw, found = np.zeros(len(seed)), 0, []
    while len(seed):
        dart = mix(seed + U((throw + 1) * int(GOLD) % (1 << 64)))
        even = (dart >> U(11)).astype(np.float64) * 2.0**-53
        near = np.flatnonzero(even < -np.expm1(rank - upto[owner]))
        owner, seed, room, dart = owner[near], seed[near], room[near], dart[near]
        rank = rank[near] - np.log1p(-even[near])
        where = mix(dart ^ GOLD)
        hit = np.flatnonzero((where & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < room)
        found.append((owner[hit], (((where[hit] >> U(32)) * U(k)) >> U(32)).astype(np.int64), rank[hit], dart[hit]))
        throw += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(elements: list[Weighted], k: int = COORDINATES) -> list[np.ndarray]:
    """For each text the id of the earliest dart of each coordinate; no elements give an empty array.

    If a coordinate has no dart up to the first rank, the rank is doubled for that text: earlier
    darts stay the same, so signatures made with different ranks agree.
    """
    out = [np.empty(0, U)] * len(elements)
    todo = [i for i, x in enumerate(elements) if len(x[0])]
    upto = np.array([k * (np.log(k) + 2) / elements[i][1].sum() for i in todo])
    while todo:
        owner, place, rank, dart = darts([elements[i] for i in todo], upto, k)
        order = np.argsort(-rank)
        best, full = np.zeros(len(todo) * k, U), np.zeros(len(todo) * k, bool)
        best[owner[order] * k + place[order]] = dart[order]  # the last one stays, that of the least rank
        full[owner * k + place] = True
        whole = full.reshape(-1, k).all(axis=1)
        for i in np.flatnonzero(whole):
            out[todo[i]] = best[i * k : (i + 1) * k]
        todo, upto = [x for x, y in zip(todo, whole, strict=True) if not y], 2 * upto[~whole]
    return out


def bands(sign: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each run of ``rows`` coordinates, with the run's number in it."""
    if not len(sign):
        return np.empty(0, np.int64)
    cut = sign[: len(sign) // rows * rows].reshape(-1, rows)
    total = np.arange(len(cut), dtype=U) * GOLD
    for i in range(rows):
        total = mix(total + cut[:, i])
    return total.view(np.int64)


def similarity(a: Weighted, b: Weighted) -> float:
    """Weighted Jaccard similarity; two texts without shingles have 0."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    return low / (float(a[1].sum()) + float(b[1].sum()) - low)


def node_of(text: Column) -> Column:
    """Equal texts have an equal long: the first 60 bits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def node(text: str) -> int:
    return int(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)


def _sketcher(k: int, rows: int, words: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, made = batch.column(1).to_pylist(), []
            for i, j in groups(texts):
                made += [bands(x, rows) for x in signatures(weighted(texts[i:j], words), k)]
            offsets = np.zeros(len(made) + 1, np.int32)
            np.cumsum([len(x) for x in made], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made) if made else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), lists], names=["doc_id", "node", "row", "bands"])

    return sketch


def _packer(words: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = weighted(batch.column(1).to_pylist(), words)
            keys = pa.array([k.tobytes() for k, _ in sets], pa.binary())
            weights = pa.array([w.astype(np.float32).tobytes() for _, w in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, weights], names=["node", "keys", "weights"])

    return pack


def _checker(least: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda batch, c, i: (np.frombuffer(batch.column(c)[i].as_buffer(), U), np.frombuffer(batch.column(c + 1)[i].as_buffer(), np.float32).astype(np.float64))
        for batch in batches:
            # float32 weights: a hair of tolerance keeps pairs of exactly the least similarity
            near = [i for i in range(batch.num_rows) if similarity(read(batch, 2, i), read(batch, 4, i)) >= least - 1e-6]
            yield batch.select([0, 1]).take(pa.array(near, pa.int64()))

    return check


def by_id(left: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi or anti join with a table of ids: by broadcast if it is counted to be small."""
    return left.join(F.broadcast(ids) if ids.count() <= SMALL else ids, on, how)


def shingle_sets(nodes: DataFrame, docs: DataFrame, places: DataFrame, words: int) -> DataFrame:
    """node, keys, weights of the given nodes. places: node, first (with a doc_id that has that text; any row with the text will do)."""
    wanted = materialize(nodes.distinct().join(places, "node").select("node", F.coalesce("first.doc_id", F.lit(-1)).alias("key")), "wanted")
    found = by_id(docs.select(F.coalesce("doc_id", F.lit(-1)).alias("key"), node_of(F.col("text")).alias("node"), "text"), wanted, ["key", "node"], "left_semi")
    return materialize(found.select("node", "text").mapInArrow(_packer(words), "node long, keys binary, weights binary").dropDuplicates(["node"]), "shingles")


def with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs with ka, wa, kb, wb: both sides' shingles."""
    side = lambda x, n: sets.select(F.col("node").alias(x), F.col("keys").alias(f"k{n}"), F.col("weights").alias(f"w{n}"))
    return pairs.join(side(a, "a"), a).join(side(b, "b"), b)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough."""
    both = with_sets(pairs, sets, "a", "b").select("a", "b", "ka", "wa", "kb", "wb")
    return materialize(both.mapInArrow(_checker(least), "a long, b long"), "verified")


def difference(a: Weighted, b: Weighted) -> tuple[np.ndarray, np.ndarray]:
    """Ids and amounts of what a has more or less of than b; an id tells the shingle and the direction."""
    keys = np.union1d(a[0], b[0])
    amount = np.zeros(len(keys))
    amount[np.searchsorted(keys, a[0])] += a[1]
    amount[np.searchsorted(keys, b[0])] -= b[1]
    kept = np.abs(amount) > 1e-6
    return mix(keys[kept] + (amount[kept] > 0).astype(U) * GOLD).view(np.int64), np.abs(amount[kept])


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, node, component, top, kb, wb of the hub, ka, wa) -> the node's difference from the hub, with both sums."""
    lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))
    for batch in batches:
        weight, size, ids, amounts = [], [], [], []
        for i in range(batch.num_rows):
            a, b = ((np.frombuffer(batch.column(c)[i].as_buffer(), U), np.frombuffer(batch.column(c + 1)[i].as_buffer(), np.float32).astype(np.float64)) for c in (4, 6))
            found, amount = difference(a, b)
            weight.append(float(a[1].sum()))
            size.append(float(amount.sum()))
            ids.append(found)
            amounts.append(amount)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight, pa.float64()), pa.array(size, pa.float64()), lists(ids, pa.int64()), lists(amounts, pa.float64())], names=["hub", "node", "component", "top", "weight", "size", "ids", "amounts"])


def across(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of one hub's members, of different components, that may be similar enough.

    members: hub, node, component, top (whether in the hub's component). Let D be the summed
    absolute difference of two texts x and y with weights W, and d their differences from the hub,
    which sum to S. Similarity t or more means D <= m = (1 - t) / (1 + t) (Wx + Wy). The shared part of
    dx and dy is (Sx + Sy - D) / 2 >= (Sx + Sy - m) / 2. If it isn't empty, its first element, in any
    order common to all members, has at most Sx - (Sx + Sy - m) / 2 = (Sx - Sy + m) / 2 of dx before it, and
    likewise for y. An empty one would need Sx + Sy <= m, while Sx > m for a text x that isn't similar
    to the hub; x is checked against the hub itself. As Wy <= Wx / t, no text needs more than the
    first m' = (1 - t) / (1 + t) (1 + 1 / t) Wx of its elements.
    """
    share = (1 - least) / (1 + least)
    rows = with_sets(members, sets, "node", "hub").select("hub", "node", "component", "top", "ka", "wa", "kb", "wb")
    differ = materialize(rows.mapInArrow(_differ, "hub long, node long, component long, top boolean, weight double, size double, ids array<long>, amounts array<double>"), "differences")
    each = differ.select("hub", "node", "component", "top", "weight", "size", F.explode(F.arrays_zip("ids", "amounts")).alias("e"))
    each = each.select("hub", "node", "component", "top", "weight", "size", F.col("e.ids").alias("id"), F.col("e.amounts").alias("amount"))
    held = each.groupBy("hub", "id").agg(F.count("*").alias("held"))
    before = Window.partitionBy("hub", "node").orderBy("held", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.join(held, ["hub", "id"]).withColumn("before", F.coalesce(F.sum("amount").over(before), F.lit(0.0)))
    # what a single text holds counts in the sums, but meets nothing
    placed = placed.where((F.col("held") > 1) & (F.col("before") <= F.col("weight") * (share * (1 + 1 / least) + SLACK))).drop("amount", "held")
    placed = materialize(placed, "beginnings")
    x, y = placed.where("NOT top").alias("x"), placed.alias("y")
    most = share * (F.col("x.weight") + F.col("y.weight")) * (1 + SLACK) + SLACK
    lead = F.col("x.size") - F.col("y.size")
    meets = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.id") == F.col("y.id")) & (F.col("y.top") | (F.col("x.component") < F.col("y.component")))
    return x.join(y, meets & (2 * F.col("x.before") <= lead + most) & (2 * F.col("y.before") <= most - lead)).select(*ordered("x.node", "y.node")).distinct()


def ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def classes(docs: DataFrame, k: int = COORDINATES, rows: int = ROWS, words: int = WORDS, least: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, component, class_id, kept for each row.

    class_id is the smallest doc_id of the row's class; ``kept`` holds for one row of each class, one
    with that doc_id. Classes are the connected components of: equal texts, and texts whose weighted
    Jaccard similarity over ``words``-word shingles is at least ``least``. A null text counts as empty;
    texts without words are alike only if equal. Texts of fewer words than a shingle are one
    shingle, and texts of any length are taken whole. A null id takes part and is the greatest; a
    class with null ids only has a null class_id. Repeated rows are in one class, and which of them
    is kept doesn't matter. Other columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    told = docs.select("doc_id", "text", node_of(F.col("text")).alias("node"), F.monotonically_increasing_id().alias("row"))
    sketched = materialize(told.mapInArrow(_sketcher(k, rows, words), "doc_id long, node long, row long, bands array<long>"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row"))
    places = materialize(sketched.groupBy("node").agg(first.alias("first"), F.any_value("bands").alias("bands")), "texts")
    banded = places.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min(F.xxhash64("node", "band")).alias("h"), F.count("*").alias("n")).where("n > 1")
    members = materialize(banded.join(shared, "band").select("band", "node", "h"), "buckets")
    reps = members.where(F.xxhash64("node", "band") == F.col("h")).select("band", F.col("node").alias("rep"))
    first = materialize(members.join(reps, "band").where("node <> rep").select(*ordered("node", "rep")).distinct(), "pairs")
    sets = shingle_sets(members.select("node"), docs, places, words)  # of all that any later pair can name
    links = verified(first, sets, least)
    tied = materialize(components(links), "components")

    # texts of one bucket in different components
    parts = members.select("band", "node").join(tied, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    parts = materialize(parts, "parts")
    sizes = parts.groupBy("band", "component").count()
    top = F.max(F.struct("count", "component"))["component"]
    open_bands = sizes.groupBy("band").agg(F.count("*").alias("n"), top.alias("top"), F.sum("count").alias("members")).where("n > 1").drop("n")
    parts = materialize(parts.join(open_bands, "band"), "open-buckets")
    small = parts.where(F.col("members") <= DIRECT)
    left = small.where("component <> top").select("band", F.col("node").alias("x"), F.col("component").alias("cx"))
    right = small.select("band", F.col("node").alias("y"), F.col("component").alias("cy"), "top")
    more = left.join(right, "band").where("(cy = top) OR (cx < cy)").select(*ordered("x", "y"))
    large = parts.where(F.col("members") > DIRECT).select("node", "component", "top").distinct()
    if large.limit(1).count():
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n"))
        hubs = ends.join(tied, "node").groupBy(F.col("component").alias("top")).agg(F.max(F.struct("n", "node"))["node"].alias("hub"))
        large = large.join(hubs, "top", "left").select(F.coalesce("hub", "top").alias("hub"), "node", "component", (F.col("component") == F.col("top")).alias("top"))
        large = materialize(large.where("node <> hub"), "large-buckets")
        more = more.union(large.where("NOT top").select(*ordered("node", "hub"))).union(across(large, sets, least))
    more = materialize(more.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    stars = tied.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a < b")
    tied = materialize(components(stars.union(verified(more, sets, least))), "components")

    named = places.join(tied, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    least_row = F.min(F.struct("first.z", "first.doc_id", "node", "first.row")).alias("l")
    of_class = named.groupBy("component").agg(least_row).select("component", F.col("l.doc_id").alias("class_id"), F.col("l.row").alias("keeper"))
    named = materialize(named.join(of_class, "component").select("node", "component", "class_id", "keeper"), "classes")
    return sketched.select("doc_id", "node", "row").join(named, "node").select("doc_id", "node", "component", "class_id", (F.col("row") == F.col("keeper")).alias("kept"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The documents with one row of each class, the one that ``classes`` keeps. Columns may have any names: they are numbered meanwhile."""
    found = materialize(classes(docs, **how), "doc-classes")
    counted = found.groupBy("doc_id", "node").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    keep = materialize(counted.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node"), "n"), "kept")
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rows = numbered.withColumn("id", F.col(f"c{names.index('doc_id')}").cast("long")).withColumn("node", node_of(text_or_empty(f"c{names.index('text')}")))
    ids = keep.select("kept_id", "kept_node")
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("node") == F.col("kept_node"))
    kept = rows.join(F.broadcast(ids) if ids.count() <= SMALL else ids, same, "left_semi")
    if keep.where("n > 1").limit(1).count():  # rows equal in id and text
        kept = kept.dropDuplicates(["id", "node"])
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's class; ``kept`` marks the one row of it that stays."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
