r"""Mixing sources to target weights with hash-threshold histograms.

A row's place is a hash of its id, size, source and text, read as hexadecimal digits; rows equal in
all of these are told apart by their number, so that a source of equal rows has as many places as
rows. Words are summed by source
and the first three digits; the running sums of these histograms tell in which bucket a source's
budget ends. Only that bucket is counted again by the next three digits. What lies below the
threshold found is taken: no rows are sorted, and the histograms are at most 4096 rows a source.
What is then missing to the budget, less than the rows of one bucket have, is filled with the one
row above the threshold whose size comes nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import materialize, table

#: Sources, in code point order, weigh these, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its size.
MOST = 3
#: Hexadecimal digits of a bucket at each of the two levels.
DIGITS = 3
#: Sources up to so many rows of thresholds are broadcast; more are joined by source and salt.
SMALL = 20_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place_of(key: Column, size: Column, source: Column, text: Column) -> Column:
    parts = [F.coalesce(key.cast("string"), F.lit("")), size.cast("string"), F.md5(F.coalesce(text, F.lit(""))), F.coalesce(F.concat(F.lit("="), source), F.lit(""))]
    return F.md5(F.concat_ws(":", *parts))


def untied(rows: DataFrame) -> DataFrame | None:
    """The rows with places of their own: of rows that share one, the second and later get one of its hash with their number. None if there are no such rows.

    Their numbers come from counts by (place, task) and ranks within these, so that a third of all
    rows may be equal.
    """
    code = F.xxhash64("place").alias("code")
    ties = materialize(rows.groupBy(code).agg(F.count("*").alias("n")).where("n > 1").select("code"), "mix-ties")
    if not (n := ties.count()):
        return None
    tied = F.broadcast(ties) if n <= SMALL else ties
    coded = rows.select("*", code)
    many = materialize(coded.join(tied, "code", "left_semi").withColumn("part", F.spark_partition_id()), "mix-tied")
    before = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = many.groupBy("place", "part").agg(F.count("*").alias("n"))
    first = counts.select("place", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("place", "part").orderBy("code"))
    numbered = many.withColumn("own", own).join(first, ["place", "part"]).withColumn("nth", F.col("own") + F.col("before"))
    new = F.when(F.col("nth") == 1, F.col("place")).otherwise(F.md5(F.concat_ws(":", "place", F.col("nth").cast("string"))))
    numbered = numbered.withColumn("place", new).select(*rows.columns)
    return materialize(coded.join(tied, "code", "left_anti").select(*rows.columns).unionByName(numbered), "mix-rows")


def short(place: str = "place") -> Column:
    """The digits that the histograms see."""
    return F.substring(place, 1, 2 * DIGITS)


def times_of() -> Column:
    """How often a row is taken."""
    more = (short() < F.col("below")) | ((short() == F.col("below")) & F.col("at")) | (F.col("place") == F.col("extra"))
    return F.col("repeats") + F.when(more, 1).otherwise(0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> with target: the total shared by weight, none above ``most`` times its size.

    The sources held at their limit are the first ones by limit over weight; the rest share what is
    left by weight. The windows run over one row a source.
    """
    nth = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    rows = (
        sizes.withColumn("nth", F.row_number().over(nth) - 1)
        .withColumn("weight", weight)
        .withColumn("most", (F.col("source_size") * most).cast("double"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("most_before", F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("held", F.col("most") * (F.col("all_weight") - F.col("weight_before")) < (F.col("total") - F.col("most_before")) * F.col("weight"))
        .withColumn("held_most", F.coalesce(F.sum(F.when(F.col("held"), F.col("most"))).over(everything), F.lit(0.0)))
        .withColumn("free_weight", F.sum(F.when(F.col("held"), 0.0).otherwise(F.col("weight"))).over(everything))
    )
    free = (F.col("total") - F.col("held_most")) * F.col("weight") / F.col("free_weight")
    return rows.select("source", "source_size", F.when(F.col("held"), F.col("most")).otherwise(F.least(free, F.col("most"))).alias("target"))


def thresholds(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, repeats, below, at, extra: a row is taken ``repeats`` times, and once more if its place begins below ``below``, or with it where ``at`` holds, or is ``extra``."""
    first = rows.groupBy("source", F.substring("place", 1, DIGITS).alias("bucket")).agg(F.sum("size").alias("words"))
    first = materialize(first, "mix-histogram")
    goal = targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    goal = goal.withColumn("repeats", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    goal = materialize(goal.withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size")), "mix-goal")

    def ending(histogram: DataFrame, budget: str) -> DataFrame:
        """The bucket where the running sum reaches the budget, with the sum before it."""
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = histogram.withColumn("sum", F.sum("words").over(upto)).withColumn("before", F.col("sum") - F.col("words"))
        return sums.where((F.col("before") < F.col(budget)) & (F.col(budget) <= F.col("sum")))

    same = F.col("h.source").eqNullSafe(F.col("g.source"))
    edge = ending(first.alias("h").join(goal.alias("g"), same).select("h.*", "g.budget"), "budget")
    edge = materialize(edge.select("source", F.col("bucket").alias("edge"), F.col("before").alias("edge_before"), "budget"), "mix-edge")
    # the boundary buckets only: at most one for each source, and the hash keeps them small
    inside = with_small(rows, edge).where(F.substring("place", 1, DIGITS) == F.col("edge"))
    second = inside.groupBy("source", "edge", F.substring("place", DIGITS + 1, DIGITS).alias("bucket"), "edge_before", "budget").agg(F.sum("size").alias("words"))
    fine = ending(second.withColumn("rest", F.col("budget") - F.col("edge_before")), "rest")
    fine = fine.select("source", F.concat("edge", "bucket").alias("below"), (F.col("sum") <= F.col("rest")).alias("at"), (F.col("rest") - F.col("before")).alias("gap"))
    fine = materialize(fine, "mix-fine")
    above = with_small(rows, fine.where("NOT at").select("source", "below", "gap")).where(short() >= F.col("below"))
    nearest = F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "place"))
    filled = above.groupBy("source", "gap").agg(nearest.alias("n")).where(F.col("n.off") < F.col("gap")).select("source", F.col("n.place").alias("extra"))
    out = goal.alias("g").join(fine.alias("h"), same, "left").join(filled.alias("f"), F.col("f.source").eqNullSafe(F.col("g.source")), "left")
    out = out.select("g.source", "g.source_size", "g.target", "g.repeats", F.coalesce("h.below", F.lit("")).alias("below"), F.coalesce("h.at", F.lit(False)).alias("at"), F.coalesce("f.extra", F.lit("")).alias("extra"))
    return materialize(out, "mix-thresholds")


def with_small(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """rows with the columns of a table that has one row a source; rows without a match go.

    By broadcast where that table is counted to be small, else by a join on source and a salt, so
    that a source with a third of all rows is spread over ``SALTS`` tasks.
    """
    names = [c for c in by_source.columns if c != "source"]
    if by_source.count() <= SMALL:
        right = F.broadcast(by_source.withColumnRenamed("source", "_source"))
        return rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).select(*rows.columns, *names)
    right = by_source.withColumnRenamed("source", "_source").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int"))
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")) & (F.col("salt") == F.col("_salt"))).select(*rows.columns, *names)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, and times (how often the row is taken) for every row.

    A null text has size 0; null is a source like others, the last; a null id has a place like
    others. Rows of size 0 give nothing and are taken ``repeats`` times or once more like the rest.
    Repeated rows are taken one by one; which of them doesn't matter. Texts of any length are counted
    whole. Other columns are ignored; no rows give no rows.
    """
    size, source = word_count(F.col(text_col)), F.col(source_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), size.alias("size"), place_of(F.col(id_col), size, source, F.col(text_col)).alias("place"))
    rows = materialize(rows, "mix-rows")
    rows = untied(rows) or rows
    taken = with_small(rows, thresholds(rows, weights, most))
    taken = taken.withColumn("times", times_of().cast("long"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "source", "place")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it. Columns may have any names: they are numbered meanwhile."""
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, text, source = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text", "source"))
    placed = numbered.withColumn("source", source).withColumn("size", word_count(text)).withColumn("place", place_of(key, F.col("size"), source, text))
    rows = materialize(placed.select("source", "size", "place"), "mix-rows")
    if untied(rows) is not None:
        placed = untied(placed)
        rows = placed.select("source", "size", "place")
    full = with_small(placed, thresholds(rows)).withColumn("copy", F.explode(F.array_repeat(F.lit(1), times_of().cast("int"))))
    return full.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), tied AS (
  SELECT doc_id, source, size, md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR || ':' || md5(coalesce(text, '')) || ':' || coalesce('=' || source, '')) AS place FROM rows
), placed AS (
  SELECT doc_id, source, size, CASE WHEN nth = 1 THEN place ELSE md5(place || ':' || nth::VARCHAR) END AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY place) AS nth FROM tied)
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM placed GROUP BY source
), nth AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sizes
), weighed AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, (3 * source_size)::DOUBLE AS most FROM nth
), sums AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS most_before,
    coalesce(sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM weighed
), held AS (
  SELECT *, most * (all_weight - weight_before) < (total - most_before) * weight AS held FROM sums
), goal AS (
  SELECT source, source_size, CASE WHEN held THEN most ELSE least(
    (total - coalesce(sum(CASE WHEN held THEN most END) OVER (), 0)) * weight / sum(CASE WHEN held THEN 0.0::DOUBLE ELSE weight END) OVER (), most) END AS target
  FROM held
), budgets AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS repeats FROM goal
), running AS (
  SELECT p.source, substr(p.place, 1, 6) AS bucket, target - repeats * source_size AS budget, sum(p.size)::BIGINT AS words
  FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source GROUP BY ALL
), upto AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM running
), edge AS (
  SELECT source, bucket AS below, upto <= budget AS at, budget - (upto - words) AS gap FROM upto WHERE upto - words < budget AND budget <= upto
), extra AS (
  SELECT p.source, p.place AS extra FROM placed p JOIN edge e ON p.source IS NOT DISTINCT FROM e.source
  WHERE NOT e.at AND substr(p.place, 1, 6) >= e.below AND abs(e.gap - p.size) < e.gap
  QUALIFY row_number() OVER (PARTITION BY p.source ORDER BY abs(e.gap - p.size), p.place) = 1
)
SELECT p.doc_id, p.size, b.source_size, b.target,
  (p.size * (b.repeats + CASE WHEN substr(p.place, 1, 6) < coalesce(e.below, '') OR (substr(p.place, 1, 6) = e.below AND e.at) OR p.place = x.extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source LEFT JOIN edge e ON p.source IS NOT DISTINCT FROM e.source
LEFT JOIN extra x ON p.source IS NOT DISTINCT FROM x.source
"""
