"""Profiles of tables: nulls, duplicates, value counts and match counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import tokens


def null_counts(rows: DataFrame) -> DataFrame:
    """Column, type, nulls, rows."""
    sums = rows.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(rows.columns)])
    parts = [F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col(f"n_{i}").alias("nulls")) for i, (c, kind) in enumerate(rows.dtypes)]
    return sums.select(F.explode(F.array(*parts)).alias("p"), "rows").select("p.*", "rows")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys (null is one), and rows that repeat an earlier key."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys")).select("rows", "keys", (F.col("rows") - F.col("keys")).alias("duplicates"))


def value_counts(rows: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Each value (null too) and its count, the most frequent first; the first n if given."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return counts.limit(n) if n else counts


def match_counts(truth: DataFrame) -> DataFrame:
    """Records, singletons, records with matches, the most and the mean of matches. truth has the comma lists."""
    sizes = truth.select(F.size(tokens.id_list(F.col("matched_entity_ids"))).alias("n"))
    return sizes.agg(F.count("*").alias("records"), F.count_if(F.expr("n = 0")).alias("singletons"), F.count_if(F.expr("n > 0")).alias("with_matches"), F.max("n").alias("most"), F.round(F.avg("n"), 9).alias("mean"))
