"""Four stages that make packed training windows of the documents.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as
the next stage's documents. All but the last return the columns of documents.

Nulls in any column, empty and very long texts, repeated rows, empty tables and further columns are
handled as the four operators say: a null text counts as empty, a null id is an id of its own that no
label rates and the greatest of a class, of repeated rows one stays, a null source is the last one,
and further columns, whatever their names, go along up to the packing.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import minhash, mixing, packing, quality
from kindred.llm.common import settle, table
from kindred.session import ship_code


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go."""
    ship_code(spark)
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    ship_code(spark)
    return minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it."""
    ship_code(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their windows and offsets."""
    ship_code(spark)
    return packing.pack(docs)


STAGES = [("quality classifier", classify), ("near-duplicates", deduplicate), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep. A stage's own tables are deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(spark, partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hashed signatures, a fitted model and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
