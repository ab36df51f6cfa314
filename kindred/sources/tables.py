"""Record tables from and to files: TSV as pandas would read it, Parquet, and grouped id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the record and truth files.
RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")
TSV = {"sep": "\t", "header": "true", "quote": '"', "escape": '"', "multiLine": "true", "emptyValue": "", "enforceSchema": "false"}
SPLITS = ("train", "test")


def strings(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_tsv(spark: SparkSession, path: str, names: tuple[str, ...] = RECORD) -> DataFrame:
    """SC1, SC2, SC10: the named columns as strings; empty is "", NA stays text, quotes may hold tabs and lines.

    A missing file raises PATH_NOT_FOUND (SC12). Files may have more columns; they aren't parsed.
    """
    header = tuple(spark.read.options(**TSV).csv(path).columns)
    return spark.read.options(**TSV).schema(strings(header)).csv(path).select(*names).na.fill("")


def read_split(spark: SparkSession, folder: str, split: str, source: int) -> DataFrame:
    """SC11: ``{split}_source{source}.tsv``; split is train or test."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {', '.join(SPLITS)}")
    return read_tsv(spark, f"{folder}/{split}_source{source}.tsv")


def read_truth(spark: SparkSession, folder: str) -> DataFrame:
    return read_tsv(spark, f"{folder}/train_ground_truth.tsv", TRUTH)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """SC3: types are inferred from all rows."""
    return spark.read.options(**TSV, inferSchema="true").csv(path)


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """SC4-SC6: row groups are the splits; only the named columns are read."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def evened(rows: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, dealt over all of them; any other as it is.

    Splits are only that few where the files have a few megabytes together, so little is moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def sampled_scan(rows: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """SC7."""
    return rows.sample(fraction, seed)


def write_candidates(pairs: DataFrame, path: str) -> None:
    """SK1, SK3: zstd Parquet; an earlier table is replaced."""
    pairs.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_index(postings: DataFrame, path: str) -> None:
    """SK2: the postings (sig, key, entity_id), sorted by key within files so that a lookup reads few row groups."""
    postings.repartition("sig", "key").sortWithinPartitions("sig", "key").write.mode("overwrite").option("compression", "zstd").parquet(path)


def id_lists(pairs: DataFrame, s1: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """SK4: a row for every primary record: its distinct target ids in order, joined by commas; "" if none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias(name))
    every = s1.select(F.col("entity_id").alias("s1_id")).distinct()
    return every.join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def write_tsv(rows: DataFrame, path: str) -> None:
    """SK4, SK5: a folder of TSV files with a header each."""
    rows.write.mode("overwrite").options(sep="\t", header="true", quote='"', escape='"', emptyValue="").csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(header="true", quote='"', escape='"', emptyValue="").csv(path)


def reuse(spark: SparkSession, path: str, make) -> DataFrame:
    """SK7: the table at the path, made and written first if it isn't there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
