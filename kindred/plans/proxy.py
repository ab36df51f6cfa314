"""Entity records out of the documents table, in DataFrames and as the same view in SQL.

Documents with an id divisible by three are the primary source. A text's first sentence, as far as its
line goes, is the name, all the rest of the text the address, the language the country; so whole
texts are read, however long. Equal texts are the truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.tables import evened


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The first sentence, or nothing; Java's and RE2's pattern.
NAME = r"^([^.!?\n]*)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.col("doc_id") % 3
    name = F.regexp_extract("text", NAME, 1)
    prefix = F.when(source == 0, "S1-").when(source == 1, "S2-").otherwise("S3-")
    return evened(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(
        F.concat(prefix, F.col("doc_id").cast("string")).alias("entity_id"), source.cast("int").alias("src"), name.alias("business_name"),
        F.substr("text", F.length(name) + 1).alias("business_address"), F.col("lang").alias("country"), "text",
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Primary and secondary records."""
    rows = records(spark, sf_dir)
    return rows.where("src = 0"), rows.where("src <> 0")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id, target_id of equal texts."""
    s1, targets = sides(spark, sf_dir)
    key = F.sha2("text", 256).alias("key")
    return s1.select(F.col("entity_id").alias("s1_id"), key).join(targets.select(F.col("entity_id").alias("target_id"), key), "key").select("s1_id", "target_id")


def orders_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with numbers in their addresses: customers' orders, by month of the order's number."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.when(F.col("o_orderkey") % 3 == 0, "S1-").otherwise("S2-"), F.col("o_orderkey").cast("string")).alias("entity_id"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1).alias("src"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" Ltd")).alias("business_name"),
        F.concat((10000 + F.col("o_custkey") % 997).cast("string"), F.lit(" "), F.col("o_orderpriority"), F.lit(" Street "), (F.col("o_custkey") % 89).cast("string"), F.lit("b")).alias("business_address"),
        F.col("o_orderstatus").alias("country"),
    )


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth as comma lists, a row for every primary record: an item in three has a blank part."""
    s1, _ = sides(spark, sf_dir)
    grouped = truth(spark, sf_dir).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("target_id")), ", ,").alias("ids"))
    return s1.select(F.col("entity_id").alias("s1_id")).join(grouped, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))


REC = f"""rec AS (
  SELECT concat(CASE doc_id % 3 WHEN 0 THEN 'S1-' WHEN 1 THEN 'S2-' ELSE 'S3-' END, doc_id) AS entity_id, (doc_id % 3)::INT AS src,
    regexp_extract(text, '{NAME}', 1) AS business_name, substr(text, length(regexp_extract(text, '{NAME}', 1)) + 1) AS business_address, lang AS country, text FROM documents
)"""
TRUTH = "truth AS (SELECT a.entity_id AS s1_id, b.entity_id AS target_id FROM rec a JOIN rec b ON a.text = b.text AND a.src = 0 AND b.src <> 0)"
ORDERS = """rec AS (
  SELECT concat(CASE WHEN o_orderkey % 3 = 0 THEN 'S1-' ELSE 'S2-' END, o_orderkey) AS entity_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS src,
    concat('Customer ', o_custkey, ' Ltd') AS business_name,
    concat(10000 + o_custkey % 997, ' ', o_orderpriority, ' Street ', o_custkey % 89, 'b') AS business_address, o_orderstatus AS country FROM orders
)"""


def words_sql(text: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def split_sql(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda w: w <> '')"
