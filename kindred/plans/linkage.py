"""The three entry points: candidates, a trained model, and matches, from files to files."""

from __future__ import annotations

import argparse

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession

from kindred.operators import blocking, evaluation, features, keys, training
from kindred.session import session, ship_code
from kindred.sources import tables

GENERATIONS = {"v4": keys.V4, "v3": keys.V3, "v1": keys.V1, "multi": keys.MULTI}


def sources(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    s1, s2, s3 = (tables.read_split(spark, folder, split, i) for i in (1, 2, 3))
    return s1, features.first_by_id(s2, s3)


def run_blocking(spark: SparkSession, folder: str, out: str, split: str, generation: str = "v4") -> DataFrame:
    """Writes ``candidates_{split}``; returns its recall where there is a truth, else the distribution of its counts."""
    s1, targets = sources(spark, folder, split)
    path = f"{out}/candidates_{split}"
    tables.write_candidates(blocking.block(s1, targets, GENERATIONS[generation]), path)
    pairs = spark.read.parquet(path)
    if split == "train":
        return evaluation.recall(evaluation.truth_pairs(tables.read_truth(spark, folder)), pairs, s1, targets)
    return evaluation.distribution(evaluation.candidate_counts(pairs, s1))


def run_training(spark: SparkSession, folder: str, out: str, **how) -> DataFrame:
    """Writes ``training_pairs``, ``training_features`` and ``model``; returns the threshold sweep."""
    s1, targets = sources(spark, folder, "train")
    truth = evaluation.truth_pairs(tables.read_truth(spark, folder))
    rows = training.training_pairs(spark.read.parquet(f"{out}/candidates_train").select("s1_id", "target_id", "n_signals"), truth)
    tables.write_candidates(rows, f"{out}/training_pairs")
    rows = training.downsampled(spark.read.parquet(f"{out}/training_pairs"))
    tables.write_candidates(features.features(rows, s1, targets), f"{out}/training_features")
    held = spark.read.parquet(f"{out}/training_features")
    model = training.train(held, **how)
    model.write().overwrite().save(f"{out}/model")
    return evaluation.threshold_sweep(training.scored(model, held.where("split = 'valid'")))


def run_inference(spark: SparkSession, folder: str, out: str, split: str = "test", threshold: float = training.THRESHOLD) -> DataFrame:
    """Writes ``candidate_pairs`` and ``matching_results`` as TSV; returns how many records got matches."""
    s1, targets = sources(spark, folder, split)
    pairs = spark.read.parquet(f"{out}/candidates_{split}").select("s1_id", "target_id", "n_signals")
    model = GBTClassificationModel.load(f"{out}/model")
    tables.write_candidates(training.scored(model, features.features(pairs, s1, targets)).select("s1_id", "target_id", "probability"), f"{out}/scores_{split}")
    found = training.matches(spark.read.parquet(f"{out}/scores_{split}"), threshold)
    tables.write_tsv(tables.id_lists(pairs, s1, "candidate_entity_ids"), f"{out}/candidate_pairs")
    tables.write_tsv(tables.id_lists(found, s1), f"{out}/matching_results")
    return s1.select("entity_id").distinct().join(found.selectExpr("s1_id AS entity_id").distinct().selectExpr("entity_id", "1 AS hit"), "entity_id", "left").selectExpr("count(*) AS records", "count(hit) AS with_matches")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kindred")
    parser.add_argument("step", choices=("block", "train", "infer"))
    parser.add_argument("--folder", required=True, help="of the source files")
    parser.add_argument("--out", required=True)
    parser.add_argument("--split", choices=tables.SPLITS, default="train")
    parser.add_argument("--generation", choices=sorted(GENERATIONS), default="v4")
    a = parser.parse_args(args)
    spark = session()
    ship_code(spark)
    steps = {"block": lambda: run_blocking(spark, a.folder, a.out, a.split, a.generation), "train": lambda: run_training(spark, a.folder, a.out), "infer": lambda: run_inference(spark, a.folder, a.out, a.split)}
    steps[a.step]().show(100, truncate=False)
