"""Files, samples, labels, models and the registered queries."""

import random
import sys

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kindred.operators import features, profiling, sampling, training
from kindred.plans import linkage
from kindred.sources import tables

SF = "/root/testdata/sf0.001"


def test_tsv_round_trip(spark, tmp_path):
    rows = [("S2-1", 'say "hi"', "a\tb", ""), ("S2-2", "NA", "two\nlines", "FR"), ("S2-3", "", "", "")]
    (tmp_path / "train_source2.tsv").write_text('entity_id\tmore\tbusiness_name\tbusiness_address\tcountry\nS2-1\t1\t"say ""hi"""\t"a\tb"\t\nS2-2\t2\tNA\t"two\nlines"\tFR\nS2-3\t3\t\t\t\n')
    found = tables.read_split(spark, str(tmp_path), "train", 2)
    assert sorted(map(tuple, found.collect())) == rows
    tables.write_tsv(found, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_tsv(spark, str(tmp_path / "out")).collect())) == rows
    assert dict(tables.read_inferred(spark, str(tmp_path / "train_source2.tsv")).dtypes)["more"] == "int"
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        tables.read_split(spark, str(tmp_path), "test", 1)
    with pytest.raises(ValueError):
        tables.read_split(spark, str(tmp_path), "dev", 1)


def test_id_lists(spark):
    pairs = spark.createDataFrame([("a", "t2"), ("a", "t1"), ("a", "t2")], "s1_id string, target_id string")
    s1 = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    assert sorted(map(tuple, tables.id_lists(pairs, s1).collect())) == [("a", "t1,t2"), ("b", "")]


def test_reuse(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert tables.reuse(spark, str(tmp_path / "t"), make).count() == tables.reuse(spark, str(tmp_path / "t"), make).count() == 3
    assert made == [1]


@pytest.mark.parametrize("n", [0, 1, 37, 500, 9999])
def test_exact_samples(spark, n):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    first, again = (sorted(r.k for r in sampling.sample(rows.repartition(p), n, ["k"]).collect()) for p in (2, 5))
    assert len(first) == min(n, 1000) == len(set(first)) and first == again


def test_shuffled(spark):
    first, again = ([r.id for r in sampling.shuffled(spark.range(100).repartition(p), ["id"]).collect()] for p in (1, 4))
    assert first == again != sorted(first) and sorted(first) == list(range(100))


def test_every_nth(spark):
    assert sorted(r.id for r in sampling.every_nth(spark.range(1000), "id", 10).collect()) == list(range(0, 1000, 100))
    assert sampling.every_nth(spark.range(5), "id", 10).count() == 5
    assert not sampling.every_nth(spark.range(0), "id", 10).count()


def test_numbers_are_dense(spark):
    ids = spark.createDataFrame([(f"x{i % 50}",) for i in range(100)], "entity_id string")
    assert sorted(r.number for r in training.numbered(ids).collect()) == list(range(50))


def test_training_pairs(spark):
    pairs = spark.createDataFrame([(f"a{i % 20}", f"t{i}", 1) for i in range(200)], "s1_id string, target_id string, n_signals int")
    truth = spark.createDataFrame([("a1", "t1"), ("a2", "t2"), ("a3", "nope")], "s1_id string, target_id string")
    rows = training.training_pairs(pairs, truth)
    assert {(r.label, r["count"]) for r in rows.groupBy("label").count().collect()} == {(1, 2), (0, 8)}
    assert not training.leaked(rows).count()


def test_first_by_id(spark):
    a, b = (spark.createDataFrame([("x", v), (v, v)], "entity_id string, c string") for v in "ab")
    assert sorted(map(tuple, features.first_by_id(a, b).collect())) == [("a", "a"), ("b", "b"), ("x", "a")]


def test_profiles(spark):
    rows = spark.createDataFrame([(1, None), (1, "a"), (2, "a")], "k int, v string")
    assert [tuple(r) for r in profiling.null_counts(rows).collect()] == [("k", "int", 0, 3), ("v", "string", 1, 3)]
    assert tuple(profiling.duplicates(rows, "k").first()) == (3, 2, 1)
    assert [tuple(r) for r in profiling.value_counts(rows, "v").collect()] == [("a", 2), (None, 1)]


def test_from_files_to_matches(spark, tmp_path):
    rng = random.Random(3)
    words = ["acme", "delta", "solar", "harbour", "market", "energy", "foods", "north", "trade", "stone", "river", "metal"]
    lines = {1: [], 2: [], 3: []}
    truth = []
    for i in range(60):
        name, address = " ".join(rng.sample(words, 3)), f"{i} {' '.join(rng.sample(words, 3))} {10000 + i}"
        lines[1].append((f"S1-{i}", name, address, "US"))
        if i % 4:
            source = 2 + i % 2
            lines[source].append((f"S{source}-{i}", name + (" ltd" if i % 3 else ""), address, "us"))
            truth.append((f"S1-{i}", f"S{source}-{i}"))
        else:
            truth.append((f"S1-{i}", ""))
    for source, rows in lines.items():
        (tmp_path / f"train_source{source}.tsv").write_text("\n".join(["\t".join(tables.RECORD), *("\t".join(r) for r in rows)]) + "\n")
    (tmp_path / "train_ground_truth.tsv").write_text("\n".join(["\t".join(tables.TRUTH), *("\t".join(r) for r in truth)]) + "\n")
    out = str(tmp_path / "out")
    assert linkage.run_blocking(spark, str(tmp_path), out, "train").first().full_recall == 1.0
    assert linkage.run_training(spark, str(tmp_path), out, rounds=3, depth=3).count() == 86
    counts = linkage.run_inference(spark, str(tmp_path), out, "train", 0.5).first()
    assert counts.records == 60 and counts.with_matches >= 40
    lists = {r.source1_entity_id: r.matched_entity_ids for r in tables.read_tsv(spark, f"{out}/matching_results", tables.TRUTH).collect()}
    assert len(lists) == 60 and sum(lists[a] == b for a, b in truth) >= 50


def checked(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0 if value == value else None
    return value


@pytest.mark.parametrize("name", ["block_exact_name", "block_prefix_keys", "capped_multi_signal_candidates", "candidates_multi", "idf_vote_topk", "signal_recall", "pair_features_set", "training_pairs", "threshold_sweep", "profile_nulls", "evenly_spaced"])
def test_queries_match_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "orders", "labels"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = entry.queries()[name](spark, SF)
    names = sorted(frame.columns)
    result = base.execute(entry.oracle_sql()[name])
    order = [d[0] for d in result.description]
    wanted = sorted(str([checked(row[order.index(c)]) for c in names]) for row in result.fetchall())
    assert sorted(str([checked(x) for x in row]) for row in frame.select(*[F.col(f"`{c}`") for c in names]).collect()) == wanted
    assert sorted(order) == names


def test_entry(spark):
    assert entry.entry(spark).columns == ["s1_id", "target_id", "n_signals", "is_match"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "kindred.llm" not in {m for m, x in sys.modules.items() if m == "kindred.plans.catalog" and hasattr(x, "llm")}


@pytest.mark.parametrize("name", ["gbt_score", "feature_importance"])
def test_model_queries_fit_with_the_operators_settings(spark, tmp_path, monkeypatch, name):
    """700 rounds of depth 7, not ten of depth four; the fit itself is left out."""
    import inspect

    from kindred.plans import catalog

    texts = [f"alpha{i // 3} bravo. {i % 2} mill road" for i in range(60)]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    own, seen = inspect.signature(training.train), {}

    class Stop(Exception):
        pass

    def train(*args, **named):
        held = own.bind(*args, **named)
        held.apply_defaults()
        seen.update(held.arguments)
        raise Stop

    monkeypatch.setattr(training, "train", train)
    with pytest.raises(Stop):
        catalog.queries()[name](spark, str(tmp_path))
    assert (seen["rounds"], seen["depth"], seen["rate"], seen["least"]) == (700, 7, 0.07, 3) and seen["features"].count() > 0
