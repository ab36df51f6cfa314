"""The nearest targets by cosine, block by block, against the join on grams."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import nearest, ranking

RECORDS = "entity_id string, name string"


def made(side, n, seed):
    rng = random.Random(seed)
    words = ["solar", "north", "tools", "trade", "delta", "é", "", "energy", "a"]
    rows = [(f"{side}{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(4)))) for i in range(n)]
    return [*rows, (f"{side}\n\\n1", "solar north"), *[(f"{side}x{i}", "solar north") for i in range(6)]]


@pytest.mark.parametrize(("texts", "often"), [(1 << 14, 256), (5, 3), (1, 1)])
def test_nearest_of_all_blocks(spark, monkeypatch, texts, often):
    monkeypatch.setattr(nearest, "TEXTS", texts)
    monkeypatch.setattr(nearest, "OFTEN", often)
    monkeypatch.setattr(nearest, "AT_ONCE", 7)
    a, b = (spark.createDataFrame(made(s, 60, i), RECORDS) for i, s in enumerate("ab"))
    found = nearest.cosine_top(a, b, F.col("name"), 5)
    plain = ranking.cosine_top(ranking.tfidf(a, F.col("name"), b), ranking.tfidf(b, F.col("name")), 5)
    wanted = {(r.s1_id, r["rank"]): (r.target_id, pytest.approx(r.cosine, abs=2e-9)) for r in plain.collect()}
    rows = found.collect()
    assert {(r.s1_id, r["rank"]): (r.target_id, r.cosine) for r in rows} == wanted and len(rows) == len(wanted) > 100


def test_no_row_for_a_gram_of_a_pair(spark, tmp_path):
    from kindred.plans import catalog

    rows = [(i, f"common words of name{i}", "en") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalog.queries()["tfidf_topk"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" not in plan and "Window" not in plan


def test_empty_sides(spark):
    some = spark.createDataFrame(made("a", 3, 1), RECORDS)
    none = spark.createDataFrame([("z", "")], RECORDS)
    for a, b in ((none, some), (some, none), (some.limit(0), some), (some, some.limit(0))):
        assert not nearest.cosine_top(a, b, F.col("name")).count()
