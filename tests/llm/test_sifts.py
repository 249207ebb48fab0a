"""Joins beyond the bound of a broadcast: same rows, and rows that can't match are not shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import common, jaccard_join, passages


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    families = [prose(80) for _ in range(10)]
    rows = []
    for k in range(300):
        text = list(families[k % 10]) if k % 3 == 0 else prose(80)
        text[rng.randrange(80)] = f"x{k}"
        rows.append((k, " ".join(text if k % 7 else text[:60] + families[1][:55])))
    rows += [rows[5], rows[5], rows[3], rows[3], (None, rows[6][1]), (None, rows[6][1]), (400, None), (400, None)]
    clash = {c: F.lit("clash") for c in ("class_of_id", "CLASS_OF_KEY", "_class_id", "_class_key", "want", "want_id", "h", "of", "words")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(3)


def test_sift_lets_all_keys_and_few_others_pass(spark):
    keys = spark.range(0, 60_000, 3).select((F.col("id") * 7919).alias("k"))
    test = common.sift(keys, "k")
    row = spark.range(60_000).select((F.col("id") % 3 == 0).alias("key"), test(F.col("id") * 7919).alias("hit"))
    found = {(r.key, r.hit): r["count"] for r in row.groupBy("key", "hit").count().collect()}
    assert found[True, True] == 20_000 and (True, False) not in found and found.get((False, True), 0) < 0.1 * 40_000


@pytest.mark.parametrize("make", [jaccard_join.join, jaccard_join.one_of_each, passages.repeated])
def test_same_rows_without_broadcasts(docs, monkeypatch, make):
    want = sorted(map(str, make(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, make(docs).collect())) == want


def test_rows_that_stay_are_not_shuffled(docs, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    gone = docs.filter("doc_id < 10").select(F.col("doc_id").alias("g"), F.xxhash64("text").alias("gk"))
    kept = common.without(docs, F.xxhash64("text"), gone, "gk", (F.col("doc_id") == F.col("g")) & (F.xxhash64("text") == F.col("gk")))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 400) == list(range(10, 300))
    assert "ArrowEvalPython" in plan and "Union" in plan
