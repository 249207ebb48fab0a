"""Pareto order samples: chances differ with the rows' sizes, decide the order, and are kept over many seeds."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm import common, mixing


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * int(rng.paretovariate(0.9) * 3)), rng.choice(["a", "a", "b", None])) for k in range(400)]
    rows += [(None, f"null {k}", "a") for k in range(20)] + [(7, f"repeat {k} x", "b") for k in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


def test_inclusion_follows_the_chances(spark):
    """Rows of a size are taken as often as their chance says, and larger ones more often."""
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.choice([1, 4, 9, 30, 100])), "ab"[k % 2]) for k in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    options = {"share": 0.5, "weights": (2, 1)}
    level = {r.source: (r.level, r.sure) for r in mixing.plan_mix(docs, **options).plan.collect()}
    groups = defaultdict(list)
    for r in mixing.mix(docs, **options).collect():
        groups[r.source, r.size].append(r.copies)
    for source in "ab":
        rates = []
        for size in (1, 4, 9, 30, 100):
            chance = level[source][1] + min(1.0, level[source][0] * math.ceil(size**0.5))
            got = groups[source, size]
            rates.append(sum(got) / len(got))
            assert abs(rates[-1] - chance) < 4 * (0.25 / len(got)) ** 0.5, (source, size, rates[-1], chance)
        assert rates == sorted(rates) and rates[-1] > 2 * rates[0]


def test_order_is_not_that_of_the_numbers(docs):
    made = mixing.plan_mix(docs, share=0.7)
    rows = docs.select(F.col("doc_id").alias("id"), "source", mixing.word_count(F.col("text")).alias("size"), mixing.text_key(F.col("text")).alias("key"))
    ranked = mixing._ranked(rows.withColumn("u", mixing.number(F.col("id"), F.col("key"), made.seed)), made.plan).filter("source = 'a' and rank is not null").collect()
    assert [r.u for r in sorted(ranked, key=lambda r: r.rank)] != sorted(r.u for r in ranked)
    assert len({r.u for r in rows.withColumn("u", mixing.number(F.col("id"), F.col("key"), 6)).filter("id is null").collect()}) == 20


def test_words_come_near_the_targets(docs):
    rows = mixing.mix(docs, share=0.7).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) / 2
        assert all(r.copies <= 2 for r in rs)


def test_results_do_not_depend_on_broadcasts(docs, monkeypatch):
    want = sorted(map(str, mixing.mix(docs, share=0.7).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.mix(docs, share=0.7).collect())) == want
