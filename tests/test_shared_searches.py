"""Slots that share a search get what each would get by a search of its own, and what it found isn't repeated for each."""

import random

from pyspark.sql import functions as F

from parlance.operators import sampling


def test_shared_search_is_as_own_searches(spark):
    rng = random.Random(6)
    modes = ("seeded", "followup", "adjacent", "fresh")
    slots = spark.createDataFrame([(k, modes[k % 4], k % 9) for k in range(60)], "slot long, mode string, asked long")
    rows = [(a, rank, rng.randrange(300)) for a in range(8) for rank in range(1, rng.choice([3, 40]))]
    found = spark.createDataFrame([(a, r, i, f"s{i % 6}") for a, r, i in rows if a or i % 6 > 1], "asked long, rank int, id long, source string")
    chunks = spark.range(300).withColumn("source", F.concat(F.lit("s"), (F.col("id") % 6).cast("string")))
    used = chunks.filter("id % 7 = 0").select("id")
    told = lambda df: sorted((r.slot, r["rank"], r.id, r.source, r.way) for r in df.collect())
    for names in (["s0", "s1"], ["none"]):
        preferred = spark.createDataFrame([(x,) for x in names], "source string")
        own = found.join(slots.select("slot", "asked"), "asked").drop("asked")
        want = told(sampling.snippet_cascade(slots.drop("asked"), own, chunks, used, preferred))
        assert told(sampling.snippet_cascade(slots, found, chunks, used, preferred, search="asked")) == want and want


def test_query_joins_no_slots_with_all_they_find(spark):
    """The rows that the searches find don't grow with the slots: no window over slots holds all that they find."""
    from parlance.plans import catalog, catalog_indexes  # noqa: F401

    plan = catalog.QUERIES["snippet_cascade"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(slot#" not in plan or "row_number() windowspecdefinition(search#" in plan
