"""Summaries of parts add up to that of the whole, within the stated bounds."""

import numpy as np
from pyspark.sql import functions as F

from parlance.operators import sketches, stats


def messages(spark, n):
    words = F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(400)) + 1).cast("int"))
    rows = spark.range(n).select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.concat(words, F.pmod("id", F.lit(n // 3)).cast("string")).alias("text"))
    return rows.unionByName(spark.range(5).select((F.col("id") + n).alias("conv_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("text")))


def test_parts_add_up_to_the_whole(spark, tmp_path):
    n, folder = 20_000, f"file://{tmp_path}/parts"
    rows = messages(spark, n)
    assert sketches.kept(spark, folder) is None
    for k in (0, 1, 2, 1):
        sketches.keep(spark, folder, f"p{k}", rows.filter(F.col("conv_id") % 3 == k))
    told = {(r.metric, r.bucket): r.value for r in sketches.report(sketches.merged(sketches.kept(spark, folder))).collect()}
    sizes = np.sort([r.words for r in stats.conversation_sizes(rows).filter("words > 0").collect()])
    whole = {(r.metric, r.bucket): r.value for r in sketches.report(sketches.part_of(rows)).collect()}
    exact = ("conversations", "messages", "words_min", "words_max", "avg_words_per_conversation", "avg_tokens_per_message")
    assert all(told[m, ""] == whole[m, ""] for m in exact) and told["conversations", ""] == n + 5 and told["words_max", ""] == sizes[-1]
    assert abs(told["distinct_questions", ""] / whole["distinct_questions", ""] - 1) <= 4 * sketches.DISTINCT_ERROR
    for q in (0.25, 0.5, 0.75):
        v = told["words_quantile", f"{q:g}"]
        low, high = np.searchsorted(sizes, v, "left") / n, np.searchsorted(sizes, v, "right") / n
        assert low - sketches.RANK_ERROR <= q <= high + sketches.RANK_ERROR
    want = {r.label: r["count"] for r in stats.histogram(stats.conversation_sizes(rows).filter("words > 0"), "words").collect()}
    got = {b: v for (m, b), v in told.items() if m == "words_histogram"}
    assert got.keys() == want.keys() and all(abs(got[b] - want[b]) <= 2 * sketches.RANK_ERROR * n for b in want)


def test_distinct_questions_are_near_the_exact_number(spark):
    rows = messages(spark, 9000)
    got = {r.metric: r.value for r in sketches.report(sketches.part_of(rows)).filter("bucket = ''").collect()}["distinct_questions"]
    want = rows.filter("role = 'user'").select("text").distinct().count()
    assert abs(got - want) <= 4 * sketches.DISTINCT_ERROR * want


def test_nothing_to_count(spark):
    none = messages(spark, 30).filter("false")
    told = {(r.metric, r.bucket): r.value for r in sketches.report(sketches.part_of(none)).collect()}
    assert told["conversations", ""] == 0 and told["words_quantile", "0.5"] is None and not [m for m, _ in told if "histogram" in m]
    both = sketches.merged(sketches.part_of(none).unionByName(sketches.part_of(messages(spark, 30))))
    assert both.first().conversations == 35
