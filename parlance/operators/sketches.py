"""Statistics that add up: a small summary of each part of a dataset, merged without reading the part again."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parlance.functions.snapshots import Conflict, Snapshots
from parlance.functions.text import normalize_question
from parlance.operators.stats import BINS, message_sizes

#: Size of a quantile sketch: ranks are within RANK_ERROR of the share of rows, with 99 % confidence; up to K values are held exactly.
K, RANK_ERROR = 800, 0.0055
#: Bits of a sketch of distinct values: counts are within DISTINCT_ERROR, as one standard deviation.
LG_K, DISTINCT_ERROR = 14, 0.0081
SIZES = ("words", "tokens")


def part_of(messages: DataFrame) -> DataFrame:
    """The summary of a part, one row: counts and sums, bounds and quantile sketches of the sizes by conversation, distinct questions.

    ``messages`` has conv_id, turn, role and text; a conversation must lie in one part as a whole. Conversations without
    words are counted but have no place in the sizes.
    """
    question = F.when(F.col("role") == "user", F.nullif(normalize_question(F.col("text")), F.lit("")))
    sizes = message_sizes(messages.withColumn("question", question), "question")
    # Distinct questions are sketched by conversation and merged, so no text moves.
    per = sizes.groupBy("conv_id").agg(F.count("*").alias("n_messages"), *[F.sum(c).alias(c) for c in SIZES], F.hll_sketch_agg("question", LG_K).alias("questions"))
    # Of no rows a union would be a sketch of another size.
    union = F.when(F.count("questions") > 0, F.hll_union_agg("questions")).alias("questions")
    found: list[Column] = [F.count("*").alias("conversations"), F.sum("n_messages").alias("messages"), union]
    for c in SIZES:
        some = F.when(F.col(c) > 0, F.col(c))
        found += [F.sum(c).alias(f"{c}_sum"), F.count(some).alias(f"{c}_n"), F.min(some).alias(f"{c}_min"), F.max(some).alias(f"{c}_max"), F.kll_sketch_agg_bigint(some, K).alias(f"{c}_sketch")]
    return per.agg(*found)


def merged(parts: DataFrame) -> DataFrame:
    """One summary of several: sums, bounds and sketches added up. No rows give counts of 0 or null."""
    union = F.when(F.count("questions") > 0, F.hll_union_agg("questions")).alias("questions")
    found: list[Column] = [*[F.sum(c).alias(c) for c in ("conversations", "messages")], union]
    for c in SIZES:
        found += [F.sum(f"{c}_sum").alias(f"{c}_sum"), F.sum(f"{c}_n").alias(f"{c}_n"), F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max"), F.kll_merge_agg_bigint(F.col(f"{c}_sketch"), K).alias(f"{c}_sketch")]
    return parts.agg(*found)


def report(summary: DataFrame, *, bins: int = BINS) -> DataFrame:
    """Rows (metric, bucket, value) of a summary: exact counts, means and bounds; distinct questions, quartiles and histograms from the sketches.

    A histogram's bins are those of ``stats.histogram``; a bin's count is off by RANK_ERROR of all at either end, at most,
    with 99 % confidence.
    """
    rows: list[Column] = []

    def add(metric: str, value: Column, bucket: Column | None = None) -> None:
        rows.append(F.struct(F.lit(metric).alias("metric"), (F.lit("") if bucket is None else bucket).alias("bucket"), value.cast("double").alias("value")))

    add("conversations", F.col("conversations"))
    add("messages", F.col("messages"))
    add("distinct_questions", F.coalesce(F.hll_sketch_estimate("questions"), F.lit(0)))
    for c in SIZES:
        add(f"avg_{c}_per_conversation", F.bround(F.try_divide(F.col(f"{c}_sum"), F.col(f"{c}_n")), 4))
        add(f"avg_{c}_per_message", F.bround(F.try_divide(F.col(f"{c}_sum"), F.col("messages")), 4))
        add(f"{c}_min", F.col(f"{c}_min"))
        add(f"{c}_max", F.col(f"{c}_max"))
        for q in (0.25, 0.5, 0.75):
            add(f"{c}_quantile", F.when(F.col(f"{c}_n") > 0, F.kll_sketch_get_quantile_bigint(f"{c}_sketch", F.lit(q))), F.lit(f"{q:g}"))
    single = summary.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return single.unionByName(histograms(summary, bins)) if bins else single


def histograms(summary: DataFrame, bins: int = BINS) -> DataFrame:
    """Rows (metric, bucket, value): counts by bin of the sizes, from the ranks of the bins' ends; empty bins are left out.

    The bounds of the one row come to the driver first, as a sketch is asked for ranks of constants.
    """
    names = [f"{c}_{x}" for c in SIZES for x in ("n", "min", "max")]
    found = summary.select(*names).first()
    entries = F.array().cast("array<struct<metric:string,bucket:string,value:double>>")
    for c in SIZES if found else ():
        n, low, high = (found[f"{c}_{x}"] for x in ("n", "min", "max"))
        if n:
            width = max(1, -(-(high - low + 1) // bins))
            starts = list(range(low, high + 1, width))
            ends = [min(high, s + width - 1) for s in starts]
            ranks = F.kll_sketch_get_rank_bigint(f"{c}_sketch", F.array(*[F.lit(e).cast("long") for e in ends]))
            for k, (start, end) in enumerate(zip(starts, ends)):
                share = ranks[k] - (ranks[k - 1] if k else F.lit(0.0))
                row = F.struct(F.lit(f"{c}_histogram").alias("metric"), F.lit(f"{start}-{end}").alias("bucket"), F.round(share * n).alias("value"))
                entries = F.array_append(entries, row)
    return summary.select(F.explode(entries).alias("r")).select("r.*").filter("value > 0")


def keep(spark: SparkSession, folder: str, part: str, messages: DataFrame) -> int:
    """Store a part's summary under its name, in place of an earlier one of that name; the version that holds now."""
    held = Snapshots(spark, folder)
    summary = part_of(messages)
    written = held.write(summary.coalesce(1))
    while True:
        last = held.latest()
        before = held.record(last) or {}
        try:
            return held.commit({"schema": summary.schema.json(), "parts": before.get("parts", {}) | {part: written}}, last)
        except Conflict:
            continue


def kept(spark: SparkSession, folder: str) -> DataFrame | None:
    """The summaries of all parts, a row each; None if there is none."""
    record = Snapshots(spark, folder).record()
    if record is None:
        return None
    return spark.read.schema(StructType.fromJson(json.loads(record["schema"]))).parquet(*[f"{folder.rstrip('/')}/data/{name}" for name in record["parts"].values()])

