"""Statistics of a dialogue dataset: counts, means, distributions, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.tables import written
from parlance.functions.text import token_estimate, word_count

BINS = 12


def message_sizes(messages: DataFrame, *more: str) -> DataFrame:
    """Words and estimated tokens of each message: conv_id, turn, words, tokens, and other columns if asked for."""
    return messages.select("conv_id", "turn", *more, word_count(F.col("text")).alias("words"), token_estimate(F.col("text")).alias("tokens"))


def conversation_sizes(messages: DataFrame) -> DataFrame:
    """Sums by conversation: conv_id, n_messages, words, tokens. Sizes are counted before the shuffle, so no text moves."""
    return message_sizes(messages).groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))


def text_totals(messages: DataFrame) -> DataFrame:
    """One row of averages. Conversations without words don't count; messages without do."""
    return totals_of(conversation_sizes(messages))


def totals_of(per: DataFrame) -> DataFrame:
    """The averages from the conversations' sums."""

    def mean(x: Column, n: Column) -> Column:
        return F.bround(F.when(n > 0, x / n), 4)

    out = [mean(F.sum(c), F.count_if(F.col(c) > 0)).alias(f"avg_{c}_per_conversation") for c in ("words", "tokens")]
    out += [mean(F.sum(c), F.sum("n_messages")).alias(f"avg_{c}_per_message") for c in ("words", "tokens")]
    return per.agg(F.count("*").alias("conversations"), F.sum("n_messages").cast("long").alias("messages"), *out)


def turn_counts(messages: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Turns of each conversation: a number in the record's metadata, else judged turns, else user messages, else null.

    ``records`` has conv_id, n_turns (text) and judged_turns.
    """
    asked = messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"))
    if records is None:
        return asked.select("conv_id", F.nullif("asked", F.lit(0)).alias("n_turns"))
    return turns_of(records, asked)


def turns_of(records: DataFrame, asked: DataFrame) -> DataFrame:
    """The turns of each record, with the user messages counted as ``asked``."""
    both = records.join(asked, "conv_id", "left")
    said = F.col("n_turns").try_cast("double").cast("long")
    return both.select("conv_id", F.coalesce(said, F.nullif(F.col("judged_turns").cast("long"), F.lit(0)), F.nullif("asked", F.lit(0))).alias("n_turns"))


def spread(counts: DataFrame, value: str) -> DataFrame:
    """Least, greatest and mean (4 digits, half to even); nulls for no rows."""
    return counts.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.bround(F.avg(value), 4).alias("avg"))


def distribution(df: DataFrame, value: str, name: str | None = None) -> DataFrame:
    """Rows of each value but null: value, count."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias(name or value)).agg(F.count("*").alias("count"))


def non_blank_counts(df: DataFrame, value: str) -> DataFrame:
    return distribution(df.filter(F.trim(value) != ""), value)


def score_bucket(score: Column) -> Column:
    """Scores rounded half to even and held in 0 to 10; null stays null."""
    return F.when(score.isNotNull(), F.least(F.lit(10), F.greatest(F.lit(0), F.bround(score.cast("double")).cast("int"))))


def histogram(df: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins over whole numbers: label ``start-end``, count; empty bins are left out.

    Bins are as wide as (max - min + 1) / bins rounded up, at least 1; the last one ends at the greatest value. If all
    values are equal the label is that one value twice. The bounds are one row, broadcast.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("long").alias("v"))
    bounds = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    bounds = bounds.withColumn("width", F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / bins)).cast("long"))
    counted = rows.groupBy("v").agg(F.count("*").alias("n"))
    placed = counted.join(F.broadcast(bounds)).withColumn("bin", F.expr("(v - low) div width"))
    start = F.col("low") + F.col("bin") * F.col("width")
    end = F.least("high", start + F.col("width") - 1)
    out = placed.groupBy("bin", start.alias("start"), end.alias("end")).agg(F.sum("n").alias("count"))
    return out.select(F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")).alias("label"), "start", "count")


def mean_score(scores: Column) -> Column:
    """Mean of an array of numbers, nulls left out; null if none is left."""
    kept = F.filter(scores, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(kept))


def mean_by(rows: DataFrame, score: Column, *keys: str) -> DataFrame:
    """Mean score for each key, nulls left out, added up where the rows are; null if none is left."""
    return rows.groupBy(*keys).agg(F.avg(score.cast("double")).alias("mean"))


def judged(records: DataFrame) -> DataFrame:
    """Per record the average score, falling back to the conversation's, and whether any score exists.

    ``records`` has avg_score, conversation_score (doubles) and per_turn (array of doubles).
    """
    any_turn = F.exists(F.coalesce("per_turn", F.array().cast("array<double>")), lambda x: x.isNotNull())
    has = F.col("avg_score").isNotNull() | F.col("conversation_score").isNotNull() | any_turn
    return records.withColumns({"score": F.coalesce("avg_score", "conversation_score"), "has_score": has})


def report(messages: DataFrame, records: DataFrame, *, bins: int = BINS) -> DataFrame:
    """The whole report as rows (metric, bucket, value).

    ``records`` has conv_id, language, n_turns, judged_turns, avg_score, conversation_score, per_turn. Messages are read
    once: their sums by conversation are written, and all that concerns texts and turns comes from that small table.
    """
    sums = message_sizes(messages.withColumn("asked", (F.col("role") == "user").cast("int")), "asked").groupBy("conv_id")
    sizes = written(sums.agg(F.count("*").alias("n_messages"), F.sum("words").alias("words"), F.sum("tokens").alias("tokens"), F.sum("asked").alias("asked")), "sizes")

    def long(df: DataFrame, metric: str, bucket: str | None, value: str) -> DataFrame:
        key = F.col(bucket).cast("string") if bucket else F.lit("")
        return df.select(F.lit(metric).alias("metric"), key.alias("bucket"), F.col(value).cast("double").alias("value"))

    turns, scored = turns_of(records, sizes.select("conv_id", "asked")), judged(records)
    turn_scores = scored.select(F.explode("per_turn").alias("s")).filter("s is not null")
    limits, totals = spread(turns, "n_turns"), totals_of(sizes)
    coverage = scored.agg(F.count_if("has_score").alias("n"), F.bround(F.avg("score"), 4).alias("mean"))
    turn_mean = turn_scores.agg(F.count("*").alias("n"), F.bround(F.avg("s"), 4).alias("mean"))
    parts = [
        long(records.agg(F.count("*").alias("n")), "records", None, "n"),
        long(non_blank_counts(records, "language"), "languages", "language", "count"),
        *[long(limits, f"turn_count_{c}", None, c) for c in ("min", "max", "avg")],
        long(distribution(turns, "n_turns"), "turn_count_distribution", "n_turns", "count"),
        long(coverage, "conversations_with_scores", None, "n"),
        long(coverage, "avg_score_mean", None, "mean"),
        long(distribution(scored.withColumn("b", score_bucket(F.col("score"))), "b"), "avg_score_distribution", "b", "count"),
        long(turn_mean, "per_turn_score_mean", None, "mean"),
        long(distribution(turn_scores.withColumn("b", score_bucket(F.col("s"))), "b"), "per_turn_score_distribution", "b", "count"),
        *[long(totals, c, None, c) for c in totals.columns if c.startswith("avg_")],
        *[long(histogram(sizes.filter(f"{c} > 0"), c, bins), f"{c}_histogram", "label", "count") for c in ("words", "tokens")],
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
