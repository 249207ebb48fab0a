"""Streams: first-wins questions, windowed counts, a ledger kept up by micro-batches. Extensions on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from parlance.functions.text import normalize_question
from parlance.operators.coverage import ledger_rows


def first_questions(stream: DataFrame, *, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Questions of a stream whose normal form hasn't come within ``delay``; the state is dropped behind the watermark."""
    form = normalize_question(F.col("question"))
    rows = stream.withWatermark(time, delay).withColumn("normalized", form).filter(F.col("normalized") != "")
    return rows.dropDuplicatesWithinWatermark(["normalized"])


def window_counts(stream: DataFrame, key: str, *, time: str = "ts", delay: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Rows by window and key, late ones up to the watermark: window_start, key, count."""
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, width, slide) if slide else F.window(time, width), key)
    return grouped.agg(F.count("*").alias("count")).select(F.col("window.start").alias("window_start"), key, "count")


def append_ledger(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends each micro-batch's accepted questions to the ledger, once: a batch's folder is overwritten if it runs again."""

    def write(batch: DataFrame, number: int) -> None:
        ledger_rows(batch).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
