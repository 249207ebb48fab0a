"""Writing a run's results: dataset rows, artifacts, index, turns, chat records; state by run; replacement as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.snapshots import Snapshots
from parlance.operators import conversations as C
from parlance.operators import records as R

#: The tables that a conversation goes to.
TABLES = ("synthetic_qa", "conversations", "conversations_index", "conversations_sft", "conversations_sft_judged", "turns")
#: Bytes of a row group of the copy that the tables are written from: small, so that one file is read by several tasks.
COPY_BLOCK = 8 << 20
RUN_STATUSES = ("started", "resumed", "in_progress", "completed")


def append_rows(df: DataFrame, path: str) -> None:
    """Rows appended as JSON lines, nulls kept, in files of their own, so nothing that is there is rewritten."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def with_messages(done: DataFrame) -> DataFrame:
    """Adds ``messages``, the turns' user and assistant texts in order, ``messages_with_tools`` and ``artifact_turns``, their number; all within the row."""
    none = F.array().cast("array<struct<role:string,content:string>>")
    return done.withColumn("messages_with_tools", C.called_messages(F.col("turns"))).withColumn("messages", C.chat_messages(F.col("turns"), none)).withColumn("artifact_turns", F.coalesce("n_turns", F.size("turns")))


def tables_of(rows: DataFrame, *, columns: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The rows that finished conversations give each table; ``rows`` comes from ``with_messages``, ``columns`` renames those of chat records."""
    last, chat = F.element_at("turns", -1), chat_records(rows)
    return {
        "synthetic_qa": rows.select("conversation_id", "timestamp", "question", last["user"].alias("last_question"), last["assistant"].alias("final_answer"), last["judge"].alias("qa_judge"), "conversation_judge", "turns", "messages"),
        "conversations": rows.select(
            "conversation_id", "timestamp", F.col("question").alias("seed_question"), F.col("artifact_turns").alias("n_turns"), "language", "personas", "messages", "messages_with_tools",
            C.user_reasoning(F.col("turns")).alias("user_reasoning"), C.assistant_reasoning(F.col("turns")).alias("assistant_reasoning"), "conversation_judge", "turns",
        ),
        "conversations_index": rows.select("conversation_id", "timestamp", F.col("artifact_turns").alias("n_turns"), F.col("question").alias("seed_question"), "language"),
        "conversations_sft": C.rename_columns(chat.drop("judge", "emit"), columns or {}),
        "conversations_sft_judged": C.rename_columns(chat.filter("emit").drop("emit"), columns or {}),
        "turns": R.turn_rows(rows),
    }


def write_conversations(done: DataFrame, folder: str, *, columns: dict[str, str] | None = None) -> None:
    """Fan finished conversations out to the tables, each appended to; they are read once from a written copy.

    ``done`` has conversation_id, timestamp, question, language, n_turns (null for the number of turns), personas,
    judge_enabled, judge_granularity, conversation_judge (a verdict) and turns. ``columns`` renames those of chat records.
    A crash leaves some tables written: ``streaming.fan_out`` commits a batch to all of them or none.
    """
    spark, copy = done.sparkSession, f"{folder.rstrip('/')}/_batches/{uuid.uuid4().hex}"
    made = with_messages(done)
    made.write.option("parquet.block.size", COPY_BLOCK).parquet(copy)
    for name, rows in tables_of(spark.read.schema(made.schema).parquet(copy), columns=columns).items():
        append_rows(rows, f"{folder.rstrip('/')}/{name}")


def chat_records(rows: DataFrame) -> DataFrame:
    """Chat records with their verdicts, and ``emit``, whether a judged record is due."""
    verdicts = F.transform("turns", lambda t: t["judge"])
    return rows.select(
        "messages", "messages_with_tools", C.sft_metadata(F.col("turns")).alias("metadata"), C.user_reasoning(F.col("turns")).alias("user_reasoning"),
        C.assistant_reasoning(F.col("turns")).alias("assistant_reasoning"), R.judge_payload(F.col("turns"), F.col("conversation_judge")).alias("judge"),
        C.emits_judged(F.col("conversation_judge"), F.col("judge_enabled"), verdicts).alias("emit"),
    )


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet beside ``path``, then put it there by renaming: never a part, though for a moment nothing.

    Readers that mustn't meet that moment read a table of versions, see ``functions.snapshots``.
    """
    spark, part = df.sparkSession, uuid.uuid4().hex
    fresh, stale = f"{path.rstrip('/')}.{part}.tmp", f"{path.rstrip('/')}.{part}.old"
    df.write.parquet(fresh)
    to = spark._jvm.org.apache.hadoop.fs.Path
    files = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = files.exists(to(path))
    if had and not files.rename(to(path), to(stale)):
        raise OSError(f"can't move {path} away")
    if not files.rename(to(fresh), to(path)):
        if had:
            files.rename(to(stale), to(path))
        raise OSError(f"can't move the new rows to {path}")
    if had:
        files.delete(to(stale), True)


def write_seeds(seeds: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """The seed table as Parquet; one that is there is an error unless it may be overwritten."""
    seeds.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def save_run_state(slots: DataFrame, folder: str, run_id: str, status: str) -> None:
    """The whole state of a run as its new version, and its id as the last one saved; readers always find a whole state."""
    if status not in RUN_STATUSES:
        raise ValueError(f"no such status: {status}")
    spark, out = slots.sparkSession, folder.rstrip("/")
    Snapshots(spark, f"{out}/runs/{run_id}").publish(slots.withColumn("run_status", F.lit(status)))
    Snapshots(spark, f"{out}/last_run").publish(spark.createDataFrame([(run_id,)], "run_id string"))


def load_run_state(spark: SparkSession, folder: str, run_id: str | None = None, *, version: int | None = None) -> DataFrame | None:
    """The state saved for a run, by default for the last one and as saved last; None if there is none."""
    out = folder.rstrip("/")
    if run_id is None:
        last = Snapshots(spark, f"{out}/last_run").read()
        run_id = last.first().run_id if last else ""
    return Snapshots(spark, f"{out}/runs/{run_id}").read(version) if run_id else None
