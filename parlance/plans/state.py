"""Slots of a run: conversations in flight, from their start over turns to completion, with checkpoints as tables.

A slot table has conversation_index, conversation_id, target_n_turns, status (active, completed, dropped), drop_reason
and n_turns. Turns are kept apart, by (run_id, conversation_index, turn_index), and appended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.conversations import conversation_id
from parlance.operators.dedup import commit_with_retries

STATUSES = ("active", "completed", "dropped")


def init_slots(spark: SparkSession, run_id: str, targets: DataFrame) -> DataFrame:
    """A slot for each row of ``targets`` (conversation_index, target_n_turns); a target that is no positive number is 1."""
    target = F.col("target_n_turns").try_cast("int")
    return targets.select(
        "conversation_index",
        conversation_id(F.lit(run_id), F.col("conversation_index")).alias("conversation_id"),
        F.when(target > 0, target).otherwise(1).alias("target_n_turns"),
        F.lit("active").alias("status"),
        F.lit("").alias("drop_reason"),
        F.lit(0).alias("n_turns"),
    )


def restore_slots(spark: SparkSession, run_id: str, saved: DataFrame, batch_size: int, fallback_target: int) -> DataFrame:
    """Exactly ``batch_size`` slots: those saved, repaired where a field is odd, and new ones for the rest."""
    all_slots = spark.range(batch_size).select(F.col("id").cast("int").alias("conversation_index"))
    joined = all_slots.join(saved.withColumn("conversation_index", F.col("conversation_index").cast("int")), "conversation_index", "left")
    target = F.col("target_n_turns").try_cast("int")
    return joined.select(
        "conversation_index",
        F.coalesce(F.nullif(F.trim("conversation_id"), F.lit("")), conversation_id(F.lit(run_id), F.col("conversation_index"))).alias("conversation_id"),
        F.when(target > 0, target).otherwise(fallback_target).alias("target_n_turns"),
        F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("active").alias("status"),
        F.coalesce("drop_reason", F.lit("")).alias("drop_reason"),
        F.coalesce("n_turns", F.lit(0)).alias("n_turns"),
    )


def check_resume(saved_batch_size: int | None, batch_size: int) -> None:
    if saved_batch_size is None:
        raise ValueError("the saved state has no conversations")
    if saved_batch_size != batch_size:
        raise ValueError(f"the saved state has {saved_batch_size} conversations, not {batch_size}")


def run_id_of(resume: str | None, run_id: str | None, known: set[str]) -> tuple[str, bool]:
    """The run to go on with and whether it is resumed: a resume id that is known, else the given id, else a new one."""
    if resume and resume in known:
        return resume, True
    return run_id or str(uuid.uuid4()), False


def active_for(slots: DataFrame, turn: int) -> DataFrame:
    return slots.filter((F.col("status") == "active") & (F.col("n_turns") == turn - 1) & (F.col("n_turns") < F.col("target_n_turns")))


def advance(slots: DataFrame, answered: DataFrame, dropped: DataFrame) -> DataFrame:
    """Slots after a turn: one turn more for the answered, completed at their target; dropped ones with their reason."""
    done = answered.select("conversation_index").distinct().withColumn("answered", F.lit(1))
    gone = dropped.select("conversation_index", F.col("drop_reason").alias("why")).dropDuplicates(["conversation_index"])
    joined = slots.join(done, "conversation_index", "left").join(gone, "conversation_index", "left")
    turns = F.col("n_turns") + F.coalesce("answered", F.lit(0))
    status = F.when(F.col("why").isNotNull(), "dropped").when((F.col("status") == "active") & (turns >= F.col("target_n_turns")), "completed")
    return joined.select(
        "conversation_index",
        "conversation_id",
        "target_n_turns",
        status.otherwise(F.col("status")).alias("status"),
        F.coalesce("why", "drop_reason").alias("drop_reason"),
        turns.alias("n_turns"),
    )


def persistable(slots: DataFrame) -> DataFrame:
    """Slots with a turn at least, dropped ones too."""
    return slots.filter("n_turns > 0")


def outcome_counts(slots: DataFrame) -> DataFrame:
    return slots.agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "dropped").alias("dropped"))


def checkpoint(df: DataFrame, folder: str, run_id: str, turn: int, name: str) -> DataFrame:
    """Write a table of the run's state after a turn and read it again: the next turn starts from files, not from a lineage."""
    path = f"{folder.rstrip('/')}/run_id={run_id}/turn={turn}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_batch(
    slots: DataFrame,
    seen: DataFrame,
    ask: Callable[[DataFrame, int, int], DataFrame],
    answer: Callable[[DataFrame], DataFrame],
    *,
    folder: str,
    run_id: str,
    last_turn: int,
    retries: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Turns of a batch of conversations: ask, reject duplicates and ask again, answer, advance, checkpoint.

    ``ask`` takes the active slots, the turn and the attempt and returns conversation_index and question; ``answer``
    adds ``assistant`` to accepted questions. Returns the slots and all turns.
    """
    spark, turns = slots.sparkSession, None
    for turn in range(1, last_turn + 1):
        keep = lambda df, name, t=turn: checkpoint(df, folder, run_id, t, name)
        good, gone = commit_with_retries(active_for(slots, turn).select("conversation_index"), lambda s, n, t=turn: ask(s, t, n), seen, save=keep, retries=retries)
        asked = checkpoint(good.select("conversation_index", "question", "attempt"), folder, run_id, turn, "asked")
        gone = checkpoint(gone.select("conversation_index", "drop_reason"), folder, run_id, turn, "dropped")
        told = checkpoint(answer(asked).withColumn("turn_index", F.lit(turn)), folder, run_id, turn, "turns")
        slots = checkpoint(advance(slots, told, gone), folder, run_id, turn, "slots")
        seen = checkpoint(seen.select("question").unionByName(told.select("question")), folder, run_id, turn, "seen")
        turns = told if turns is None else turns.unionByName(told)
    return slots, turns if turns is not None else spark.createDataFrame([], "conversation_index int, question string, attempt int, assistant string, turn_index int")
