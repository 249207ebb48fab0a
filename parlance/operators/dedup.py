"""First-wins removal of duplicate questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.tables import written
from parlance.functions.text import normalize_question, question_hash, text_hash


def first_wins(batch: DataFrame, seen: DataFrame | None = None, *, question: str = "question", order: str = "conversation_index") -> DataFrame:
    """Rows of ``batch`` with the outcome: accepted, blank, in_run (asked before) or in_batch (an earlier row asks it).

    ``seen`` has a column of the same name as ``question``. Equality is on the normal form, told by its MD5, question_key,
    so texts move only if the caller asks for them. The first row of a form that several rows share wins, by ``order``.
    What was seen is marked by a left join on the key and the rank taken in one window over it: one partitioning for both.
    """
    key = F.md5(F.coalesce(normalize_question(F.col(question)), F.lit("")))
    rows = batch.withColumn("question_key", key)
    if seen is not None:
        known = seen.select(key.alias("question_key")).distinct().withColumn("known", F.lit(True))
        rows = rows.join(known, "question_key", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("boolean"))
    turn = F.row_number().over(W.partitionBy("question_key").orderBy(F.col(order)))
    blank = F.col("question_key") == F.md5(F.lit(""))
    outcome = F.when(blank, "blank").when(F.col("known"), "in_run").when(turn > 1, "in_batch").otherwise("accepted")
    return rows.withColumn("outcome", outcome).drop("known")


def accepted(batch: DataFrame, seen: DataFrame | None = None, **options) -> DataFrame:
    """The rows that ``first_wins`` accepts, by two shuffles at most and no collect."""
    return first_wins(batch, seen, **options).filter("outcome = 'accepted'").drop("outcome")


def registry(turns: DataFrame, ledger: DataFrame) -> DataFrame:
    """Normal forms of all questions asked so far: those of accepted turns and of the ledger."""
    both = turns.select("question").unionByName(ledger.select("question"))
    return both.select(normalize_question(F.col("question")).alias("question")).filter("question <> ''").distinct()


def in_source_duplicates(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates whose question the ledger has for the same source. Blank questions and unknown sources are never duplicates."""
    known = ledger.select("source_path", question_hash(F.col("question")).alias("question_hash")).distinct()
    asked = candidates.filter(F.coalesce("source_path", F.lit("")) != "").withColumn("question_hash", question_hash(F.col("question")))
    # Blank questions are told by their hash, as the normal form is what costs.
    return asked.filter(F.col("question_hash") != text_hash(F.lit(""))).join(known, ["source_path", "question_hash"], "left_semi")


def repeats_in_source(rows: DataFrame, *, order: str) -> DataFrame:
    """Rows (source_path, question, ``order``) whose question a row of lower order of the same source asks, with question_hash.

    Blank questions and unknown sources never count. Texts are read once, and what moves are hashes and the other columns.
    """
    known = rows.filter(F.coalesce("source_path", F.lit("")) != "").withColumn("question_hash", question_hash(F.col("question"))).drop("question")
    place = F.rank().over(W.partitionBy("source_path", "question_hash").orderBy(order))
    # One condition with the rank in it, so that it isn't moved ahead of the window, where the hash would be made twice.
    again = F.when(F.col("question_hash") != text_hash(F.lit("")), F.col("_place")).otherwise(1) > 1
    return known.withColumn("_place", place).filter(again).drop("_place")


def commit_with_retries(
    slots: DataFrame,
    ask: Callable[[DataFrame, int], DataFrame],
    seen: DataFrame,
    *,
    save: Callable[[DataFrame, str], DataFrame] = written,
    retries: int = 3,
    lenient: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Ask for a question for every slot, again for those rejected, up to ``retries`` more times.

    ``ask`` takes slots (conversation_index) and the attempt's number and adds a question; it may call a model, so each
    attempt's answers are written by ``save`` (a table and a name) before anything is decided on them, and are asked for
    once. Returns the accepted rows and the slots that are dropped as exhausted; with ``lenient`` the last attempt of
    those is accepted although it repeats.
    """
    taken: DataFrame | None = None
    waiting = slots
    for attempt in range(retries + 1):
        asked = save(ask(waiting, attempt), f"asked_{attempt}")
        judged = first_wins(asked, seen).withColumn("attempt", F.lit(attempt))
        good = judged.filter("outcome <> 'blank'" if lenient and attempt == retries else "outcome = 'accepted'")
        good = save(good.drop("outcome", "question_key"), f"accepted_{attempt}")
        taken = good if taken is None else taken.unionByName(good)
        seen = seen.select("question").unionByName(good.select("question"))
        waiting = save(waiting.join(good.select("conversation_index"), "conversation_index", "left_anti"), f"waiting_{attempt}")
        if attempt < retries and not waiting.limit(1).count():
            break
    return taken, waiting.withColumn("drop_reason", F.lit("dedup_exhausted"))
