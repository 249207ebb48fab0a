"""Questions that a model is asked for: once each, although they differ each time."""

import random

import pandas as pd
from pyspark.sql import functions as F

from parlance.functions.tables import numbered
from parlance.operators import chunking, dedup
from parlance.plans import dataset, state


def test_each_attempt_is_asked_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def ask(slots, attempt):
        def draw(batches):
            for b in batches:
                asked.add(len(b))
                yield b.assign(question=[f"q{random.randrange(40)}" for _ in range(len(b))])

        return slots.select("conversation_index").mapInPandas(draw, "conversation_index int, question string")

    slots = spark.range(100).select(F.col("id").cast("int").alias("conversation_index"))
    good, gone = dedup.commit_with_retries(slots, ask, spark.createDataFrame([("q1",)], "question string"), retries=2)
    taken, dropped = [(r.conversation_index, r.question, r.attempt) for r in good.collect()], [r.conversation_index for r in gone.collect()]
    assert sorted([i for i, _, _ in taken] + dropped) == list(range(100))
    assert len({q for _, q, _ in taken}) == len(taken) and "q1" not in {q for _, q, _ in taken}
    left = [100 - sum(a < n for _, _, a in taken) for n in range(3)]
    assert asked.value == sum(left)


def test_a_slot_is_never_both_answered_and_dropped(spark, tmp_path):
    slots = state.init_slots(spark, "run", spark.range(30).select(F.col("id").cast("int").alias("conversation_index"), F.lit("2").alias("target_n_turns")))
    ask = lambda s, t, n: s.withColumn("question", F.concat(F.lit("q"), F.floor(F.rand() * 25).cast("string")))
    after, turns = state.run_batch(slots, spark.createDataFrame([], "question string"), ask, lambda a: a.withColumn("assistant", F.lit("a")), folder=str(tmp_path), run_id="run", last_turn=2, retries=1)
    told = {}
    for r in turns.collect():
        told.setdefault(r.conversation_index, []).append(r.turn_index)
    for r in after.collect():
        assert r.n_turns == len(told.get(r.conversation_index, [])) and r.status == ("completed" if r.n_turns == 2 else "dropped")


def test_numbers_run_through(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = numbered(rows, F.expr("k div 64"), "k").collect()
    assert all(r.k == r.place for r in got) and len(got) == 1000


def test_fingerprint_follows_each_file(spark):
    files = spark.range(500).select(F.concat(F.lit("/f"), "id").alias("path"), F.col("id").alias("size"), F.lit(1).alias("mtime"))
    one = chunking.fingerprint(files, {"size": 750})
    assert one == chunking.fingerprint(files.repartition(3), {"size": 750}) != chunking.fingerprint(files, {"size": 751})
    changed = files.withColumn("mtime", F.when(F.col("path") == "/f7", 2).otherwise(F.col("mtime")))
    assert one != chunking.fingerprint(changed, {"size": 750})


def test_readers_see_old_rows_or_new(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    dataset.replace_table(spark.range(3), path)
    dataset.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
    assert isinstance(spark.read.parquet(path).toPandas(), pd.DataFrame)
