"""Commits of streams: by order whatever the files' order, and to all tables or none."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parlance.functions.snapshots import Snapshots
from parlance.operators import dedup
from parlance.plans import catalog, dataset
from parlance.streaming import commits, fan_out

START = dt.datetime(2024, 1, 1)
SCHEMA = "conversation_index int, question string, ts timestamp"


def asked(n, seed=1):
    rng = random.Random(seed)
    form = lambda k: rng.choice([None, "", " "]) if k % 17 == 0 else f"Q  {rng.randrange(n // 4)}" if k % 2 else f"q {rng.randrange(n // 4)}"
    rows = [(k, form(k), START + dt.timedelta(minutes=k)) for k in range(n)]
    rng.shuffle(rows)
    return rows


def run(spark, folder, parts, **options):
    """Parts of rows arrive one after the other; after each the stream is started anew and stops when it has read all."""
    commits.use_store(spark)
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        told = commits.first_wins_stream(stream, **options)
        told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return {r.conversation_index: r.outcome for r in spark.read.parquet(f"{folder}/out").collect()}


def test_outcomes_equal_those_of_a_table(spark, tmp_path):
    rows = asked(120)
    end = [(9999, "end", START + dt.timedelta(days=30))]
    got = run(spark, f"file://{tmp_path}", [rows[:50], rows[50:], end], delay="4 hours")
    want = {r.conversation_index: r.outcome for r in dedup.first_wins(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: v for k, v in got.items() if k != 9999} == want


def test_later_rows_of_a_form_are_in_run_until_it_is_forgotten(spark, tmp_path):
    at = lambda hours: START + dt.timedelta(hours=hours)
    parts = [[(5, "a", at(0))], [(6, "x", at(10))], [(1, "A ", at(11))], [(7, "y", at(100))], [(8, "y2", at(101)), (0, "a", at(101))], [(9, "z", at(300))]]
    got = run(spark, f"file://{tmp_path}", parts, delay="1 hour", forget="2 days")
    assert (got[5], got[1], got[0], got[6]) == ("accepted", "in_run", "accepted", "accepted")


def test_state_is_held_by_buckets_whatever_the_columns_names(spark, tmp_path, monkeypatch):
    """Forms share the values and timers of a few buckets; columns come by place, and great whole numbers among nulls stay as they are."""
    monkeypatch.setattr(commits, "BUCKETS", 4)
    commits.use_store(spark)
    folder, rows = f"file://{tmp_path}", [(k, f"q {k % 300}", START + dt.timedelta(minutes=k), 2**53 + k if k % 7 else None) for k in range(900)]
    table = spark.createDataFrame(rows, "conversation_index int, question string, ts timestamp, _of long")
    table.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = commits.first_wins_stream(stream, delay="2 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    # A value of open forms and one timer, perhaps a stale one, for each bucket; with their index.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * 6
    told = {r.conversation_index: (r.outcome, r._of) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert told == {k: ("in_batch", of) for k, _, _, of in rows if k >= 300}


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('done')}/done"
    catalog.catalog_records.done(spark, "/root/testdata/sf0.001").write.parquet(path)
    return spark.read.parquet(path)


def test_batch_that_comes_again_changes_nothing(spark, tmp_path, finished):
    folder = f"file://{tmp_path}"
    write = fan_out.sink(folder, "r")
    assert fan_out.table(spark, folder, "turns") is None
    a, b = finished.filter("conversation_id < 'c5'"), finished.filter("conversation_id >= 'c5'")
    write(a, 0)
    counts = {name: fan_out.table(spark, folder, name).count() for name in dataset.TABLES}
    write(a, 0)
    assert counts == {name: fan_out.table(spark, folder, name).count() for name in dataset.TABLES} and counts["conversations"] == a.count() > 0
    write(b, 1)
    fan_out.sink(folder, "other")(a, 0)
    assert fan_out.table(spark, folder, "conversations").count() == finished.count() + a.count()


def test_batch_that_fails_half_way_is_not_seen(spark, tmp_path, finished, monkeypatch):
    folder = f"file://{tmp_path}"
    whole = dataset.tables_of

    def broken(rows, **options):
        tables = whole(rows, **options)
        return tables | {"turns": tables["turns"].withColumn("timestamp", F.raise_error(F.lit("lost")).cast("string"))}

    write = fan_out.sink(folder, "r")
    monkeypatch.setattr(dataset, "tables_of", broken)
    with pytest.raises(Exception, match="lost"):
        write(finished, 0)
    assert fan_out.table(spark, folder, "conversations") is None and Snapshots(spark, folder).latest() == 0
    monkeypatch.setattr(dataset, "tables_of", whole)
    write(finished, 0)
    assert fan_out.table(spark, folder, "conversations").count() == finished.count()
    assert fan_out.table(spark, folder, "conversations_sft").columns == spark.read.json(f"{folder}/conversations_sft").select("messages", "messages_with_tools", "metadata", "user_reasoning", "assistant_reasoning").columns


def test_messages_are_made_within_the_row(spark):
    """Calls are numbered over the turns' order, what nobody said is null, two rows of one id stay apart, and no row moves."""
    event = "struct<id:string,name:string,arguments:string,result:string>"
    rows = [
        ("x", [(2, "u2", None, [("", "n", "{}", "r"), ("g", "n", "{}", "")]), (1, "u1", "a1", [("", "m", "{}", "q")]), (3, "", "", None)], 1),
        ("e", [], 2), ("n", None, 3), ("z", [(1, "", None, None)], 4), ("x", [(1, "again", "", None)], 5),
    ]
    done = spark.createDataFrame(rows, f"conversation_id string, turns array<struct<turn_index:int,user:string,assistant:string,tool_events:array<{event}>>>, n_turns int")
    made = dataset.with_messages(done)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.n_turns: r.messages_with_tools and [(m.turn_index, m.pos, m.role, m.content, m.calls and [c.id for c in m.calls], m.tool_call_id) for m in r.messages_with_tools] for r in made.collect()}
    first = [(1, 0, "user", "u1", None, None), (1, 1, "assistant", "", ["call_0"], None), (1, 2, "tool", "q", None, "call_0"), (1, 3, "assistant", "a1", None, None)]
    second = [(2, 0, "user", "u2", None, None), (2, 1, "assistant", "", ["call_1", "g"], None), (2, 2, "tool", "r", None, "call_1")]
    assert got == {1: first + second, 2: None, 3: None, 4: None, 5: [(1, 0, "user", "again", None, None)]}
