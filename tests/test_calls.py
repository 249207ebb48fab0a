"""Calls from tasks: bounded, in order, patient, and paid for once."""

import collections
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from parlance.sources import calls


def counted(folder, fail_at=None):
    """A service that notes each request it answers, in a file of its own."""

    def load():
        def call(request):
            if request["n"] == fail_at and not os.path.exists(f"{folder}/failed"):
                open(f"{folder}/failed", "w").close()
                raise calls.Fatal("lost")
            with open(f"{folder}/paid_{request['n']}_{time.monotonic_ns()}_{threading.get_ident()}", "w"):
                pass
            return {"double": 2 * request["n"]}

        return call

    return load


def paid(folder):
    return collections.Counter(int(x.split("_")[1]) for x in os.listdir(folder) if x.startswith("paid_"))


def test_a_failed_task_pays_for_no_request_twice(spark, tmp_path, monkeypatch):
    noted, kept = tmp_path / "noted", f"file://{tmp_path}/kept"
    noted.mkdir()
    rows = spark.range(300).select((F.col("id") % 150).alias("n"), F.col("id"))
    ask = lambda fail_at: calls.answered(rows, counted(str(noted), fail_at), lambda r: {"n": int(r["n"])}, kept, limits=calls.Limits(in_flight=4, attempts=1))
    with pytest.raises(Exception, match="lost"):
        ask(70).collect()
    before = paid(noted)
    assert 70 not in before
    got = ask(70).collect()
    assert len(got) == 300 and all(r.reply == f'{{"double": {2 * r.n}}}' and r.error is None for r in got)
    assert paid(noted) == {n: 1 for n in range(150)} and set(before) <= set(range(150))
    ask(None).collect()
    assert sum(paid(noted).values()) == 150


def test_errors_are_told_and_asked_again_by_the_next_run(spark, tmp_path):
    kept = f"file://{tmp_path}/kept"
    rows = spark.range(5).withColumn("note", F.lit(None).cast("string"))
    limits = calls.Limits(attempts=3, pause=0.001)

    def load(bad):
        def call(request):
            if request["n"] in bad:
                raise ValueError(f"no {request['n']}")
            return request["n"]

        return lambda: call

    ask = lambda bad: {r.id: (r.reply, r.attempts, r.error) for r in calls.answered(rows, load(bad), lambda r: {"n": int(r["id"])}, kept, limits=limits).collect()}
    first = ask({2, 3})
    assert first[2] == (None, 3, "ValueError: no 2") and first[1] == ("1", 1, None)
    assert ask({3})[2] == ("2", 1, None)
    assert calls.answered(rows.filter("false"), load(set()), lambda r: {}, kept).count() == 0
    with pytest.raises(ValueError):
        calls.answered(rows.withColumn("Reply", F.lit(1)), load(set()), lambda r: {}, kept)


def test_waits_grow_and_calls_are_bounded():
    waits, now, most, lock = [], [0], [0], threading.Lock()
    limits = calls.Limits(in_flight=3, attempts=5, pause=1.0, longest=3.0, sleep=waits.append)
    reply, n, error = calls.attempt(lambda r: 1 / 0, {}, limits, "k")
    assert reply is None and n == 5 and isinstance(error, ZeroDivisionError)
    assert len(waits) == 4 and all(0.5 * b <= w <= b for w, b in zip(waits, (1, 2, 3, 3)))

    def work(k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.002 * (7 - k % 7))
        with lock:
            now[0] -= 1
        return k

    assert list(calls.in_order(range(30), work, limits)) == list(range(30)) and most[0] == 3
    assert sorted(calls.as_done(range(30), work, limits)) == list(range(30)) and most[0] == 3
