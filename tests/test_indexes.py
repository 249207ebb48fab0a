"""Indexes, versions and commits: what is kept, what is written anew, what readers see."""

import threading

import pytest
from pyspark.sql import functions as F

from parlance.functions.snapshots import Conflict, Snapshots
from parlance.operators import chunking
from parlance.plans import chunk_index


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, mtime string, text string").withColumn("size", F.length("text"))


def rows_of(df):
    return sorted((r.path, r.chunk_index, r.text, r.char_start, r.char_end, r.id) for r in df.collect())


def test_index_equals_a_rebuild_and_reads_only_what_changed(spark, tmp_path):
    folder, loaded = f"file://{tmp_path}/index", []
    states = [
        [(f"/f{k}", "1", f"text {k} " * 200) for k in range(40)],
        [(f"/f{k}", "2" if k == 7 else "1", ("other " if k == 7 else f"text {k} ") * 200) for k in range(1, 42)],
        [(f"/f{k}", "1", f"text {k} " * 200) for k in range(3)],
        [],
        [("/f1", "9", "")],
    ]
    changed = [40, 3, 1, 0, 1]
    for rows, n in zip(states, changed):
        now = files(spark, rows)

        def load(paths, now=now):
            loaded.append(paths.count())
            return now.select("path", "text").join(paths, "path", "left_semi")

        loaded.clear()
        done = chunk_index.refresh(spark, folder, now.select("path", "size", "mtime"), load)
        assert done.cut == n == sum(loaded)
        assert rows_of(chunk_index.chunks(spark, folder)) == rows_of(chunking.chunk(now.select("path", "text"), path="path"))
    assert len(rows_of(chunk_index.chunks(spark, folder, 1))) == len(rows_of(chunking.chunk(files(spark, states[0]).select("path", "text"), path="path")))


def test_other_options_make_all_new_and_failures_change_nothing(spark, tmp_path):
    folder, now = f"file://{tmp_path}/index", files(spark, [(f"/f{k}", "1", f"text {k} " * 100) for k in range(5)])
    load = lambda paths: now.select("path", "text").join(paths, "path", "left_semi")
    manifest = now.select("path", "size", "mtime")
    assert chunk_index.refresh(spark, folder, manifest, load).cut == 5
    before = rows_of(chunk_index.chunks(spark, folder))
    broken = lambda paths: load(paths).withColumn("text", F.when(F.rand() < 2, F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        chunk_index.refresh(spark, folder, manifest.withColumn("mtime", F.lit("2")), broken)
    assert rows_of(chunk_index.chunks(spark, folder)) == before and Snapshots(spark, folder).latest() == 1
    assert chunk_index.refresh(spark, folder, manifest, load, size=100, overlap=10).cut == 5
    assert max(r.char_end - r.char_start for r in chunk_index.chunks(spark, folder).collect()) == 100


def test_cache_of_a_crash_is_not_read(spark, tmp_path):
    cache = f"file://{tmp_path}"
    manifest = spark.createDataFrame([("/a", 1, 1)], "path string, size long, mtime long")
    held = Snapshots(spark, f"{cache}/{chunking.fingerprint(manifest, {})}")
    held.write(spark.range(3))  # written, never committed
    assert chunking.refresh(manifest, spark.range(5), cache, {}).count() == 5
    assert chunking.refresh(manifest, spark.range(9), cache, {}).count() == 5


def test_readers_never_miss_a_version(spark, tmp_path):
    held, seen, stop = Snapshots(spark, f"file://{tmp_path}/t"), [], threading.Event()
    held.publish(spark.range(1))

    def read():
        own = Snapshots(spark, f"file://{tmp_path}/t")
        while not stop.is_set():
            seen.append(own.read().count())

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 8):
        held.publish(spark.range(n))
    stop.set()
    reader.join()
    assert seen and seen == sorted(seen) and set(seen) <= set(range(1, 8)) and held.read().count() == 7
    assert held.read(3).count() == 3


def test_of_two_writers_one_wins_and_old_data_goes(spark, tmp_path):
    held = Snapshots(spark, f"file://{tmp_path}/t")
    assert held.read() is None and held.latest() == 0
    record = {"data": held.write(spark.range(2)), "schema": spark.range(1).schema.json()}
    assert held.commit(record, 0) == 1
    with pytest.raises(Conflict):
        held.commit(record, 0)
    assert held.latest() == 1 and held.publish(spark.range(4)) == 2 and held.publish(spark.range(5)) == 3
    held.write(spark.range(9))
    assert held.vacuum(keep=1, idle_seconds=3600) == 0
    assert held.vacuum(keep=1, idle_seconds=-5) == 3 and held.read().count() == 5
    with pytest.raises(ValueError):
        held.read(2)


def test_windows_are_cut_by_characters(spark):
    texts = ["", "x", "añ😀 b" * 40, " " * 30, "ab" * 100 + " " * 25 + "c", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "source int, text string").withColumn("source", F.col("source").cast("string"))
    for size, overlap in ((10, 3), (10, 0), (10, 9), (25, 24)):
        want = []
        for k, t in enumerate(texts):
            starts = range(0, max(1, len(t or "") - overlap) if t else 0, size - overlap)
            kept = [(s, t[s : s + size]) for s in starts if t[s : s + size].strip()]
            want += [(str(k), n, w.strip(), s, min(s + size, len(t))) for n, (s, w) in enumerate(kept)]
        got = chunking.chunk(rows, size=size, overlap=overlap).collect()
        assert sorted((r.source, r.chunk_index, r.text, r.char_start, r.char_end) for r in got) == sorted(want)
