"""An index of a corpus' chunks that is kept up to date file by file: only what has changed is read and cut again."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parlance.functions.snapshots import Snapshots
from parlance.operators import chunking

#: Buckets that files are dealt to by their path. A refresh writes those anew that hold a file that has changed.
BUCKETS = 256


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: the version that holds now, files cut and removed, files whose chunks were kept, buckets written."""

    version: int
    cut: int
    removed: int
    kept: int
    written: int


def differences(manifest: DataFrame, before: DataFrame | None) -> DataFrame:
    """Files of either manifest (path, size, mtime) with ``state``: new, changed, gone or same. Paths must be distinct and not null."""
    now = manifest.select("path", F.col("size").cast("long"), F.col("mtime").cast("string"))
    if before is None:
        return now.withColumn("state", F.lit("new"))
    was = before.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("was"))
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(same, "same").otherwise("changed")
    return now.withColumn("is", F.lit(True)).join(was, "path", "full").select("path", "size", "mtime", state.alias("state"))


def bucket(path: str = "path") -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def refresh(spark: SparkSession, folder: str, manifest: DataFrame, load: Callable[[DataFrame], DataFrame], *, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> Refresh:
    """Bring the index in ``folder`` to the state of ``manifest`` (path, size, mtime).

    ``load`` gets the files (path) that are new or have changed and gives their rows (path, text, and columns that chunks
    keep), so no other file is read. Chunks of files that are as they were are carried over within their bucket, and
    buckets without a change stay where they are. Other sizes or other columns make everything new. The version is
    committed once all is written: a refresh that fails leaves the last one in place, and of two at a time one fails with
    a Conflict and can be repeated.
    """
    folder = folder.rstrip("/")
    held = Snapshots(spark, folder)
    last = held.latest()
    record = held.record(last)
    options = {"size": size, "overlap": overlap, "buckets": BUCKETS}
    empty = chunking.chunk(load(manifest.select("path").limit(0)), path="path", size=size, overlap=overlap).withColumn("bucket", bucket())
    schema = StructType([f for f in empty.schema if f.name != "bucket"])
    old = record if record and record["options"] == options and record["schema"] == schema.json() else None
    state = differences(manifest, spark.read.parquet(f"{folder}/data/{old['manifest']}") if old else None).withColumn("bucket", bucket())
    # The state is used several times; it has a row for each file, texts are not in it.
    listed = held.write(state)
    state = spark.read.schema(state.schema).parquet(f"{folder}/data/{listed}")
    counts = {r.state: r.n for r in state.groupBy("state").agg(F.count("*").alias("n")).collect()}
    touched = sorted(r.bucket for r in state.filter("state <> 'same'").select("bucket").distinct().collect())
    if old and not touched:
        return Refresh(last, 0, 0, counts.get("same", 0), 0)
    fresh = chunking.chunk(load(state.filter("state IN ('new', 'changed')").select("path")), path="path", size=size, overlap=overlap).withColumn("bucket", bucket())
    if old:
        stays = chunks_of(spark, folder, old, touched).withColumn("bucket", bucket())
        dropped = state.filter("state IN ('changed', 'gone')").select("path")
        fresh = fresh.unionByName(stays.join(dropped, "path", "left_anti"))
    written = held.write(fresh.repartition("bucket", F.pmod(F.xxhash64("path", F.lit(1)), F.lit(8))), by=("bucket",))
    buckets = dict(old["buckets"] if old else {})
    buckets.update((str(b), written) for b in touched)
    files = held.write(state.filter("state <> 'gone'").select("path", "size", "mtime"))
    version = held.commit({"options": options, "schema": schema.json(), "manifest": files, "buckets": buckets}, last)
    return Refresh(version, counts.get("new", 0) + counts.get("changed", 0), counts.get("gone", 0), counts.get("same", 0), len(touched))


def chunks_of(spark: SparkSession, folder: str, record: dict, buckets: list[int] | None = None) -> DataFrame:
    """The chunks that a version's record lists, of some buckets or of all."""
    schema = StructType.fromJson(json.loads(record["schema"]))
    wanted = [(b, name) for b, name in record["buckets"].items() if buckets is None or int(b) in buckets]
    held = Snapshots(spark, folder)
    paths = [p for p in (f"{folder}/data/{name}/bucket={b}" for b, name in wanted) if held.has(p)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def chunks(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """All chunks of a version of the index, by default the last; None if there is none."""
    record = Snapshots(spark, folder).record(version)
    return None if record is None else chunks_of(spark, folder.rstrip("/"), record)
