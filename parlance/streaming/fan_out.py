"""Finished conversations of a stream fanned out to several tables, each batch to all of them or to none."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from parlance.functions.snapshots import Snapshots
from parlance.plans import dataset


def sink(folder: str, run: str, *, columns: dict[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: a batch's rows go to a folder of its own in each table, then the batch is committed.

    ``run`` names the stream's checkpoint, whose batches are numbered from 0. A batch that is committed is not written
    again; one that isn't is written over what an earlier attempt has left.
    """
    at = folder.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        held = Snapshots(batch.sparkSession, at)
        last = held.latest()
        runs = (held.record(last) or {"runs": {}})["runs"]
        if number <= runs.get(run, -1):
            return
        copy = f"{at}/_batches/run={run}/batch={number}"
        made = dataset.with_messages(batch)
        made.write.mode("overwrite").option("parquet.block.size", dataset.COPY_BLOCK).parquet(copy)
        schemas = {}
        for name, rows in dataset.tables_of(batch.sparkSession.read.schema(made.schema).parquet(copy), columns=columns).items():
            rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{at}/{name}/run={run}/batch={number}")
            schemas[name] = rows.schema.json()
        held.commit({"runs": runs | {run: number}, "schemas": schemas}, last)

    return write


def fan_out(stream: DataFrame, folder: str, run: str, checkpoint: str, *, columns: dict[str, str] | None = None) -> DataStreamWriter:
    """A writer that fans the stream's finished conversations out to the tables of ``dataset.TABLES`` below ``folder``."""
    return stream.writeStream.foreachBatch(sink(folder, run, columns=columns)).option("checkpointLocation", checkpoint)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The rows of a table that committed batches have written; None before the first. Batches that are under way are not seen."""
    record = Snapshots(spark, folder).record()
    if record is None:
        return None
    schema = StructType.fromJson(json.loads(record["schemas"][name])).add("run", "string").add("batch", "integer")
    rows = spark.read.schema(schema).json(f"{folder.rstrip('/')}/{name}")
    seen = F.lit(False)
    for run, last in record["runs"].items():
        seen = seen | ((F.col("run") == run) & (F.col("batch") <= last))
    return rows.filter(seen).drop("run", "batch")
