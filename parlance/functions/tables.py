"""Tables that are written and read again, and numbering of rows without one task for all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; below one of our own if none is set and all tasks run here."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        shared = "file://" + _own[0]
    return f"{shared.rstrip('/')}/parlance/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: what made it, a model call perhaps, runs once."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows a side may have to be broadcast; beyond it a join shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df``, whose rows must be narrow and cheap to count, marked for broadcast if it has BROADCAST_ROWS at most, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def numbered(df: DataFrame, bucket: Column, *order: str, name: str = "place") -> DataFrame:
    """Rows with their number from 0 in the order of ``bucket`` and then of ``order``.

    Rows are numbered within their bucket; a table of the buckets' sizes, which must be few, gives where each begins.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy().orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(starts, "_bucket").withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before")
