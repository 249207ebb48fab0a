"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bits of a sift, at most: 16 MB.
MOST_BITS = 1 << 27

_local_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set and all tasks run on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return "file://" + _local_scratch[0]


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/parlance/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether ``df`` has at most ``rows`` rows (BROADCAST_ROWS unless given). It must be cheap to count, such as a saved table."""
    most = BROADCAST_ROWS if rows is None else min(rows, BROADCAST_ROWS)
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is small, its rows being of a bounded width, else as it is, for a shuffle join."""
    return F.broadcast(df) if is_small(df, rows) else df


def bitmap(keys: DataFrame, key: str) -> Callable[[np.ndarray], np.ndarray]:
    """A test of arrays of hashes, for use in tasks, that is true for all keys and for few others.

    The keys' last bits set bits of a bitmap, 16 for each key and MOST_BITS at most, which is put together from its parts
    and sent to the tasks.
    """
    bits = 1 << 15
    n = keys.count()
    while bits < 16 * n and bits < MOST_BITS:
        bits *= 2
    at = keys.select(F.pmod(F.col(key), F.lit(bits)).alias("at"))
    parts = at.groupBy(F.expr("at div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("at % 32768")).alias("bits")).collect()
    held = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts:
        held[4096 * r.part : 4096 * (r.part + 1)] = np.frombuffer(r.bits, dtype=np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(held)

    def hit(hashes: np.ndarray) -> np.ndarray:
        place = hashes & (bits - 1)
        return shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1

    return hit


def sift(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test of long columns that is true for all keys and for few others, whatever the number of keys.

    Rows that can't match stay where they are, an exact join decides on the rest.
    """
    hashed = lambda x: F.xxhash64(x, F.lit(41))
    held = bitmap(keys.select(hashed(F.col(key)).alias("hash")), "hash")

    @F.pandas_udf("boolean")
    def hit(hashes: pd.Series) -> pd.Series:
        return pd.Series(held(hashes.to_numpy()))

    return lambda x: hit(hashed(x))


def matching(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, condition: Column, most: int | None = None) -> DataFrame:
    """Inner join of ``rows``, which may be wide, with ``wanted``: by broadcast if that is small, else only rows that pass a sift are shuffled."""
    if is_small(wanted, most):
        return rows.join(F.broadcast(wanted), condition)
    return rows.filter(sift(wanted, wanted_key)(F.col(key))).join(wanted, condition)


def without(rows: DataFrame, key: Column, gone: DataFrame, gone_key: str, condition: Column) -> DataFrame:
    """``rows`` that match none of ``gone``; only rows that pass a sift are ever shuffled."""
    if is_small(gone):
        return rows.join(F.broadcast(gone), condition, "left_anti")
    may = F.coalesce(sift(gone, gone_key)(key), F.lit(True))
    return rows.filter(~may).unionByName(rows.filter(may).join(gone, condition, "left_anti"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of sorted rows cut where a group ends, each with the bounds of its groups.

    For many small groups this spares the call for each one; the rows must be dealt and sorted by ``keys``.
    """
    rest: pd.DataFrame | None = None
    for batch in batches:
        if batch.empty:
            continue
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        starts = _starts(batch, keys)
        rest = batch.iloc[starts[-1] :].reset_index(drop=True)
        if len(starts) > 1:
            yield batch.iloc[: starts[-1]], starts
    if rest is not None:
        yield rest, np.array([0, len(rest)])


def _starts(batch: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(batch), dtype=bool)
    new[0] = True
    for k in keys:
        values = batch[k].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over the session's shuffle partitions by ``keys`` before heavy work on each row."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def unit(*cols: Column, seed: int = 0) -> Column:
    """A number in (0, 1) fixed by the columns' values, the same in any SQL engine that has md5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
