"""Approximate search over vectors: a saved index of random-projection buckets, probed by margin, with exact scores of what is found."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.snapshots import Snapshots
from parlance.operators import topk

#: Vectors that a bucket should hold on average, and bits of a bucket's name at least and at most.
PER_BUCKET, LEAST_BITS, MOST_BITS = 256, 3, 12
#: Vectors of a cell at most, which is compared in one piece, and from which one is worth a task of its own. Queries of a block.
PART, LEAST_PART, MOST_QUERIES = 50_000, 2_000, 20_000
#: Vectors and queries of the sample on which probes are chosen, at most.
SAMPLE, SAMPLE_QUERIES = 20_000, 200
QUERIES_AT_ONCE = 2_000


@dataclass(frozen=True)
class Plan:
    """How vectors are dealt to buckets: so many tables of 2 ** bits buckets, planes fixed by the seed; probes in each table."""

    dims: int
    tables: int
    bits: int
    seed: int
    probes: int

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.tables, self.bits, self.dims))


def sides(plan: Plan, vectors: np.ndarray) -> np.ndarray:
    """Each vector's distance from each plane: vector, table, bit."""
    return np.einsum("nd,tbd->ntb", vectors, plan.planes())


def buckets(plan: Plan, vectors: np.ndarray) -> np.ndarray:
    """Each vector's bucket in each table."""
    return (sides(plan, vectors) > 0) @ (1 << np.arange(plan.bits))


def costs(plan: Plan, vectors: np.ndarray, table: int) -> np.ndarray:
    """What it costs a query to look into each bucket of a table: the squared distances to the planes that lie between."""
    side = sides(plan, vectors)[:, table]
    names = (np.arange(1 << plan.bits)[:, None] >> np.arange(plan.bits)) & 1
    squared = side**2
    return np.where(side > 0, squared, 0).sum(1)[:, None] + (np.where(side > 0, -squared, squared)) @ names.T


def usable(rows: DataFrame, v: str = "v") -> DataFrame:
    """Rows whose vector is there and finite; others take no part."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return rows.filter(F.col(v).isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)))


def chosen(vectors: DataFrame, *, k: int, recall: float, tables: int, seed: int) -> Plan:
    """A plan whose probes reach ``recall`` on a sample: SAMPLE vectors at most, of least hash, are held against each other.

    The sample has fewer near vectors than the whole, and what is farther off is harder to find, so the whole does no worse.
    """
    # Vectors of another length than most take no part.
    length = vectors.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    dims, n = (length.dims, length.n) if length else (1, 0)
    rows = vectors.filter(F.size("v") == dims).orderBy(F.xxhash64("id", F.lit(seed))).limit(SAMPLE).select("v").toPandas()
    held = np.stack(rows["v"].to_numpy()).astype(float) if len(rows) else np.zeros((0, dims))
    bits = int(np.clip(np.round(np.log2(max(1, n) / PER_BUCKET)), LEAST_BITS, MOST_BITS))
    plan = Plan(dims, tables, bits, seed, 1 << bits)
    asked = held[:SAMPLE_QUERIES]
    k = min(k, len(held) - 1)
    if k < 1:
        return plan
    score = asked @ held.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near, own = np.argpartition(-score, k - 1, axis=1)[:, :k], buckets(plan, held)
    rank = np.full(near.shape, 1 << bits)
    for t in range(tables):
        order = np.argsort(costs(plan, asked, t), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(1 << bits)[None], axis=1)
        rank = np.minimum(rank, np.take_along_axis(place, own[near, t], axis=1))
    probes = int(np.quantile(rank, min(1.0, recall), method="higher")) + 1
    return Plan(plan.dims, tables, bits, seed, probes)


def build(chunks: DataFrame, folder: str, *, k: int = 20, recall: float = 0.95, tables: int = 4, seed: int = 0) -> int:
    """Write the index of ``chunks`` (id, v) as a new version in ``folder``; the version.

    Each vector is written once for each table, under its bucket. ids must be distinct; null, ragged and non-finite
    vectors take no part. The probes are those that reach ``recall`` for the ``k`` nearest on a bounded sample; measure
    the recall on the whole where it matters.
    """
    spark = chunks.sparkSession
    held = Snapshots(spark, folder)
    vectors = usable(chunks.select("id", "v"))
    plan = chosen(vectors, k=k, recall=recall, tables=tables, seed=seed)
    kind = vectors.schema["id"].dataType.simpleString()

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["v"].map(len) == plan.dims]
            if len(batch):
                names = buckets(plan, np.stack(batch["v"].to_numpy()).astype(float))
                for t in range(plan.tables):
                    yield batch.assign(table=t, bucket=names[:, t])

    rows = vectors.mapInPandas(dealt, f"id {kind}, v array<float>, table int, bucket int")
    written = held.write(rows)
    stored = spark.read.schema(rows.schema).parquet(f"{folder.rstrip('/')}/data/{written}")
    # At most tables * 2 ** MOST_BITS rows, whatever the number of vectors.
    sizes = held.write(stored.groupBy("table", "bucket").agg(F.count("*").alias("n")).coalesce(1))
    return held.commit({"plan": asdict(plan), "data": written, "sizes": sizes, "id": kind}, held.latest())


def opened(spark: SparkSession, folder: str, version: int | None = None) -> tuple[Plan, DataFrame, DataFrame]:
    """The plan, vectors (id, v, table, bucket) and bucket sizes (table, bucket, n) of a version, by default the last."""
    record = Snapshots(spark, folder).record(version)
    if record is None:
        raise ValueError(f"no index in {folder}")
    at = f"{folder.rstrip('/')}/data"
    rows = spark.read.schema(f"id {record['id']}, v array<float>, table int, bucket int").parquet(f"{at}/{record['data']}")
    return Plan(**record["plan"]), rows, spark.read.schema("table int, bucket int, n long").parquet(f"{at}/{record['sizes']}")


def _probes(queries: DataFrame, plan: Plan, n: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[tuple[pd.DataFrame, int, np.ndarray]]]:
    """For batches of queries the queries of the plan's dimensions, each table, and the n cheapest buckets of each query in it."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, int, np.ndarray]]:
        for batch in batches:
            batch = batch[batch["q"].map(len) == plan.dims]
            for begin in range(0, len(batch), QUERIES_AT_ONCE):
                some = batch.iloc[begin : begin + QUERIES_AT_ONCE]
                vectors = np.stack(some["q"].to_numpy()).astype(float)
                for t in range(plan.tables):
                    cost = costs(plan, vectors, t)
                    yield some, t, np.argpartition(cost, n - 1, axis=1)[:, :n] if n < cost.shape[1] else np.tile(np.arange(n), (len(some), 1))

    return asked


def probed(queries: DataFrame, plan: Plan, probes: int | None = None) -> DataFrame:
    """The buckets that each query (query_id, q) looks into: query_id, q, table, bucket, the cheapest of each table."""
    kind = queries.schema["query_id"].dataType.simpleString()
    chosen_buckets = _probes(queries, plan, min(probes or plan.probes, 1 << plan.bits))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some, t, names in chosen_buckets(batches):
            yield pd.DataFrame({"query_id": some["query_id"].to_numpy(), "q": some["q"].to_numpy(), "table": t, "buckets": list(names)})

    found = usable(queries.select("query_id", "q"), "q").mapInPandas(asked, f"query_id {kind}, q array<float>, table int, buckets array<int>")
    return found.select("query_id", "q", "table", F.explode("buckets").alias("bucket"))


def candidates(queries: DataFrame, folder: str, *, probes: int | None = None) -> DataFrame:
    """How many vectors each query is compared with (query_id, compared), one that several tables find counted for each."""
    plan, _, sizes = opened(queries.sparkSession, folder)
    return probed(queries, plan, probes).drop("q").join(F.broadcast(sizes), ["table", "bucket"]).groupBy("query_id").agg(F.sum("n").alias("compared"))


class Cells:
    """Neighbouring buckets of a table packed into cells of PART vectors, or less if tasks lack; one larger bucket is dealt over parts.

    Held by arrays over table and bucket: there are at most tables * 2 ** MOST_BITS buckets, whatever the number of vectors.
    """

    def __init__(self, plan: Plan, sizes: list[tuple[int, int, int]], tasks: int):
        n = np.zeros((plan.tables, 1 << plan.bits), dtype=np.int64)
        for table, bucket, count in sizes:
            n[table, bucket] = count
        most = min(PART, max(LEAST_PART, -(-int(n[0].sum()) // tasks)))
        self.parts = np.maximum(1, -(-n // most))
        self.cell = np.zeros_like(n)
        for t in range(plan.tables):
            cell, filled = 0, 0
            for b, count in enumerate(n[t].tolist()):
                if filled and filled + count > most:
                    cell, filled = cell + 1, 0
                self.cell[t, b], filled = cell, filled + count

    def parts_of(self, table: int) -> list[int]:
        """The parts of each of a table's cells."""
        out = np.ones(int(self.cell[table].max()) + 1, dtype=np.int64)
        np.maximum.at(out, self.cell[table], self.parts[table])
        return out.tolist()


def nearest(queries: DataFrame, folder: str, k: int = 20, *, probes: int | None = None, digits: int | None = None, version: int | None = None) -> DataFrame:
    """The k vectors of largest inner product found for each query: query_id, rank, id, score; ties to the smaller id.

    Queries and vectors meet by cells of neighbouring buckets: a query goes to a cell once, with the buckets that it looks
    into there, and takes its best k away. So what moves grows with the queries, the cells and k, not with the buckets or
    the vectors found. Queries are dealt into blocks of about MOST_QUERIES; each reads the vectors once. If all buckets
    are looked into, one table holds all vectors and the others are left unread. Scores are exact inner products in double
    precision. More probes than the index was built for find more.
    """
    spark = queries.sparkSession
    plan, rows, sizes = opened(spark, folder, version)
    n = min(probes or plan.probes, 1 << plan.bits)
    every = n == 1 << plan.bits
    cells = Cells(plan, [tuple(r) for r in sizes.select("table", "bucket", "n").collect()], spark.sparkContext.defaultParallelism)
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", queries), ("id", rows))}
    asked = usable(queries.select("query_id", "q"), "q").withColumn("q", F.col("q").cast("array<float>"))
    blocks = max(1, -(-asked.count() // MOST_QUERIES))
    chosen_buckets = _probes(queries, plan, n)

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some, t, names in chosen_buckets(batches):
            parts = cells.parts_of(t)
            names = np.sort(names, axis=1)
            # Cells follow the buckets, so each query's buckets of a cell stand together.
            of = cells.cell[t][names]
            begins = np.diff(of, axis=1, prepend=-1) != 0
            query, at = np.nonzero(begins)
            end = np.append(np.where(query[1:] == query[:-1], at[1:], names.shape[1]), names.shape[1]) if len(query) else at
            out = {"query_id": some["query_id"].to_numpy()[query], "q": some["q"].to_numpy()[query], "table": t, "cell": of[query, at]}
            yield pd.DataFrame(out | {"buckets": [names[q, a:e] for q, a, e in zip(query.tolist(), at.tolist(), end.tolist())], "parts": [parts[c] for c in out["cell"].tolist()]})

    if every:
        # All cells of the first table.
        listed = F.explode(F.array(*(F.struct(F.lit(c).alias("cell"), F.lit(p).alias("parts")) for c, p in enumerate(cells.parts_of(0)))))
        asked = asked.filter(F.size("q") == plan.dims).select("query_id", "q", F.lit(0).alias("table"), listed.alias("at"), F.lit(None).cast("array<int>").alias("buckets"))
        asked = asked.select("query_id", "q", "table", "at.cell", "buckets", "at.parts")
        rows = rows.filter("table = 0")
    else:
        asked = asked.mapInPandas(sent, f"query_id {kinds['query_id']}, q array<float>, table int, cell int, buckets array<int>, parts int")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    told = spark.createDataFrame([(t, b, int(c), int(p)) for t in range(plan.tables) for b, (c, p) in enumerate(zip(cells.cell[t], cells.parts[t]))], "table int, bucket int, cell int, parts int")
    held = rows.join(F.broadcast(told), ["table", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")).drop("parts")
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held, sort_keys=[("id", "ascending")]))
        q, v = (topk.Vectors(x).rows(np.arange(len(x)), plan.dims) for x in (asked["q"], held["v"]))
        if every:
            qi, vi, score = topk.best(q, v, k, digits)
        else:
            qi, vi, score = looked_up(q, v, asked["buckets"], held["bucket"].to_numpy(), k, digits)
        return pa.table({"query_id": asked["query_id"].take(pa.array(qi)), "id": held["id"].take(pa.array(vi)), "score": pa.array(score)})

    keys = ["block", "table", "cell", "part"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    # What several tables find meets where its query is ranked.
    distinct = found.repartition("query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def looked_up(q: np.ndarray, v: np.ndarray, lists: pa.ChunkedArray, bucket: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best k among the vectors of the buckets on its list: places of query and vector and the score."""
    lists = lists.combine_chunks()
    asks = np.repeat(np.arange(len(q)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    wants = lists.flatten().to_numpy(zero_copy_only=False)
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    by_bucket, vectors = np.argsort(bucket, kind="stable"), np.sort(bucket, kind="stable")
    # Some queries at a time, as each takes k away from each bucket.
    for begin in range(0, len(q), QUERIES_AT_ONCE):
        lo, hi = np.searchsorted(asks, [begin, begin + QUERIES_AT_ONCE])
        order = lo + np.argsort(wants[lo:hi], kind="stable")
        names, first = np.unique(wants[order], return_index=True)
        some = []
        for b, x, y in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
            those, at = asks[order[x:y]], by_bucket[slice(*np.searchsorted(vectors, [b, b + 1]))]
            qi, vi, score = topk.best(q[those], v[at], k, digits)
            some.append((those[qi], at[vi], score))
        if some:
            found.append(topk.first_of_each(*(np.concatenate(x) for x in zip(*some)), k))
    return tuple(np.concatenate(x) for x in zip(*found))
