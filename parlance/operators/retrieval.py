"""Exact top-k retrieval over vectors, filters on what it finds, reranking, rendering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parlance.functions.tables import small
from parlance.functions.text import strip
from parlance.operators import topk, vector_index

TOP_K, CANDIDATES = 4, 12
#: Queries and chunks of a block, at most, and chunks from which a block is worth a task of its own.
MOST_QUERIES, PART, LEAST_PART = 20_000, 50_000, 2_000
EMPTY = "No relevant passages found in the knowledge base."


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, *, digits: int | None = None) -> DataFrame:
    """The k chunks of largest inner product with each query: query_id, rank, id, score and the chunks' other columns.

    ``queries`` has query_id and q, ``chunks`` id and v. Both are dealt into blocks, at most about MOST_QUERIES and PART,
    and every block of queries meets every block of chunks in a task, by a matrix product whose best are scored exactly.
    So a chunk moves once for each block of queries, a query once for each of chunks, and k rows a query and block move on.
    The work is the product of both tables, memory that of two blocks.
    """
    n, cores = chunks.count(), queries.sparkSession.sparkContext.defaultParallelism
    blocks, parts = max(1, -(-queries.count() // MOST_QUERIES)), max(1, -(-n // PART), min(cores, -(-n // LEAST_PART)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
    asked = queries.select("query_id", "q", of("query_id", blocks).alias("_block"), every(parts).alias("_part"))
    held = chunks.withColumn("_part", of("id", parts)).withColumn("_block", every(blocks))
    columns = [c for c in chunks.columns if c != "v"]
    schema = StructType([*(chunks.schema[c] for c in columns), queries.schema["query_id"]]).add("score", "double")
    best = lambda a, h: topk.best_rows(a, h, k, digits, columns)
    found = asked.groupBy("_block", "_part").cogroup(held.groupBy("_block", "_part")).applyInArrow(best, schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_by_index(queries: DataFrame, chunks: DataFrame, index: str, k: int = TOP_K) -> DataFrame:
    """As ``nearest``, but only with chunks that the saved index in the folder ``index`` finds: few of those farther off are compared at all.

    ``vector_index.build`` writes the index of chunks' id and v. Columns of chunks are fetched for what is found only.
    """
    found = vector_index.nearest(queries, index, k)
    return found.join(chunks.drop("v"), "id")


def exclude_ids(results: DataFrame, used: DataFrame) -> DataFrame:
    """Results whose id is not among the used ones."""
    return results.join(used.select("id").distinct(), "id", "left_anti")


def prefer_sources(results: DataFrame, preferred: DataFrame, *, allow_fallback: bool = True, source: str = "source") -> DataFrame:
    """Results of preferred sources; all results of a query that has none of them, if fallback is allowed.

    An empty preference is no filter.
    """
    marks = preferred.select(source).distinct().withColumn("is_preferred", F.lit(True))
    marked = results.join(small(marks), source, "left")
    any_hit = F.max(F.coalesce("is_preferred", F.lit(False))).over(W.partitionBy("query_id"))
    marked = marked.withColumn("any_hit", any_hit)
    if not marks.limit(1).count():
        return results
    keep = F.coalesce("is_preferred", F.lit(False)) | (~F.col("any_hit") & F.lit(allow_fallback))
    return marked.filter(keep).drop("is_preferred", "any_hit")


def effective_preference(sources: DataFrame, preferred: DataFrame, avoid: DataFrame) -> DataFrame:
    """Preferred sources less the avoided ones; if none is left, all sources less the avoided ones."""
    left = preferred.select("source").distinct().join(avoid.select("source"), "source", "left_anti")
    other = sources.select("source").distinct().join(avoid.select("source"), "source", "left_anti")
    return left if left.limit(1).count() else other


def rerank(results: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series] | None, k: int = TOP_K) -> DataFrame:
    """Each query's best k by a scorer of (query, text), ties in the order they had; without a scorer the first k.

    The scorer gets batches in tasks; an exception in it leaves a batch in its order, as if unscored.
    """
    if score is None:
        return results.filter(F.col("rank") <= k)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = score(batch["query"], batch["text"]).astype(float)
            except Exception:
                found = -batch["rank"].astype(float)
            yield batch.assign(rerank_score=found)

    schema = StructType([*results.schema.fields]).add("rerank_score", "double")
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    ranked = results.mapInPandas(scored, schema).withColumn("new_rank", F.row_number().over(order))
    return ranked.filter(F.col("new_rank") <= k).drop("rank").withColumnRenamed("new_rank", "rank")


def search(
    queries: DataFrame,
    chunks: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    *,
    k: int | None = None,
    default_k: int = TOP_K,
    score: Callable[[pd.Series, pd.Series], pd.Series] | None = None,
    index: str | None = None,
) -> DataFrame:
    """The passages of texts that are asked: ``queries`` has query_id and query, ``chunks`` id, v, text and source.

    ``embed`` adds ``v`` to a table with query. Queries are stripped, blank ones find nothing; k that is no positive
    number is the default; with a scorer more candidates are found and reranked. With ``index``, the folder of a saved
    index of these chunks, the search is approximate.
    """
    wanted = k if isinstance(k, int) and k > 0 else default_k
    asked = queries.withColumn("query", strip(F.col("query"))).filter("query <> ''")
    asked_v = embed(asked)
    queries_v, n = asked_v.select("query_id", F.col("v").alias("q")), max(wanted, CANDIDATES) if score else wanted
    found = nearest_by_index(queries_v, chunks, index, n) if index else nearest(queries_v, chunks, n)
    if score:
        found = rerank(found.join(asked.select("query_id", "query"), "query_id"), score, wanted)
    return found.withColumn("text", strip(F.col("text")))


def render(results: DataFrame) -> DataFrame:
    """Each query's passages as lines of source and content in order of rank, or a sentence that there are none."""
    line = F.concat(F.lit("["), "source", F.lit("] "), strip(F.col("text")))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    joined = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return results.groupBy("query_id").agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit(EMPTY)).alias("rendered"))


def sample(chunks: DataFrame, n: int, *, seed: int = 0, sources: DataFrame | None = None) -> DataFrame:
    """``n`` chunks without replacement, of given sources or of all: those of least MD5 of seed and id."""
    if sources is not None:
        chunks = chunks.join(small(sources.select("source").distinct()), "source", "left_semi")
    return chunks.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(n)
