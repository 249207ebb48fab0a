"""Services behind functions that tests replace: models, embedders, web search. Calls run in tasks, batch by batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DEFAULTS = {"title": "No title", "link": "No link", "snippet": "No snippet provided."}
RESULTS = "query string, results array<struct<title:string,link:string,snippet:string>>"


def web_search(queries: DataFrame, call: Callable[[str, int], list[dict]], *, num_results: int = 5) -> DataFrame:
    """Results of each query with blanks filled in; a call that fails has none. Adds the rendered lines."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query in batch["query"]:
                try:
                    found = call(query, num_results)[:num_results]
                except Exception:
                    found = []
                out.append((query, [{k: str(r.get(k) or v) for k, v in DEFAULTS.items()} for r in found]))
            yield pd.DataFrame(out, columns=["query", "results"])

    line = lambda r: F.concat(F.lit("["), r["title"], F.lit("]("), r["link"], F.lit(") "), r["snippet"])
    return queries.select("query").mapInPandas(search, RESULTS).withColumn("rendered", F.array_join(F.transform("results", line), "\n"))


def embed(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], *, text: str = "text") -> DataFrame:
    """Adds ``v``, unit vectors. ``load`` runs once in each task and returns a function of a batch of texts."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            vectors = np.asarray(model([t or "" for t in batch]), dtype=np.float32)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list(vectors / np.where(norms > 0, norms, 1)))

    return texts.withColumn("v", encode(F.col(text)))


def hashing_embedder(dims: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A stand-in without a model: words hashed to signed places."""

    def load():
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims), dtype=np.float32)
            for k, text in enumerate(texts):
                for word in text.lower().split():
                    h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                    out[k, h % dims] += 1 if h >> 63 else -1
            return out

        return encode

    return load


def complete(rows: DataFrame, call: Callable[[dict], str], parse: Callable[[str], dict | None], *, repairs: int = 1) -> DataFrame:
    """Adds ``reply``, the JSON text of a model's answer to each row, and ``attempts``; asked again while it doesn't parse.

    ``call`` gets the row as a mapping with ``repair`` set to the broken answer on a retry. An answer that never
    parses gives a null reply.
    """
    schema = StructType([*rows.schema.fields]).add("reply", "string").add("attempts", "integer")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, attempts = [], []
            for row in batch.to_dict("records"):
                reply, raw = None, None
                for n in range(1 + repairs):
                    raw = call(row | {"repair": raw})
                    if parse(raw) is not None:
                        reply = raw
                        break
                replies.append(reply)
                attempts.append(n + 1)
            yield batch.assign(reply=replies, attempts=attempts)

    return rows.mapInPandas(ask, schema)
