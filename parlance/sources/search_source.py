"""Web search as a Spark data source: ``spark.read.format("web_search")``, a row for each result, calls where the rows are made."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from parlance.sources.adapters import DEFAULTS

NAME, SCHEMA = "web_search", "query string, rank int, title string, link string, snippet string"
NUM_RESULTS, PARTITIONS = 5, 8


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters be pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WebSearch)


def client(named: str) -> Callable[[str, int], list[dict]]:
    """The search function that ``module:function`` names; it must be importable where tasks run."""
    module, _, function = named.partition(":")
    return getattr(importlib.import_module(module), function)


def results(call: Callable[[str, int], list[dict]], queries: Iterable[str], n: int) -> Iterator[tuple]:
    """A row for each result, blanks filled in; a call that fails has none."""
    for query in queries:
        try:
            found = call(query, n)[:n] if n > 0 else []
        except Exception:
            found = []
        for rank, r in enumerate(found, 1):
            yield (query, rank, *(str(r.get(k) or v) for k, v in DEFAULTS.items()))


class Some(InputPartition):
    """Queries that are given, or a Parquet file that holds them in its column ``query``."""

    def __init__(self, queries: list[str] | None = None, file: str | None = None) -> None:
        super().__init__(None)
        self.queries, self.file = queries, file


class Asked:
    """What reading by batch and by stream share: the options, the files, the calls."""

    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("search"):
            raise ValueError("the option search must name a function, as module:function")
        self.search, self.n = options["search"], int(options.get("num_results", NUM_RESULTS))
        self.path, self.given = options.get("path"), json.loads(options.get("queries", "[]"))
        self.parts = int(options.get("partitions", PARTITIONS))
        self.wanted: set[str] | None = None

    def files(self) -> list[str]:
        store, root = fs.FileSystem.from_uri(self.path)
        return sorted(i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".parquet"))

    def rows(self, part: Some) -> Iterator[tuple]:
        queries = part.queries
        if part.file is not None:
            store, _ = fs.FileSystem.from_uri(self.path)
            queries = (q for batch in pq.ParquetFile(part.file, filesystem=store).iter_batches(columns=["query"]) for q in batch.column(0).to_pylist() if q)
        chosen = queries if self.wanted is None else (q for q in queries if q in self.wanted)
        return results(client(self.search), chosen, self.n)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.asked = Asked(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """A filter on the query leaves calls out, one on the rank asks for fewer results; others stay with Spark."""
        for f in filters:
            match f:
                case EqualTo(("query",), str(value)):
                    self._only({value})
                case In(("query",), values):
                    self._only(set(values))
                case LessThan(("rank",), int(most)):
                    self.asked.n = min(self.asked.n, most - 1)
                case LessThanOrEqual(("rank",), int(most)):
                    self.asked.n = min(self.asked.n, most)
                case _:
                    yield f

    def _only(self, queries: set[str]) -> None:
        self.asked.wanted = queries if self.asked.wanted is None else self.asked.wanted & queries

    def partitions(self) -> list[Some]:
        """A part for each file of queries, and as many as asked for of those that are given."""
        if self.asked.path:
            return [Some(file=f) for f in self.asked.files()] or [Some([])]
        given = [q for q in self.asked.given if self.asked.wanted is None or q in self.asked.wanted]
        n = max(1, min(self.asked.parts, len(given)))
        return [Some(given[k::n]) for k in range(n)]

    def read(self, partition: Some) -> Iterator[tuple]:
        return self.asked.rows(partition)


class StreamReader(DataSourceStreamReader):
    """Files of queries as they come: names must grow, the offset is the last name that was read."""

    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("a stream reads the queries from the folder in the option path")
        self.asked = Asked(options)

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self.asked.files(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Some]:
        return [Some(file=f) for f in self.asked.files() if start["after"] < f <= end["after"]]

    def read(self, partition: Some) -> Iterator[tuple]:
        return self.asked.rows(partition)


class WebSearch(DataSource):
    """Options: ``search`` (module:function of query and number), ``queries`` (a JSON list) or ``path`` (a folder of Parquet files), ``num_results``, ``partitions``.

    Each query is asked where its part is read, once a read; write the rows before they are used twice. Queries that are
    null or blank in files are passed over. A stream reads each file of ``path`` once.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(dict(self.options))
