"""Web search as a data source: what is asked, how often, and what a stream has read."""

import json
import os
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from parlance.sources import search_source

#: A service that notes each call in a folder; tasks import it by name.
SERVICE = """
import os, uuid
def search(query, n):
    open(os.path.join({folder!r}, f"{{query}}~{{n}}~{{uuid.uuid4().hex}}"), "w").close()
    if query == "bad":
        raise ValueError("no")
    return [{{"title": f"{{query}} {{k}}", "snippet": None}} for k in range(9)]
"""


@pytest.fixture
def service(spark, tmp_path):
    noted = tmp_path / "noted"
    noted.mkdir()
    name = f"service_{uuid.uuid4().hex}"
    path = tmp_path / f"{name}.py"
    path.write_text(SERVICE.format(folder=str(noted)))
    spark.sparkContext.addPyFile(str(path))
    sys.path.insert(0, str(tmp_path))
    search_source.register(spark)
    yield f"{name}:search", lambda: sorted(tuple(x.split("~")[:2]) for x in os.listdir(noted))
    sys.path.remove(str(tmp_path))


def test_given_queries_and_pushed_filters(spark, service):
    named, calls = service
    read = lambda: spark.read.format("web_search").option("search", named).option("queries", json.dumps(["a", "b", "bad", "c"])).option("num_results", "3").load()
    rows = read().collect()
    assert {(r.query, r["rank"]) for r in rows} == {(q, k) for q in "abc" for k in (1, 2, 3)}
    assert all(r.title == f"{r.query} {r['rank'] - 1}" and r.link == "No link" and r.snippet == "No snippet provided." for r in rows)
    assert calls() == [("a", "3"), ("b", "3"), ("bad", "3"), ("c", "3")]
    assert read().filter((F.col("query") == "b") & (F.col("rank") < 3)).count() == 2
    assert calls().count(("b", "2")) == 1 and len(calls()) == 5
    assert read().filter(F.col("query").isin("a", "c") & (F.col("rank") <= 1) & F.col("title").startswith("a")).count() == 1
    assert sorted(calls())[:2] == [("a", "1"), ("a", "3")] and len(calls()) == 7


def test_a_stream_asks_each_file_once(spark, service, tmp_path):
    named, calls = service
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for k, queries in enumerate((["a", "b"], ["c", None, ""])):
        part = f"{tmp_path}/part{k}"
        spark.createDataFrame([(q,) for q in queries], "query string").coalesce(1).write.parquet(f"file://{part}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        (file,) = [x for x in os.listdir(part) if x.endswith(".parquet")]
        os.rename(f"{part}/{file}", f"{tmp_path}/in/{k:05d}.parquet")
        stream = spark.readStream.format("web_search").option("search", named).option("path", folder).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert calls() == [("a", "5"), ("b", "5"), ("c", "5")] and spark.read.parquet(out).count() == 15


def test_options_are_needed(spark, service):
    with pytest.raises(Exception, match="search"):
        spark.read.format("web_search").load().collect()
