"""Repeated questions of a source are found in one reading of the texts."""

import re

from pyspark.sql import functions as F

from parlance.operators import dedup


def test_repeats_in_source(spark):
    """Equal orders don't make each other repeats; blanks, null texts and unknown sources never are."""
    rows = [(1, "a", "Q x"), (2, "a", " q  X"), (2, "a", "q x"), (3, "b", "q x"), (4, None, "q x"), (5, "", "q x"), (6, None, "q x"), (7, "a", " "), (8, "a", ""), (9, "a", None), (10, "a", None), (11, "b", "y"), (11, "b", "y")]
    table = spark.createDataFrame(rows, "doc_id long, source_path string, question string")
    assert sorted(r.doc_id for r in dedup.repeats_in_source(table, order="doc_id").collect()) == [2, 2]
    asked = table.select(F.col("doc_id").alias("id"), "source_path", "question")
    assert sorted(r.id for r in dedup.in_source_duplicates(asked, table).collect()) == [1, 2, 2, 3, 11, 11]


def test_query_makes_one_normal_form(spark):
    from parlance.plans import catalog

    plan = catalog.QUERIES["in_source_duplicates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("lower\\(", plan)) == 1
