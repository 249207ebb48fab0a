"""Upper case letter by letter, as the SQL of the chunk index has it."""

import duckdb
from pyspark.sql import functions as F

from parlance.functions.text import simple_upper


def test_upper_case_keeps_places(spark):
    """A letter whose upper case is several characters moves no other; null and empty texts stay."""
    texts = ["plain é", "Straße naß\n😀x", "ŉǰΐ", "ᾀᾈᾳᾷ", "ﬁﬀ ﬅ", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.u for r in rows.select("k", simple_upper(F.col("t")).alias("u")).orderBy("k").collect()]
    assert got == [duckdb.execute("SELECT upper(?::VARCHAR)", [t]).fetchone()[0] for t in texts]
