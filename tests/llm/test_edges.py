"""Odd rows through every operator: nulls, empty and long texts, repeats, empty tables, columns with clashing names."""

import os
import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import decontamination, html_text, jaccard_join, mixing, nearest, passages, quality, sharding, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("id", "size", "u", "t", "text_key", "row", "shard", "slot", "name", "run", "leaf", "host", "path", "page", "v", "words", "grp", "rank", "target", "copies")


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    base = prose(80, 1)
    return [
        (1, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (2, base, "en", "b", 1),
        (3, base.replace(base.split()[40], "zzz"), None, "b", 1),
        (4, "", "en", "a", 0),
        (5, None, "en", None, None),
        (None, base, "en", None, 1),
        (None, None, None, None, None),
        (6, "one", "en", "a", 3),
        (7, prose(30_000, 2), "de", "a", 1),
        (8, "   \n\t", "en", "a", 5),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


def test_sharding(docs, none):
    rows = sharding.shard(docs, 3).collect()
    assert len(rows) == 11
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.size for r in rows if r.doc_id in (4, 5)} == {16} and sharding.shard(none, 3).count() == 0
    assert sharding.shard(docs, 3).columns == sharding.shard(none, 3).columns


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 11 and all(0 <= r.taken <= 2 * r.size for r in rows)
    total, by = sum(r.size for r in rows), {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * total) < 1e-6
    assert by[None][0].size in (0, 80) and {r.taken for r in rows if r.doc_id == 1} != set()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(1)).collect()))
    assert mixing.mix(none).count() == 0
    whole = mixing.mixed_rows(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in rows) and mixing.mixed_rows(none).count() == 0


def test_jaccard_join(docs, none):
    rows = jaccard_join.join(docs).collect()
    got = {(r.doc_id, r.class_id, r.n_links) for r in rows}
    assert len(rows) == 11
    assert {(1, 1, 4), (2, 1, 4), (3, 1, 4)} <= got and (None, 1, 4) in got
    assert {(4, 4, 0), (5, 5, 0), (8, 8, 0), (6, 6, 0), (7, 7, 0), (None, None, 0)} <= got
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [(False, i) for i in (1, 4, 5, 6, 7, 8)]
    assert kept.filter("doc_id is null").count() == 1
    assert jaccard_join.join(none).count() == 0 and jaccard_join.one_of_each(none).count() == 0


def test_passages(docs, none):
    rows = passages.repeated(docs).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, None} and all(r.n_words >= 50 for r in rows)
    assert passages.repeated(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, prose(80, 1)), (2, None), (3, ""), (4, "one"), (1, prose(80, 1))], "item_id long, text string")
    found = decontamination.contaminated(docs, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (None, 1)}
    assert decontamination.contaminated(none, items).count() == 0 and decontamination.contaminated(docs, items.filter("false")).count() == 0


def test_scores(docs, none, labels):
    lexicon, model = toxicity.fit(docs, labels, F.lit(True)), quality.fit(docs, labels, F.lit(True))
    for scored in (toxicity.score(docs, lexicon), quality.score(docs, model)):
        rows = scored.collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and len({r.score for r in rows if r.doc_id in (4, 5)}) == 1
    assert toxicity.score(none, lexicon).count() == 0 and quality.score(none, model).count() == 0
    nothing = labels.filter("false")
    assert quality.score(docs, quality.fit(none, nothing, F.lit(True))).count() == 11
    assert toxicity.score(docs, toxicity.fit(docs, nothing, F.lit(True))).count() == 11


def test_nearest(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [None, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "block": F.lit(1), "v": F.lit(1)})
    got = nearest.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 0, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 3, 0.0)]
    assert nearest.nearest(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_urls(spark):
    rows = [(1, "HTTP://A.Com:80/x?y"), (2, None), (3, "no scheme"), (4, "://"), (5, "http://com/en/"), (6, "http://xcom/en/"), (6, "http://xcom/en/"), (7, "a://b://c/d"), (8, "http://É.COM/en/1#x")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("h"), "key": F.lit("k")})
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, [("block", "com", "/en/")], keep=("page_id",)).collect()}
    assert got == {
        (1, "a.com:80", "/x", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "com", "/en/", "com/en/", "block"),
        (6, "xcom", "/en/", None, "allow"), (7, "b:", "//c/d", None, "allow"), (8, "É.com", "/en/1", "com/en/", "block"),
    }
    assert url_filter.judge_urls(df.filter("false"), [("block", "com", "/en/")]).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, []).collect()} == {"allow"}


def test_pages(spark):
    rows = [
        (1, "http://h/1", "<p>menu one two three four</p><p>alpha beta gamma delta epsilon</p>"),
        (2, "http://h/2", "<p>menu one two three four</p><p>zeta &amp; eta theta\n iota kappa</p>"),
        (3, "http://h/3", "<nav>menu one two three four</nav><article><h1>T</h1>menu one two three four</article>x"),
        (4, None, "<p>menu one two three four"), (5, "http://h/5", None), (6, "http://h/6", ""), (7, "http://h/7", "<scr<b>a</b><!-- cut"), (None, "http://h/1", "<p>menu one two three four</p>"),
    ]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").withColumns({"host": F.lit("x"), "page": F.lit(1), "id": F.lit(2)})
    got = {(r.page_id, r.text) for r in html_text.extract(df).collect()}
    assert {(1, "alpha beta gamma delta epsilon"), (2, "zeta & eta theta iota kappa"), (3, "T menu one two three four"), (4, "menu one two three four"), (5, ""), (6, ""), (None, "")} <= got
    assert html_text.extract(df).count() == 9 and html_text.extract(df.filter("false")).count() == 0


def test_pipeline(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    plain = docs.drop(*CLASH)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing that is in any of them at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (plain, plain.filter("false")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.dtypes == plain.dtypes
            path = f"{tmp_path}/{os.urandom(4).hex()}"
            out.write.parquet(path)
            df = spark.read.schema(out.schema).parquet(path)
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
