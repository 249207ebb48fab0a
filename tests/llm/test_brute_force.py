"""Operators that SQL doesn't express, held against brute force or held-out labels on small tables."""

import html
import importlib
import os
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import passages, queries, sharding, toxicity, url_filter

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def words(text):
    return re.findall(r"\w+", (text or "").lower())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_main_text_is_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op1_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1|br)[^>]*>", re.sub(r"</?b>", "", inner))
        assert r.text == " ".join(b for b in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in blocks) if b) and r.n_chars == len(r.text)


def test_join_finds_every_link(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    linked = defaultdict(set)
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 5 * len(a & b) >= 4 * len(a | b):
                linked[i].add(j)
                linked[j].add(i)
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        root, before = {i: min([root[i], *(root[j] for j in linked[i])]) for i in sets}, root
        if root == before:
            break
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op4_jaccard_join(spark, SF).collect()}
    assert got == {i: (root[i], len(linked[i])) for i in sets}


def test_shards_are_even(spark):
    rows = queries.op5_sharding(spark, SF).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert len(rows) == 40 and all(r.m + 1 == r.n for r in rows)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one hot text").otherwise(F.repeat(F.lit("ab "), (F.col("id") % 97).cast("int"))).alias("text"))
    sizes = [r.b for r in sharding.shard(docs, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.03 * min(sizes)
    assert np.bincount(sharding.pack(np.full((80, 3), 0.1), 8)).tolist() == [10] * 8


def test_nearest_reach_the_wanted_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = defaultdict(list)
    for r in queries.op7_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = x @ x[k]
        score[k] = -np.inf
        want = ids[np.lexsort((ids, -score))[:20]]
        hits, total = hits + len(set(want) & set(got[ids[k]])), total + 20
    assert hits >= 0.9 * total


def test_leaks_are_found(spark, texts):
    items = {r.item_id: " ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for k, item in items.items() if f" {item} " in f" {' '.join(words(t))} "}
    assert {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, SF).collect()} == want


def test_reparameterised_questions_are_found(spark):
    from parlance.llm.decontamination import contaminated

    item = "Yesterday the farmer called Anna sold 12 kg of apples and Anna kept 3 apples for the long winter in the cold barn"
    docs = [
        (1, item.replace("Anna", "Berta").replace("12", "40").replace("3 ", "7 ")),
        (2, item.replace("called Anna", "called Berta").replace("12", "40")),
        (3, "some other text on a farmer who sold apples in the cold barn"),
        (4, "x " + item.upper() + " y"),
    ]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    got = {r.doc_id: (r.reparameterised, r.coverage) for r in found.collect()}
    assert got[1] == (True, 1.0) and got[4][0] is False and 3 not in got and got.get(2, (True, 0))[1] < 1


@pytest.mark.parametrize("name, label", [("op3_toxicity", "toxic"), ("op9_quality_classifier", "quality")])
def test_held_out_accuracy(spark, name, label):
    sf = SF.replace("sf0.001", "sf0.01")
    rows = queries.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r[label] for r in rows) >= 0.9 * len(rows)


def test_folded_hits_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, frozenset({"not idiot"}), -2.0, (2.0, 1.0))
    base = lexicon.score("a calm text")
    assert lexicon.score("what an 1d1от he is") > base and lexicon.score("he is not idiot") == base == lexicon.score(None) and lexicon.score("videoidiots") == base
    assert lexicon.score("idiot") > lexicon.score("idiot " + "word " * 500)


def test_repeated_windows_are_covered(spark, texts):
    found = defaultdict(list)
    for r in queries.op10_substring_dedup(spark, SF).collect():
        found[r.doc_id].append((r.start_word, r.end_word))
    first, want = {}, defaultdict(set)
    for i, t in sorted(texts.items()):
        w = words(t)
        for j in range(len(w) - 49):
            if len(set(w[j : j + 50])) < 10:
                continue
            other = first.setdefault(tuple(w[j : j + 50]), (i, j))
            if other[0] != i:
                want[i].add(j)
                want[other[0]].add(other[1])
    assert want
    for i, places in want.items():
        for j in places:
            assert any(s <= j + 2 and j + 48 <= e for s, e in found[i])


def test_chains_rise_in_both_texts():
    pos, other = np.array([0, 10, 20, 30, 500, 15]), np.array([5, 16, 24, 35, 900, 2])
    best = passages.chains(pos, other)[0]
    assert [(int(pos[k]), int(other[k])) for k in best] == [(0, 5), (10, 16), (20, 24), (30, 35)]


def test_alignment_spans_an_edited_passage():
    a, b = list(range(100)), list(range(1000, 1010)) + list(range(20, 80))
    b[40] = 7777
    s, e, os_, oe, matched = passages.align(a, b, [25, 70], [15, 60])
    assert (s, e, os_, oe, matched) == (20, 80, 10, 70, 59)


def test_cascade_is_exact(spark):
    listed = spark.range(0, 3000, 3).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filter.Cascade(listed, universe)
    assert len(cascade.levels) > 1
    assert {r.key for r in universe.filter(cascade.has(F.col("key"))).collect()} == {r.key for r in listed.collect()}


def test_pipeline_against_plain_rules(spark, texts):
    """Each stage on its own input: rejected, copied and contaminated documents go, the mix keeps its bounds, shards hold all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = pipeline.keep_good(spark, docs, SF)
    scores = {r.doc_id: r.predicted for r in queries.op9_quality(spark, SF).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p}
    one = pipeline.keep_distinct(spark, docs, SF)
    classes = {r.doc_id: r.class_id for r in queries.op4_jaccard_join(spark, SF).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(classes.values()))
    clean = pipeline.keep_clean(spark, docs, SF)
    leaks = {r.doc_id for r in queries.op8_decontamination(spark, SF).collect()}
    assert {r.doc_id for r in clean.collect()} == set(texts) - leaks
    mix = pipeline.mix_sources(spark, docs, SF)
    taken = {r.doc_id: (r.taken // r.size if r.size else 0, r.size) for r in queries.op6_mixing(spark, SF).collect()}
    counts = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert all(counts.get(i, 0) == n for i, (n, size) in taken.items() if size)
    assert pipeline.deal_shards(spark, docs, SF).count() == len(texts)


def test_entry_registers_all():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if re.match(r"op\d+_", x)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_sql_of_native_operators(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        cursor = con.execute(sql)
        cols = [c[0] for c in cursor.description]
        plain = lambda v: round(v, 6) if isinstance(v, float) else v
        want = sorted((tuple(plain(v) for v in r) for r in cursor.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in cols) for r in queries.queries()[name](spark, SF).collect()), key=repr) == want
