"""Cases in which an operator once did less than its whole job."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import decontamination, html_text, jaccard_join, passages


def invented(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}{rng.randrange(1000)}" for _ in range(n)]


@pytest.mark.parametrize("edited", [False, True])
def test_passage_of_frequent_lines_is_found(spark, edited):
    """The lines' least texts have one line each, or a line and most of the seam; only two texts have the passage."""
    one, two = invented(30, 1), invented(30, 2)
    shared = one + two
    other = list(shared)
    if edited:
        other[12] = other[48] = "edited"
    rows = [("B", invented(40, 3) + shared + invented(40, 4)), ("C", invented(25, 5) + other + invented(35, 6))]
    texts = [" ".join(x) for _, x in rows]
    hashes = [r.h for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(F.xxhash64("t").alias("h")).collect()]
    # Texts of either line alone, less in hash than both.
    cases = [(f"{name}{k}", " ".join(invented(20, 1000 * j + k) + line + invented(20, 5000 * j + k))) for j, (name, line) in enumerate((("A1", one), ("A2", two)), 10) for k in range(200)]
    listed = spark.createDataFrame(cases, "id string, text string").withColumn("h", F.xxhash64("text")).filter(F.col("h") < min(hashes)).collect()
    assert {r.id[:2] for r in listed} == {"A1", "A2"}
    docs = spark.createDataFrame([(n, t) for (n, _), t in zip(rows, texts)] + [(r.id, r.text) for r in listed], "doc_id string, text string")
    found = [r for r in passages.repeated(docs).collect() if r.doc_id in "BC"]
    starts = {"B": 40, "C": 25}
    for name in "BC":
        assert any(r.doc_id == name and r.start_word <= starts[name] and r.end_word >= starts[name] + 60 for r in found), found
    assert {r.kind for r in found} == {"repeat", "source"}


def test_units_and_names_at_sentence_starts_are_slots(spark):
    item = "Anna sold 12 kg of apples and Anna kept 3 apples for the winter"
    # Elsewhere the benchmark has a name at a sentence's start only, and a unit as a word.
    more = "We were here all day. Carla saw every kg of the apples that lay about the old barn"
    docs = [
        (1, item.replace("kg", "pounds")),
        (2, "It rained. " + item.replace("Anna", "Berta")),
        (3, more.replace("Carla", "Dora")),
        (4, item.replace("kg", "crates")),
        (5, item.replace("kg", "KG").replace("12", "7")),
    ]
    bench = spark.createDataFrame([(1, item), (2, more)], "item_id long, text string")
    found = {r.doc_id: (r.item_id, r.reparameterised, r.coverage) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert found[1] == (1, True, 1.0) and found[2] == (1, True, 1.0) and found[3] == (2, True, 1.0) and found[5] == (1, True, 1.0)
    assert found.get(4, (1, True, 0.0))[2] < 1


def test_hot_host_and_copies_keep_their_text(spark):
    """Without articles: phrases on a few of many pages and copies of a page stay, the menu and the notice go."""
    rng = random.Random(8)
    phrases = [" ".join(invented(4, 100 + k)) for k in range(30)]
    long = " ".join(invented(20, 99))
    notice = " ".join(invented(15, 98))
    rows, want = [], {}
    for k in range(60):
        text = f"{rng.choice(phrases)} {' '.join(invented(6, 300 + k))} {rng.choice(phrases)}"
        text = f"{text} {long}" if k < 3 else text
        rows.append((k, f"http://hot/{k}", f"<p>Home</p><p>{text}</p><p>{notice} {k}</p>"))
        want[k] = f"{text} {k}"
    # Two ids with one text, on a host of their own.
    copy = " ".join(invented(40, 7))
    rows += [(k, "http://copies/1", f"<p>{copy}</p>") for k in (100, 101)]
    want |= {100: copy, 101: copy}
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_owners_of_windows_are_counted():
    blocks = [["a", "b", "c"], ["a", "b", "c"], ["x", "a", "b", "c"], ["a", "b"]]
    found = html_text.windows_of(blocks, [0, 0, 1, 2], 3)
    assert found == {html_text.window_key(["a", "b", "c"]): 2, html_text.window_key(["x", "a", "b"]): 1, html_text.window_key(["a", "b"]): 1}


@pytest.mark.parametrize("threshold, recall", [(0.5, 0.999), (0.6, 0.999), (0.5, 0.9)])
def test_recall_out_of_reach_is_an_error(spark, threshold, recall):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    with pytest.raises(ValueError):
        jaccard_join.join(docs, threshold=threshold, recall=recall)


def test_usual_threshold_is_in_reach():
    assert jaccard_join.runs_needed(0.8) == 10 and jaccard_join.sift_loss(0.8) < 1e-6
