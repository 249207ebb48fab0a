"""Passages with edits, passages far longer than what is looked at first, and passages of any length against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from parlance.llm import passages

VOCABULARY = [f"w{k}" for k in range(5000)]
WEIGHTS = [1 / (k + 3) for k in range(5000)]


def prose(rng, n):
    return rng.choices(VOCABULARY, WEIGHTS, k=n)


@pytest.mark.parametrize("rate, least", [(0, 1.0), (5, 0.97), (10, 0.93), (15, 0.88)])
def test_edited_passages_are_found(spark, rate, least):
    """Of 60 words, with substitutions at a rate, as far as four fifths are left; both texts must show the place."""
    rng, docs, cases = random.Random(rate), [], []
    while len(cases) < 150:
        one = prose(rng, 60)
        two = [rng.choices(VOCABULARY, WEIGHTS)[0] if rng.random() * 100 < rate else w for w in one]
        if sum(a != b for a, b in zip(one, two)) > 12:
            continue
        before = rng.randint(20, 150), rng.randint(20, 150)
        cases.append((len(docs), before))
        docs += [(len(docs) + k, " ".join(prose(rng, n) + p + prose(rng, 80))) for k, (n, p) in enumerate(zip(before, (one, two)))]
    clean = [(len(docs) + k, " ".join(prose(rng, 300))) for k in range(300)]
    found = defaultdict(list)
    for r in passages.repeated(spark.createDataFrame(docs + clean, "doc_id long, text string").repartition(4)).collect():
        found[r.doc_id].append((r.start_word, r.end_word))
    hits = sum(all(any(min(e, at + 60) - max(s, at) >= 40 for s, e in found[doc + k]) for k, at in enumerate(before)) for doc, before in cases)
    assert hits >= least * len(cases), hits
    assert not [i for i, _ in clean if found[i]]


def test_long_passages_are_found_whole(spark):
    """Over lines that other texts have each, so that chains are short, far beyond the words looked at first."""
    rng = random.Random(1)
    shared = prose(rng, 6000)
    docs = [(0, " ".join(prose(rng, 100) + shared + prose(rng, 50))), (1, " ".join(shared + prose(rng, 70)))]
    docs += [(2 + k, " ".join(prose(rng, 30) + shared[at : at + 40] + prose(rng, 30))) for k, at in enumerate(range(0, 6000, 40))]
    rows = [r for r in passages.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.doc_id < 2]
    assert any(r.doc_id == 0 and r.start_word <= 101 and r.end_word >= 6099 for r in rows) and any(r.doc_id == 1 and r.start_word <= 1 and r.end_word >= 5999 for r in rows)


@pytest.mark.parametrize("length", [50, 53, 64])
def test_exact_passages_are_never_lost(spark, length):
    """Passages of least lengths, whose halves also stand in other texts each."""
    rng, docs = random.Random(length), []
    for _ in range(120):
        p = prose(rng, length)
        for part in (p, p, p[: length // 2], p[length // 2 :]):
            docs.append((len(docs), " ".join(prose(rng, rng.randint(0, 60)) + part + prose(rng, rng.randint(0, 60)))))
    found = {r.doc_id for r in passages.repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert {i for i, _ in docs if i % 4 < 2} <= found


def test_helpers_equal_plain_loops():
    """Seeds by windows, turns and common words against loops over the same values."""
    rng = random.Random(4)
    for _ in range(60):
        values = np.array([rng.randrange(1 + rng.randrange(200)) for _ in range(rng.randrange(300))], dtype=np.uint64)
        seeds = passages.grams(values, passages.SEED_WORDS).tolist()
        kept = {k for k, x in enumerate(seeds) if x % passages.SAMPLED == 0}
        for k in range(len(seeds) - passages.WINDOW + 1):
            some = seeds[k : k + passages.WINDOW]
            if all(x % passages.SAMPLED for x in some):
                kept.add(k + some.index(min(some)))
        if seeds and not kept:
            kept = {seeds.index(min(seeds))}
        assert set(passages.minimizers(values)[1].tolist()) == kept
        listed = values.tolist()
        assert passages.turns(values).tolist() == [listed[:k].count(x) for k, x in enumerate(listed)]
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(40))] for _ in range(2))
        rows = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[j]))
            rows.append(row)
        assert passages.common_words(a, b) == rows[-1][-1]
