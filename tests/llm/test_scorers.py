"""Scorers and packing held against plain loops."""

import itertools
import math
import os
import random

import numpy as np
import pytest

from parlance.llm import quality, sharding, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] if os.path.isdir(SF) else ["a few words"]


def plain_hits(lexicon, text):
    """At each beginning of a word after the last hit's word the shortest entry that stands there, with the phrases around."""
    out, end = [], 0
    for start in range(len(text)):
        if start < end or start and text[start - 1].isalnum():
            continue
        entry = min((e for e in lexicon.entries if text.startswith(e, start)), key=len, default=None)
        if entry is None:
            continue
        end = start
        while end < len(text) and text[end].isalnum():
            end += 1
        word = text[start:end]
        phrases = []
        for near, at in ((text[max(0, start - 40) : start].split()[-1:], -1), (text[end : end + 40].split()[:1], 0)):
            found = toxicity.WORD.findall(near[0]) if near else []
            phrases.append([found[at]] if found else [])
        out.append((lexicon.entries[entry], " ".join([*phrases[0], word]), " ".join([word, *phrases[1]])))
    return out


def test_automaton_finds_what_a_scan_finds(texts):
    rng = random.Random(1)
    folded = [toxicity.fold_text(t) for t in texts[:60]]
    words = sorted({w for t in folded for w in toxicity.WORD.findall(t) if len(w) >= 4})
    chosen = rng.sample(words, 150)
    entries = {}
    for w in chosen:
        e = w[: rng.randint(4, len(w))]
        if not any(e.startswith(x) or x.startswith(e) for x in entries):
            entries[e] = rng.random() * 5
    lexicon = toxicity.Lexicon(entries, bias=-2.0, weights=(0.7, 0.3))
    some = 0
    for t in [*folded, "", "x" * 1000, " ".join(entries), "-".join(entries), "".join(entries)]:
        want = plain_hits(lexicon, t)
        some += len(want)
        assert lexicon.hits(t) == want
        lexicon.exceptions = frozenset(p for _, p, _ in want[::3])
        weight = sum(w for w, a, b in want if a not in lexicon.exceptions and b not in lexicon.exceptions)
        share = math.log1p(100 * weight / (t.count(" ") + t.count("\n") + 1)) if weight else 0.0
        assert lexicon.score(t) == pytest.approx(1 / (1 + math.exp(2.0 - 0.7 * math.log1p(weight) - 0.3 * share)), abs=1e-12)
        lexicon.exceptions = frozenset()
    assert some > 100


def test_pairwise_terms_equal_a_sum_over_pairs(texts):
    rng = np.random.default_rng(2)
    n = quality.BUCKETS + quality.STEPS * len(quality.STATS)
    edges = np.sort(rng.normal(size=(len(quality.STATS), quality.STEPS - 1)) * 10, axis=1)
    model = quality.FactorisationMachine(edges, 0.3, rng.normal(0, 0.1, n), rng.normal(0, 0.3, (n, quality.RANK)))
    some = [*sorted(texts, key=lambda t: len(t or ""))[:12], "", None, "one"]
    for text, score in zip(some, model.score(some)):
        (index, value, _) = model.rows([quality.encode(text)])
        pairs = sum(float(model.factors[i] @ model.factors[j]) * a * b for (i, a), (j, b) in itertools.combinations(zip(index, value), 2))
        margin = 0.3 + float(model.linear[index] @ value) + pairs
        assert score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, margin)))), abs=1e-9)


def test_items_go_where_the_dot_product_is_highest():
    rng = np.random.default_rng(3)
    sizes, bins, w = np.abs(rng.normal(size=(60, 3))) * 0.1, 7, sharding.WEIGHTS
    got = sharding.pack(sizes, bins)
    left = [[1.0] * 3 for _ in range(bins)]
    order = sorted(range(60), key=lambda i: (-sum(float(s) * x for s, x in zip(sizes[i], w)), i))
    for n, i in enumerate(order):
        aim = w if n < 30 else (w[0], 0.02 * w[1], 0.02 * w[2])
        dots = [sum(r * s * a for r, s, a in zip(rest, sizes[i], aim)) for rest in left]
        assert dots[got[i]] == pytest.approx(max(dots), abs=1e-12)
        left[got[i]] = [r - s for r, s in zip(left[got[i]], sizes[i])]
