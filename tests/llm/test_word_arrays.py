"""Words, seeds and chains of many texts by array operations against one text, one word and one group at a time."""

import random

import numpy as np
import pytest

from parlance.llm import passages, shingles

LETTERS = "abcdeFGHÄßİΣσς_ 0123\n\t.,;-   ´é漢字𝒳²Ⅷ" + "á"


@pytest.mark.parametrize("taken", [1 << 18, 64])
def test_words_of_many_texts_are_those_of_each(monkeypatch, taken):
    """Small blocks end within texts and words, too."""
    monkeypatch.setattr(shingles, "TAKEN", taken)
    rng = random.Random(taken)
    texts = ["".join(rng.choices(LETTERS, k=rng.randrange(120))) for _ in range(400)]
    texts += [None, "", "x" * 1000 + " y", "only plain words 7", "ends_within" * 40]
    rng.shuffle(texts)
    hashes, got = shingles.WordHashes(), []
    for first, values, bounds in shingles.hashed_texts(texts, shingles.KnownWords()):
        assert first == len(got)
        got += [values[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [shingles.hashed(shingles.words_of(x), hashes).tolist() for x in texts]


def test_every_character_is_in_words_as_the_pattern_has_it():
    """Those of words between two letters make one word, all others make two."""
    some = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(chr(c).lower()) == 1]
    [(_, values, bounds)] = shingles.hashed_texts([f"a{c}b" for c in some[:60_000]], shingles.KnownWords())
    assert np.diff(bounds).tolist() == [len(shingles.words_of(f"a{c}b")) for c in some[:60_000]]


def test_a_word_that_comes_again_is_hashed_once(monkeypatch):
    calls = []
    monkeypatch.setattr(shingles.xxhash, "xxh3_64_intdigest", lambda w, f=shingles.xxhash.xxh3_64_intdigest: calls.append(w) or f(w))
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(200)) for _ in range(500)]
    assert sum(len(v) for _, v, _ in shingles.hashed_texts(texts, shingles.KnownWords())) == 100_000
    assert len(calls) < 1000, len(calls)


def test_words_that_share_a_slot_keep_their_hashes(monkeypatch):
    monkeypatch.setattr(shingles.KnownWords, "BITS", 3)
    rng, hashes, known = random.Random(3), shingles.WordHashes(), shingles.KnownWords()
    for _ in range(20):
        text = " ".join(f"w{rng.randrange(60)}" for _ in range(200))
        [(_, values, _)] = shingles.hashed_texts([text], known)
        assert values.tolist() == shingles.hashed(shingles.words_of(text), hashes).tolist()


def test_seeds_of_many_texts_are_those_of_each():
    rng = random.Random(4)
    for _ in range(60):
        each = [np.array([rng.randrange(1 + rng.randrange(300)) for _ in range(rng.choice([0, 1, 4, 5, 6, 30, rng.randrange(400)]))], dtype=np.uint64) for _ in range(rng.randrange(1, 8))]
        found, at, whose = passages.minimizers(np.concatenate(each), np.cumsum([0] + [len(x) for x in each]))
        for k, values in enumerate(each):
            one = passages.minimizers(values)
            assert sorted(zip(found[whose == k].tolist(), at[whose == k].tolist())) == sorted(zip(one[0].tolist(), one[1].tolist()))


def test_only_broken_groups_are_chained_one_by_one(monkeypatch):
    rng, groups = np.random.default_rng(5), []
    for k in range(60):
        pos = np.sort(rng.choice(300, rng.integers(1, 20), replace=False))
        groups.append((pos, pos + 7 if k % 3 else rng.integers(0, 300, len(pos))))
    end = np.cumsum([len(p) for p, _ in groups])
    start = end - [len(p) for p, _ in groups]
    want = [(k, p[c].tolist(), o[c].tolist()) for k, (p, o) in enumerate(groups) for c in passages.chains(p, o)]
    calls, chains = [], passages.chains
    monkeypatch.setattr(passages, "chains", lambda p, o: calls.append(len(p)) or chains(p, o))
    pos, other = (np.concatenate(x) for x in zip(*groups))
    at, sizes, of = passages.chains_of(start, end, pos, other)
    ends = np.cumsum(sizes)
    got = [(int(k), pos[at[e - n : e]].tolist(), other[at[e - n : e]].tolist()) for k, e, n in zip(of, ends, sizes)]
    assert sorted(got) == sorted(want)
    broken = [k for k, (p, o) in enumerate(groups) if len(p) > 1 and not ((np.diff(o) > 0).all() and (passages.GAP * (np.diff(p) + np.diff(o)) < passages.SEED_WORDS).all())]
    assert len(calls) == len(broken) < len(groups)
