"""Words, their hashes and word shingles, for the operators that compare texts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
#: Words of a shingle.
WIDTH = 5


class WordHashes(dict):
    """64-bit hashes of words, kept for reuse up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case: runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def hashed(words: list[str], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


#: Characters that are taken together when words are found by arrays, about.
TAKEN = 1 << 18
#: Odd numbers, inverse to each other modulo 2^64: bases of the hashes of runs.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@cache
def _letters() -> np.ndarray:
    """A number for each code point: that of a character of words, 0 for others."""
    out = np.zeros(0x110000, dtype=np.uint64)
    for m in WORD.finditer("".join(map(chr, range(len(out))))):
        out[m.start() : m.end()] = mix(np.arange(m.start() + 1, m.end() + 1, dtype=np.uint64))
    return out


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


class KnownWords:
    """Hashes of words by their keys, kept for reuse in slots: of words that share a slot the last one."""

    BITS = 17

    def __init__(self) -> None:
        self.keys, self.values = np.zeros((2, 1 << self.BITS), dtype=np.uint64)
        self.keys[0] = 1  # whose own slot is another; the key 0 has this one

    def of(self, keys: np.ndarray, text: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words that a text has from ``start`` to ``end``."""
        slot = (keys * np.uint64(BASE) >> np.uint64(64 - self.BITS)).view(np.int64)
        values = self.values[slot]
        new = np.flatnonzero(self.keys[slot] != keys)
        if len(new):
            _, one, each = np.unique(keys[new], return_index=True, return_inverse=True)
            one = new[one]
            found = np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(start[one].tolist(), end[one].tolist())], dtype=np.uint64)
            values[new] = found[each]
            self.keys[slot[one]], self.values[slot[one]] = keys[one], found
        return values


def hashed_texts(texts: Sequence[str | None], known: KnownWords) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashes of the words of many texts, some texts at a time: the first text's number, all their words, and where each text's words begin and end.

    Words and hashes are those of ``words_of`` and ``hashed``; an object is made for each word that isn't known yet, not for each one.
    """
    k = 0
    while k < len(texts):
        first, some, n = k, [], 0
        while k < len(texts) and n < TAKEN:
            some.append((texts[k] or "").lower())
            n += len(some[-1])
            k += 1
        begin = np.cumsum([0] + [len(x) + 1 for x in some])
        joined = "\n".join(some)
        start, end, keys = _words_at(np.frombuffer(joined.encode(), dtype=np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        yield first, known.of(keys, joined, start, end), np.searchsorted(start, begin)


def _words_at(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words among code points begin and end, and keys that tell them apart: polynomials of their characters.

    Block by block; a word that goes on into the next one is ended there.
    """
    letters, n = _letters(), TAKEN // 4
    powers, backs = _powers(BASE, n), _powers(INVERSE, n)
    none = np.zeros(0, dtype=np.uint64)
    starts, ends, before, back, behind = [none.view(np.int64)], [none.view(np.int64)], [none], [none], [none]
    within, total = 0, np.zeros(1, dtype=np.uint64)
    for lo in range(0, len(points), n):
        some = letters[points[lo : lo + n]]
        sums = np.concatenate([total, total + np.cumsum(some * powers[: len(some)] * np.uint64(pow(BASE, lo, 1 << 64)))])
        turn = np.flatnonzero(np.diff(some != 0, prepend=bool(within)))
        start, end = turn[within::2], turn[1 - within :: 2]
        starts.append(start + lo)
        ends.append(end + lo)
        before.append(sums[start])
        back.append(backs[start] * np.uint64(pow(INVERSE, lo, 1 << 64)))
        behind.append(sums[end])
        within, total = int(some[-1] != 0), sums[-1:]
    if within:
        ends.append(np.array([len(points)]))
        behind.append(total)
    return np.concatenate(starts), np.concatenate(ends), (np.concatenate(behind) - np.concatenate(before)) * np.concatenate(back)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values, in order."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[k : k + n])
    return out


def shingle_set(values: np.ndarray) -> np.ndarray:
    """Distinct shingles in order of hash; a text of fewer words than a shingle is one shingle, one without words none."""
    return np.unique(grams(values, min(WIDTH, len(values)))) if len(values) else np.zeros(0, dtype=np.uint64)
