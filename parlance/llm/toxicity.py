"""Toxicity scores from a learnt, weighted lexicon matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread
from .learning import training_sample

#: Labelled rows of either class that the lexicon and the weights are learnt from.
TRAIN_ROWS = 5000
#: Lengths of word beginnings that may become entries, and how many entries there may be.
SHORTEST, LONGEST, MOST_ENTRIES = 4, 12, 5000
#: Documents of class 1 that an entry must be seen in, in number and share, and its least log odds ratio.
LEAST_SEEN, LEAST_SHARE, LEAST_ODDS = 5, 0.02, 2.5

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
INVISIBLE = ("­", "​", "‌", "‍", "⁠", "﻿")
FOLD = str.maketrans(HOMOGLYPHS | DIGITS | dict.fromkeys(INVISIBLE, ""))
WORD = re.compile(r"[^\W_]+")


def fold_text(text: str | None) -> str:
    """Lower case, compatibility forms, look-alikes and digits as the letters they stand for."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(FOLD)


@dataclass
class Lexicon:
    """Word beginnings with weights, phrases that excuse a hit, and the weights that make a score of the hits."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    bias: float = -4.0
    weights: tuple[float, float] = (1.0, 1.0)

    def automaton(self):
        """Built once on each worker, then reused."""
        if "_built" not in self.__dict__:
            self._built = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                self._built.add_word(entry, (len(entry), weight))
            self._built.make_automaton()
        return self._built

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_built"}

    def hits(self, text: str) -> list[tuple[float, str, str]]:
        """Of each hit its weight and the phrases that it forms with the word before and the word after."""
        if not self.entries:
            return []
        out, end = [], 0
        for last, (length, weight) in self.automaton().iter(text):
            start = last - length + 1
            if start < end or start and text[start - 1].isalnum():
                continue
            word = WORD.match(text, start)
            end = word.end()
            before = text[max(0, start - 40) : start].split()[-1:]
            after = text[end : end + 40].split()[:1]
            hit = word.group()
            out.append((weight, " ".join([*(WORD.findall(before[0])[-1:] if before else []), hit]), " ".join([hit, *(WORD.findall(after[0])[:1] if after else [])])))
        return out

    def features(self, text: str) -> tuple[float, float]:
        """Weight of the hits that no exception excuses, and the same for 100 words, as logarithms."""
        weight = sum(w for w, *phrases in self.hits(text) if not self.exceptions.intersection(phrases))
        if not weight:
            return 0.0, 0.0
        return math.log1p(weight), math.log1p(100 * weight / (text.count(" ") + text.count("\n") + 1))

    def score(self, text: str | None) -> float:
        a, b = self.features(fold_text(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.weights[0] * a + self.weights[1] * b))))


def fit(docs: DataFrame, labels: DataFrame, keep: Column, *, label: str = "toxic", per_class: int = TRAIN_ROWS) -> Lexicon:
    """Learn a lexicon from a bounded sample of the labelled rows that ``keep`` lets through.

    Entries are word beginnings that many documents of class 1 and few of class 0 have; each is as long as it can be
    without losing documents. Phrases of a hit and a neighbour that class 0 alone uses become exceptions. A logistic
    regression over the two features sets the scale. Without rows of both classes the lexicon is empty.
    """
    sample = training_sample(docs, labels, label, keep, per_class)
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        return Lexicon()

    def beginnings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, y in zip(batch["text"], batch["label"]):
                words = set(WORD.findall(fold_text(text)))
                seen[y].update({w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)})
            keys = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"entry": pd.Series(keys, dtype=object), "pos": [seen[1][k] for k in keys], "neg": [seen[0][k] for k in keys]})

    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    found = (
        spread(sample).mapInPandas(beginnings, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter(F.col("pos") >= max(LEAST_SEEN, LEAST_SHARE * pos)).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc("pos"), "entry").limit(4 * MOST_ENTRIES).collect()
    )
    lexicon = Lexicon(choose({r.entry: (r.pos, r.odds) for r in found}))

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, int(y)) for text, y in zip(batch["text"], batch["label"]) for p in {p for _, *two in lexicon.hits(fold_text(text)) for p in two if " " in p}]
            yield pd.DataFrame(rows, columns=["phrase", "y"])

    excused = sample.mapInPandas(phrases, "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    excused = excused.filter((F.col("neg") >= 3) & (F.col("neg") > 3 * F.col("pos"))).orderBy(F.desc("neg"), "phrase").limit(MOST_ENTRIES).collect()
    lexicon.exceptions = frozenset(r.phrase for r in excused)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(*lexicon.features(fold_text(t)), float(y)) for t, y in zip(batch["text"], batch["label"])], columns=["a", "b", "y"])

    data = sample.mapInPandas(measured, "a double, b double, y double").toPandas().to_numpy()
    bias, *weights = logistic(data[:, :2], data[:, 2])
    lexicon.bias, lexicon.weights = bias, tuple(weights)
    return lexicon


def choose(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """The beginnings to keep, with weights: none that begins with another one, each stretched while it loses no documents."""
    kept: dict[str, float] = {}
    for entry in sorted(found, key=lambda e: (len(e), e)):
        if any(entry[:n] in kept for n in range(SHORTEST, len(entry))):
            continue
        kept[entry] = found[entry][1]
    children: dict[str, list[str]] = {}
    for entry in found:
        children.setdefault(entry[:-1], []).append(entry)
    out = {}
    for entry, weight in kept.items():
        while longer := [c for c in children.get(entry, []) if found[c][0] >= 0.97 * found[entry][0]]:
            entry = max(longer, key=lambda c: (found[c][0], c))
        out[entry] = weight
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:MOST_ENTRIES])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    """Bias and weights by Newton's method, both classes weighing the same; weights are not below 0."""
    x = np.column_stack([np.ones(len(x)), x])
    weigh = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weigh * (p - y)) + ridge * w
        hess = (x * (weigh * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 2.0 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return [float(w[0]), *[max(0.0, float(v)) for v in w[1:]]]


def score(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row.

    Null and empty texts have no hits and get the score of a text without any. Repeated rows score alike, texts are
    matched whole whatever their length, an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": [lexicon.score(t) for t in batch["text"]]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(scored, f"id {kind}, score double").withColumnRenamed("id", id_col)
