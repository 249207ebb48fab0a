"""Quality scores by a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import training_sample

#: Labelled rows of either class that are learnt from.
TRAIN_ROWS = 4000
#: Buckets of hashed words, steps of each statistic, rank of the interactions.
BUCKETS, STEPS, RANK = 1 << 13, 12, 8
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.02, 1e-4
STATS = (
    "words", "chars", "lines", "word_length", "upper", "digits", "punctuation", "signs", "bars", "shouts",
    "distinct", "top_word", "stutter", "repeated_lines", "line_words", "sentence_words",
)
_UPPER, _DIGIT, _PUNCT, _SIGN, _ALPHA = (
    np.isin(np.arange(256), list(chars))
    for chars in (range(65, 91), range(48, 58), b".,;:?!'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", [*range(65, 91), *range(97, 123), *range(128, 256)])
)


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Figures on the structure of a text, in the order of STATS."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    n, size, alpha = max(1, len(words)), max(1, int(raw.sum())), max(1, int(raw[_ALPHA].sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(len(words)),
        math.log1p(len(text)),
        math.log1p(len(lines)),
        len(text) / n,
        raw[_UPPER].sum() / alpha,
        raw[_DIGIT].sum() / size,
        raw[_PUNCT].sum() / size,
        raw[_SIGN].sum() / size,
        raw[124] / size,
        text.count("!!") / n,
        len(counts) / n**0.8,
        max(counts.values(), default=0) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        math.log1p(n / (1 + raw[46] + raw[33] + raw[63])),
    ]


def encode(text: str | None) -> tuple[np.ndarray, list[float]]:
    """The distinct buckets of a text's words, and its statistics."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    buckets = np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS for w in counts), dtype=np.int64, count=len(counts)))
    return buckets, statistics(text, words, counts)


@dataclass
class FactorisationMachine:
    """Bias, linear weights and factors; the first BUCKETS features are words, then STEPS for each statistic."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def rows(self, encoded: list[tuple[np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers, their values and where each row starts. A row's words share a length of 1."""
        stats = np.array([s for _, s in encoded])
        steps = np.stack([np.searchsorted(self.edges[k], stats[:, k], side="right") for k in range(stats.shape[1])], axis=1)
        steps += BUCKETS + STEPS * np.arange(stats.shape[1])
        index = [np.concatenate([b, s]) for (b, _), s in zip(encoded, steps)]
        value = [np.concatenate([np.full(len(b), 1 / math.sqrt(max(1, len(b)))), np.full(len(s), 0.5)]) for (b, _), s in zip(encoded, steps)]
        starts = np.cumsum([0, *map(len, index)])[:-1]
        return np.concatenate(index), np.concatenate(value), starts

    def margin(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the margin and the factors' sums: pairwise terms are half of the sums' squares less the squares' sums."""
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + pairs, sums

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for k in range(0, len(texts), BATCH):
            m, _ = self.margin(*self.rows([encode(t) for t in texts[k : k + BATCH]]))
            out.append(1 / (1 + np.exp(-np.clip(m, -30, 30))))
        return np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, *, label: str = "quality", per_class: int = TRAIN_ROWS, seed: int = 9) -> FactorisationMachine:
    """Learn from at most ``per_class`` labelled rows of either class that ``keep`` lets through.

    Texts are encoded in tasks; what comes to the driver is bounded by 2 * per_class rows of at most BUCKETS numbers.
    Classes weigh as in the labels at large. Without rows of both classes every score is the one class's share.
    """
    sample = training_sample(docs, labels, label, keep, per_class)
    shares = labels.filter(keep).filter(F.col(label).isNotNull()).agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [encode(t) for t in batch["text"]]
            yield pd.DataFrame({"buckets": [b.astype(np.int16) for b, _ in rows], "stats": [s for _, s in rows], "y": batch["label"]})

    data = sample.mapInPandas(encoded, "buckets array<smallint>, stats array<double>, y int").toPandas()
    y = data["y"].to_numpy(dtype=float)
    n = BUCKETS + STEPS * len(STATS)
    rng = np.random.default_rng(seed)
    share = min(0.99, max(0.01, shares if shares is not None else 0.5))
    model = FactorisationMachine(np.zeros((len(STATS), STEPS - 1)), math.log(share / (1 - share)), np.zeros(n), rng.normal(0, 0.02, (n, RANK)))
    if not 0 < y.sum() < len(y):
        model.factors[:] = 0
        return model
    order = np.lexsort((y, data["stats"].map(lambda s: s[1])))  # whatever order the rows came in
    rows = [(np.asarray(data["buckets"][i], dtype=np.int64), list(data["stats"][i])) for i in order]
    y = y[order]
    stats = np.array([s for _, s in rows])
    model.edges = np.quantile(stats, np.linspace(0, 1, STEPS + 1)[1:-1], axis=0).T
    weigh = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.linear, model.factors)]
    turn = 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(len(rows))
        for k in range(0, len(rows), BATCH):
            part = mixed[k : k + BATCH]
            index, value, starts = model.rows([rows[i] for i in part])
            m, sums = model.margin(index, value, starts)
            slope = weigh[part] * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[part]) / len(part)
            of = np.repeat(np.arange(len(part)), np.diff([*starts, len(index)]))
            one = slope[of] * value
            grads = (np.bincount(index, one, n) + DECAY * model.linear, np.zeros_like(model.factors))
            np.add.at(grads[1], index, one[:, None] * (sums[of] - model.factors[index] * value[:, None]))
            grads[1][:] += DECAY * model.factors
            turn += 1
            model.bias -= RATE * float(slope.sum())
            for p, g, (first, second) in zip((model.linear, model.factors), grads, state):
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                p -= RATE * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return model


def scorer(model: FactorisationMachine):
    """A function of a text column that gives the score column; null texts score as empty ones."""

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(text)))

    return scored


def score(docs: DataFrame, model: FactorisationMachine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row.

    A null text scores as the empty one, which has statistics but no words. Repeated rows score alike, texts are read
    whole, an empty table gives no rows; other columns are not read.
    """
    return docs.select(id_col, scorer(model)(F.col(text_col)).alias("score"))
