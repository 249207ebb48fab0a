"""Benchmark decontamination on templates: numbers, names and units become typed slots, whose fillers must agree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small

#: Tokens of a window; a shorter item is one window, down to SHORTEST tokens.
WINDOW, SHORTEST = 8, 5
#: Share of a window's tokens that must be words, not slots, and share of an item that matched windows must cover.
LITERAL, COVERED = 0.5, 0.5
#: Windows and words of the benchmark that tasks may hold to sift with; a larger benchmark meets all windows in a shuffle join.
MOST_HELD = 1_000_000

# Words that name a unit when they follow a number.
UNITS = frozenset(
    "% $ € £ ¥ cent cents dollar dollars euro euros pound pounds mm cm m km mile miles inch inches foot feet yard yards mg g kg ton tons "
    "ounce ounces lb lbs ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days "
    "week weeks month months year years mph kmh degree degrees percent".split()
)
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£¥]|[.!?\n]")
ENDS = frozenset(".!?\n")
NUMBER, UNIT, NAME, UNKNOWN, CAPITAL, END = -2, -3, -4, -1, -5, -6


class Codes(dict):
    """Codes of raw tokens: words of the benchmark by number, the rest by kind. Kept for reuse, up to a bound.

    Units have their codes as words here; ``canonical`` makes them slots where they follow a number.
    """

    def __init__(self, words: dict[str, int], names: frozenset[str]):
        super().__init__()
        self.words, self.names = words, names

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token in ENDS:
            code = END
        elif token[0].isdigit():
            code = NUMBER
        elif low in self.names:
            code = NAME
        elif low in self.words:
            code = self.words[low]
        else:
            code = CAPITAL if token[0].isupper() else UNKNOWN
        if len(self) > 300_000:
            self.clear()
        self[token] = code
        return code


def canonical(text: str | None, codes: Codes) -> tuple[list[str], np.ndarray]:
    """The tokens of a text without sentence ends, and their codes.

    A capitalised word that is no word of the benchmark is a name, at a sentence's start too. A unit is one after a
    number, whether or not the benchmark has it as a word; elsewhere it is a word like others.
    """
    tokens = TOKEN.findall(text or "")
    raw = np.fromiter(map(codes.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    raw[raw == CAPITAL] = NAME
    keep = raw != END
    kept, raw = np.flatnonzero(keep), raw[keep]
    if len(kept) != len(tokens):
        tokens = [tokens[i] for i in kept]
    for at in (np.flatnonzero(raw[:-1] == NUMBER) + 1).tolist():
        if tokens[at].lower() in UNITS:
            raw[at] = UNIT
    return tokens, raw


def windows(tokens: list[str], raw: np.ndarray, width: int, wanted: np.ndarray | None) -> Iterator[tuple[int, int, list[str]]]:
    """Hash, place and fillers of each window that holds no unknown word and enough known ones; of ``wanted`` hashes if given."""
    if len(raw) < width:
        return
    run = lambda hit: np.convolve(hit, np.ones(width, dtype=np.int64), "valid")
    good = np.flatnonzero((run(raw == UNKNOWN) == 0) & (run(raw >= 0) >= LITERAL * width))
    if not len(good):
        return
    value = np.full(len(good), width, dtype=np.uint64)
    mixed = (raw.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    for k in range(width):
        value = (value ^ mixed[good + k]) * np.uint64(0x94D049BB133111EB)
        value ^= value >> np.uint64(31)
    value = value.view(np.int64)
    if wanted is not None:
        hit = wanted[np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)] == value if len(wanted) else np.zeros(len(value), dtype=bool)
        good, value = good[hit], value[hit]
    for at, v in zip(good.tolist(), value.tolist()):
        yield v, at, [tokens[at + k].lower() for k in range(width) if raw[at + k] < 0]


def agree(pairs: list[tuple[list[str], list[str]]]) -> list[bool]:
    """Of each window (fillers in the benchmark, in the document), whether it keeps to one filler for each slot.

    A filler of the benchmark stands for the one that most windows put in its place, and no two share one.
    """
    votes = Counter((a, b) for left, right in pairs for a, b in zip(left, right))
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    for (a, b), _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
        if a not in there and b not in back:
            there[a], back[b] = b, a
    return [all(there.get(a) == b for a, b in zip(left, right)) for left, right in pairs]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item whose template it holds.

    Names are the benchmark's words that it never has in lower case; its other words are literal in any case. Units are
    slots after a number. Windows of a document's template are joined by
    hash with those of the items; windows with inconsistent fillers go, and the rest must cover half the item.

    Returns id, item_id, n_windows, coverage, reparameterised (some filler differs) and text_key (xxhash64 of the
    text). Null and empty texts hold nothing, and items under SHORTEST tokens can't be told from chance and match
    nothing. Rows alike in id and text give one result; null ids stand for themselves. Either table may be empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    items = benchmark.select("item_id", F.col("text").alias("text")).filter(F.col("text").isNotNull()).distinct()

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {}
            for text in batch["text"]:
                for token in TOKEN.findall(text):
                    if token not in ENDS and not token[0].isdigit():
                        low = token.lower()
                        rows[low] = rows.get(low, False) or not token[0].isupper()
            yield pd.DataFrame(list(rows.items()), columns=["word", "literal"])

    words = items.mapInPandas(seen, "word string, literal boolean").groupBy("word").agg(F.bool_or("literal").alias("literal"))
    # The benchmark's own words, a table that the corpus does not make grow; checked all the same.
    words = words.limit(MOST_HELD + 1).collect()
    if len(words) > MOST_HELD:
        raise ValueError(f"the benchmark has over {MOST_HELD} words; split it")
    literal = {w: i for i, w in enumerate(sorted(r.word for r in words if r.literal))}
    codes = Codes(literal, frozenset(r.word for r in words if not r.literal))

    def item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                tokens, raw = canonical(text, codes)
                width = min(WINDOW, len(tokens))
                found: dict[tuple, list[int]] = {}
                for v, at, slots in windows(tokens, raw, width, None) if width >= SHORTEST else ():
                    found.setdefault((v, tuple(slots)), []).append(at)
                rows += [(v, item, width, len(tokens), at, list(slots)) for (v, slots), at in found.items()]
            yield pd.DataFrame(rows, columns=["v", "item_id", "width", "n_tokens", "places", "item_slots"])

    listed = save(items.mapInPandas(item_windows, f"v long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, width int, n_tokens int, places array<int>, item_slots array<string>"), "listed")
    widths = sorted(r.width for r in listed.select("width").distinct().collect())
    held = listed.select("v").distinct().limit(MOST_HELD + 1).toPandas()["v"].to_numpy()
    wanted = np.sort(held) if len(held) <= MOST_HELD else None

    def doc_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, key, text in zip(batch["id"], batch["text_key"], batch["text"]):
                tokens, raw = canonical(text, codes)
                found = {(v, tuple(slots)) for width in widths for v, _, slots in windows(tokens, raw, width, wanted)}
                rows += [(doc, key, v, list(slots)) for v, slots in found]
            yield pd.DataFrame(rows, columns=["id", "text_key", "v", "slots"])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    hits = texts.mapInPandas(doc_windows, f"id {kind}, text_key long, v long, slots array<string>").join(small(listed, 100_000), "v")

    def judged(group: pd.DataFrame) -> pd.DataFrame:
        pairs = [(list(a), list(b)) for a, b in zip(group["item_slots"], group["slots"])]
        fits = agree(pairs)
        covered = np.zeros(int(group["n_tokens"].iloc[0]), dtype=bool)
        for ok, places, width in zip(fits, group["places"], group["width"]):
            for at in places if ok else ():
                covered[at : at + width] = True
        row = group.iloc[:1][["id", "item_id", "text_key"]].copy()
        changed = any(ok and a != b for ok, (a, b) in zip(fits, pairs))
        return row.assign(n_windows=sum(fits), coverage=covered.mean(), reparameterised=changed)

    out = f"id {kind}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, text_key long, n_windows int, coverage double, reparameterised boolean"
    found = hits.groupBy("id", "text_key", "item_id").applyInPandas(judged, out).filter(F.col("coverage") >= COVERED)
    return found.select(F.col("id").alias(id_col), "item_id", "n_windows", "coverage", "reparameterised", "text_key")
