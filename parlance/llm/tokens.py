"""Token counts of a byte-level BPE vocabulary: strings proven to be one token are counted, only the rest is merged."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Fixed value: the pattern that byte-level vocabularies split text by before they merge.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the characters of Unicode's property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks that a task remembers beside the whole tokens; when there are more it forgets them and works them out again.
REMEMBERED = 400_000
#: Stands for the tokens of a chunk that the pattern may split otherwise than the tokenizer: makes any sum negative.
UNSURE = -(1 << 40)
#: A text is cut into stretches of about so many characters, each between two pre-tokens.
STRETCH = 1 << 20

_pre_token = regex.compile(PRE_TOKENS)
#: White space with what follows it up to the next white space: pre-tokens never go over the end of one.
_chunk = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_edge = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def loaded(vocabulary: str) -> tuple[Tokenizer, list[str]]:
    """The tokenizer that a JSON text describes, and its special strings; an error if it is none that these counts hold for."""
    told = json.loads(vocabulary)
    split, model, added = told.get("pre_tokenizer") or {}, told["model"], told.get("added_tokens") or []
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or told.get("normalizer") or model.get("type") != "BPE" or model.get("dropout"):
        raise ValueError("counts need a byte-level BPE without normaliser, prefix space and dropout")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("special strings must be matched as they stand")
    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [t["content"] for t in added]


def whole_tokens(tokenizer: Tokenizer) -> list[str]:
    """The strings of the vocabulary that, standing alone, are one pre-token and are merged into one token.

    Each is put to the proof: its bytes must be a text, the pattern must leave it whole, here and in the tokenizer, and
    the merges must end in one token, which a vocabulary doesn't promise for all its strings.
    """
    letters, proven = byte_letters(), []
    for written in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(letters[x] for x in written).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and _alone(text) and len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1 and len(tokenizer.model.tokenize(written)) == 1:
            proven.append(text)
    return sorted(proven)


def _alone(text: str) -> bool:
    return _pre_token.fullmatch(text) is not None and len(_pre_token.findall(text)) == 1


def stretches(text: str) -> Iterator[str]:
    """A text in parts that end where white space begins after something else, so that no pre-token is cut."""
    start = 0
    while len(text) - start > STRETCH and (edge := _edge.search(text, start + STRETCH)):
        yield text[start : edge.start()]
        start = edge.start()
    yield text[start:]


class Counter:
    """Counts the tokens of whole texts as the tokenizer does, special strings included."""

    def __init__(self, vocabulary: str, whole: list[str]) -> None:
        self.tokenizer, special = loaded(vocabulary)
        # Where two begin at one place the longer is taken.
        self.special = re.compile("|".join(re.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        self.letters = {b: x for x, b in byte_letters().items()}
        self.space = self.letters[ord(" ")]
        self.whole, self.agreed = dict.fromkeys(whole, 1), {}
        self.known = dict(self.whole)

    def __call__(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; texts are taken together until they have a stretch's length, so that what is not known is worked out once for them."""
        found, held, size = [0] * len(texts), [], 0
        for k, text in enumerate(texts):
            parts = self.special.split(text or "") if self.special else [text or ""]
            found[k] += len(parts) - 1
            for stretch in (x for part in parts if part for x in stretches(part)):
                held.append((k, stretch, _chunk.findall(stretch)))
                size += len(stretch)
                if size >= STRETCH:
                    self._add(held, found)
                    held, size = [], 0
        self._add(held, found)
        return found

    def _add(self, held: list[tuple[int, str, list[str]]], found: list[int]) -> None:
        if len(self.known) > REMEMBERED + len(self.whole):
            self.known = dict(self.whole)
        self._learn([x for x in set().union(*(chunks for _, _, chunks in held)) if x not in self.known])
        for k, stretch, chunks in held:
            n = sum(map(self.known.__getitem__, chunks))
            # Characters of another Unicode version: the tokenizer splits these itself.
            found[k] += n if n >= 0 else sum(len(self.tokenizer.model.tokenize(x)) for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(stretch))

    def _learn(self, chunks: list[str]) -> None:
        """Work out chunks: their pre-tokens that are whole tokens count 1, others that are not known yet are merged."""
        known = self.known
        for x in chunks:
            if not (x.isascii() or all(map(self._agrees, set(x)))):
                known[x] = UNSURE
                continue
            n = 0
            for part in _pre_token.findall(x):
                if (cost := known.get(part)) is None:
                    cost = known[part] = len(self.tokenizer.model.tokenize(self._written(part)))
                n += cost
            known[x] = n

    def _written(self, x: str) -> str:
        """A text in the characters that stand for its bytes."""
        return x.replace(" ", self.space) if x.isascii() and x.isprintable() else "".join(map(self.letters.__getitem__, x.encode()))

    def _agrees(self, x: str) -> bool:
        """Whether the tokenizer takes a character for what the pattern does: letter, number, white space or none of these."""
        if x not in self.agreed:
            texts = [f"a{x}1", f"a{x} "]
            theirs = [[tuple(span) for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(t)] for t in texts]
            self.agreed[x] = theirs == [[m.span() for m in _pre_token.finditer(t)] for t in texts]
        return self.agreed[x]


_counters: dict[str, Counter] = {}


def counter(vocabulary: str, whole: list[str]) -> Counter:
    """The one counter of this process for a vocabulary; an earlier vocabulary's is let go."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(vocabulary, whole)
    return _counters[key]


def counted(docs: DataFrame, vocabulary: str, *, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of their whole texts in the column ``name``, which replaces one of that name.

    ``vocabulary`` is the path of a tokenizer's JSON file on the driver; the file's text and the strings proven to be
    whole tokens, both of the vocabulary's size, are broadcast. No row moves. Null and empty texts have 0 tokens; white
    space counts; repeated rows are counted each; a very long text is counted in stretches between pre-tokens; other
    columns, whatever their names, are kept; an empty table stays empty.
    """
    with open(vocabulary, encoding="utf-8") as file:
        told = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((told, whole_tokens(loaded(told)[0])))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(*shared.value)
        for texts in batches:
            yield pd.Series(count(texts.tolist()), dtype="int64")

    return docs.withColumn(name, n_tokens(F.col(text)))
