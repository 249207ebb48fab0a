"""Token counts held against the tokenizer itself."""

import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm import queries, tokens

PATH = public_tokenizers.path(queries.VOCABULARY)
#: Contractions, runs of white space of all kinds, special strings, letters that Unicode versions differ on, marks.
PIECES = [" ", "  ", "\n", "\t", "\r\n", "a", "Z", "'s", "'", "é", "中", "½", "1", "٣", "՘", "࢏", "\U000107bb", "\x1c", "\x85", "\xa0", "　", "<|endoftext|>", "<|endof", "!", "…", "😀", "́", "don't", "​", "₏", "word", "\x00"]


@pytest.fixture(scope="module")
def told():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def counter(told):
    return tokens.Counter(told, tokens.whole_tokens(tokens.loaded(told)[0]))


def library(texts):
    return [len(e) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_whole_tokens_are_one_token_and_one_pre_token(told):
    tokenizer, _ = tokens.loaded(told)
    whole = tokens.whole_tokens(tokenizer)
    assert len(whole) > 40_000 and all(len(e) == 1 for e in tokenizer.encode_batch(whole, add_special_tokens=False))
    # Strings of the vocabulary that no merge leads to, or that are cut before merging, are not proven.
    letters = tokens.byte_letters()
    assert len(whole) < sum(all(x in letters for x in w) for w in tokenizer.get_vocab(with_added_tokens=False))


@pytest.mark.parametrize("stretch, remembered", [(1 << 20, 400_000), (20, 50)])
def test_odd_texts_count_as_the_tokenizer_has_it(counter, monkeypatch, stretch, remembered):
    monkeypatch.setattr(tokens, "STRETCH", stretch)
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["", None, " ", "x" * 5000, " " * 3000 + "y"]
    assert counter(texts) == library(texts)


def test_documents_count_as_the_tokenizer_has_it(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op11_token_counts(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], library([r.text for r in docs])))
    assert {k: r.n_tokens for k, r in rows.items()} == want
    assert all(r.n_bytes == len((t.text or "").encode()) and r.over_limit == (r.n_tokens > 1024) for t in docs for r in [rows[t.doc_id]])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (2, None), (3, ""), (4, "word " * 300_000)], "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "n_bytes": F.lit(1)})
    rows = tokens.counted(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0), (4, library(["word " * 300_000])[0])]
    assert tokens.counted(docs.filter("false"), PATH).columns == docs.columns and tokens.counted(docs.filter("false"), PATH).count() == 0


def test_other_kinds_of_tokenizers_are_refused(told):
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError):
            tokens.loaded(json.dumps(json.loads(told) | change))
