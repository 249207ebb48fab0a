import hashlib
import math

from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import canonical

ODD = ["", " ", "a", "  A\tb ", "x y z", "\x1cq\x1f", "héé Wörld\n", None, "a" * 5, "abc d", "　"]


def values(spark, items, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[1] for r in df.select("i", expr(F.col("x"))).orderBy("i").collect()]


def test_words_tokens_and_hash_agree_with_python(spark):
    assert values(spark, ODD, T.word_count) == [len((x or "").split()) for x in ODD]
    assert values(spark, ODD, T.token_estimate) == [math.ceil(len((x or "").strip()) / 4) for x in ODD]
    forms = [None if x is None else " ".join(x.lower().split()) for x in ODD]
    assert values(spark, ODD, T.normalize_question) == forms
    assert values(spark, ODD, T.question_hash) == [None if f is None else hashlib.sha256(f.encode()).hexdigest()[:16] for f in forms]


def test_parse_object(spark):
    cases = ['{"a":1}', '```json\n{"a":1}\n```', 'so {"a":1} it is', "[1]", '{"a":1} {"b":2}', "", None, "{", '"x"', "{'a':1}"]
    got = values(spark, cases, lambda x: F.to_json(T.parse_object(x)))
    assert got == ['{"a":1}', '{"a":1}', '{"a":1}', None, None, None, None, None, None, None]


def test_booleans_tags_and_choice(spark):
    assert values(spark, ["Yes", "0", "", "maybe", None], T.as_bool) == [True, False, False, False, False]
    assert values(spark, ["Fr_CA!", "  ", "--x--", None], T.language_tag) == ["fr-ca", "lang", "x", "lang"]
    assert values(spark, ["ab1", "", None], lambda x: T.better_text(x, F.lit("abc"))) == ["abc", "abc", "abc"]


def test_clean_queries(spark):
    df = spark.createDataFrame([([" ar ", "ok", "a b", "sukuk", "", None, "Morocco"],)], "q array<string>")
    assert df.select(canonical.clean_queries(F.col("q"))).first()[0] == ["a b", "sukuk"]


def test_trace_is_canonical(spark):
    raw = (
        '{"assistant_reasoning":[{"turn_index":1,"reasoning_trace":{"thinking":[{"text":"Use passage P1","assumption":"x"},'
        '{"assumption":"fallback when text is absent"},{"text":"already clean"},"freeform",null],'
        '"retrieval_queries":{"vector_db_search":[null,"a",""],"web_search":[null,"w1"]},"known_limits":[null,"k1"],"premises":[true]}}]}'
    )
    df = canonical.sanitize(spark.createDataFrame([(raw,), ("broken",), ("[1]",)], "value string"))
    first, broken, other = df.collect()
    trace = first.assistant_reasoning[0].reasoning_trace
    assert [t.text for t in trace.thinking] == ["Use passage P1", "fallback when text is absent", "already clean", "freeform", ""]
    assert trace.retrieval_queries.vector_db_search == ["a"] and trace.retrieval_queries.web_search == ["w1"]
    assert trace.known_limits == ["k1"] and trace.question == "" and trace.evidence == [] and trace.premises[0].text == "true"
    assert not broken.parsed and not other.parsed and broken.value == "broken"
    assert canonical.sanitize(spark.createDataFrame([], "value string")).count() == 0
