"""Ragged rows: one schema whatever the order, every value had again."""

import json
import random

from pyspark.sql import functions as F

from parlance.operators import shapes

DOCS = [
    '{"a":1,"b":"x","c":[1,2],"d":{"e":1}}', '{"a":2.5,"b":null,"c":[],"d":{"e":2,"f":"g"}}', '{"a":"t","z y":true,"q\'r":1,"u\\"v":2}', "[1]", '"s"', "3", "{}", None,
    '{"a":12345678901234567890123,"c":[1,"x"]}', '{"n":null}', '{"b":"","k`l":1.5,"<x>":{"y,":[{"z":1}]}}', '{"k`l":1.25,"STRUCT":"é\\n","d":{"e":null}}',
]


def variants(spark, docs, parts=1):
    return spark.createDataFrame(list(enumerate(docs)), "i int, t string").repartition(parts).select("i", F.parse_json("t").alias("v"))


def plain(text):
    return None if text is None else json.loads(text)


def test_every_value_is_had_again(spark):
    out = shapes.restored(shapes.shaped(variants(spark, DOCS), "v"))
    got = {r.i: plain(r.json) for r in out.collect()}
    assert got == {i: plain(t) for i, t in enumerate(DOCS)}
    assert {"a", "b", "c", "d", "k`l", "n", "q'r", 'u"v', "z y", "<x>", "STRUCT"} == {f.name for f in out.schema["typed"].dataType.fields}


def test_schema_does_not_depend_on_order(spark):
    objects = [t for t in DOCS if t and t[0] == "{"] * 3
    found = set()
    for seed in range(3):
        random.Random(seed).shuffle(objects)
        found.add(shapes.merged_schema(variants(spark, objects, 1 + seed), "v"))
    (schema,) = found
    kinds = shapes.fields_of(schema)
    assert kinds["b"] == "STRING" and kinds["c"] == "ARRAY<VARIANT>" and kinds["a"] == "VARIANT" and kinds["d"].startswith("STRUCT<")


def test_keys_of_later_rows_are_kept_and_empty_tables_have_none(spark):
    schema = shapes.merged_schema(variants(spark, ['{"a":1}']), "v")
    rows = shapes.shaped(variants(spark, ['{"a":7,"new":[1]}', '{"a":"seven"}']), "v", schema).orderBy("i").collect()
    assert [(r.typed.a, r.rest) for r in rows] == [(7, {"new": "[1]"}), (None, {"a": '"seven"'})]
    assert shapes.shaped(variants(spark, DOCS).filter("false"), "v", schema).count() == 0
