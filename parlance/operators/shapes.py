"""Ragged JSON rows: one schema found over all rows, typed columns by it, and what doesn't fit kept beside them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a merged schema writes types, and what columns are made of them; null alone is kept as text.
TYPES = {"OBJECT": "STRUCT", "VOID": "STRING"}
_token = re.compile(r"`(?:[^`]|``)*`|[A-Za-z_][\w]*|\d+|[<>:,()]|\S")


def merged_schema(rows: DataFrame, column: str) -> str:
    """The schema that all values of a variant column agree on, as text; VARIANT where they don't. It doesn't depend on the order of rows."""
    return rows.agg(F.schema_of_variant_agg(column).alias("schema")).first().schema


def fields_of(schema: str) -> dict[str, str]:
    """Keys of a merged object schema and their types as Spark writes them, in order; none for what is no object."""
    parts, found, at = _token.findall(schema), {}, 2
    if parts[:2] != ["OBJECT", "<"]:
        return found
    while at < len(parts) and parts[at] != ">":
        key = parts[at][1:-1].replace("``", "`") if parts[at].startswith("`") else parts[at]
        begin, depth = at + 2, 0
        at = begin
        while depth or parts[at] not in (",", ">"):
            depth += (parts[at] in "<(") - (parts[at] in ">)")
            at += 1
        found[key] = _type(parts[begin:at])
        at += parts[at] == ","
    return found


def _type(parts: list[str]) -> str:
    kind = "".join(f" {p} " if p in TYPES else p for p in parts)
    return re.sub(r" (\w+) ", lambda m: TYPES[m[1]], kind)


def shaped(rows: DataFrame, column: str, schema: str | None = None) -> DataFrame:
    """``rows`` with a struct ``typed`` in place of a variant column, a field for each key of the merged schema, and ``rest``.

    A value that a field's type can't give back as it was, such as JSON's null, an object that lacks some of its keys, or
    digits of another scale, stands in ``rest`` too, a map of keys to JSON; so does all of a value that is no object, under
    the key ``$``. So every value can be had again, see ``restored``.
    ``schema`` comes from ``merged_schema``, of the objects among these rows if it isn't given; rows found later may have other keys, which
    go to ``rest``. A null column gives nulls and an empty rest.
    """
    v = F.col(column)
    fields = fields_of(merged_schema(rows.filter(F.schema_of_variant(column).startswith("OBJECT")), column) if schema is None else schema)
    # By the map of its keys, as a path can't name every key.
    whole = v.try_cast("map<string, variant>")
    held = {k: F.element_at(whole, k).try_cast(t) for k, t in fields.items()}
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    entries = F.when(is_object, F.map_entries(whole)).otherwise(F.array().cast("array<struct<key:string,value:variant>>"))
    kept = F.array(*[F.struct(F.lit(k).alias("key"), _json(x, fields[k]).alias("json")) for k, x in held.items()]) if held else F.array().cast("array<struct<key:string,json:string>>")
    known = F.map_from_entries(kept)
    odd = F.filter(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("json"))), lambda e: (e["json"] == "null") | ~F.coalesce(F.element_at(known, e["key"]) == e["json"], F.lit(False)))
    other = F.array(F.struct(F.lit("$").alias("key"), F.to_json(v).alias("json")))
    rest = F.map_from_entries(F.when(v.isNull(), F.array().cast("array<struct<key:string,json:string>>")).when(is_object, odd).otherwise(other))
    typed = F.when(v.isNotNull(), F.struct(*[x.alias(k) for k, x in held.items()]))
    names = [c for c in rows.columns if c != column]
    return rows.select(*names, typed.alias("typed"), rest.alias("rest"))


def _json(x: Column, kind: str) -> Column:
    """A typed value as the JSON that its variant is written as."""
    if kind.startswith(("STRUCT", "ARRAY")) or kind == "VARIANT":
        return F.to_json(x if kind == "VARIANT" else F.to_variant_object(x))
    return F.to_json(F.to_variant_object(F.array(x))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(x)))) - 2)


def restored(rows: DataFrame) -> DataFrame:
    """What ``shaped`` has taken apart, as the column ``json``: whole values, keys in their order; null for null."""
    fields = rows.schema["typed"].dataType.fields
    kinds = {f.name: f.dataType.simpleString().upper() for f in fields}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), _json(F.col("typed")[k], t).alias("json")) for k, t in kinds.items()]) if kinds else F.array().cast("array<struct<key:string,json:string>>")
    given = F.filter(entries, lambda e: e["json"].isNotNull() & (e["json"] != "null") & ~F.map_contains_key(F.col("rest"), e["key"]))
    both = F.array_sort(F.concat(given, F.transform(F.map_entries("rest"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("json")))))
    quoted = lambda e: F.concat(F.to_json(F.to_variant_object(F.array(e["key"]))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(e["key"])))) - 2), F.lit(":"), e["json"])
    text = F.concat(F.lit("{"), F.array_join(F.transform(both, quoted), ","), F.lit("}"))
    return rows.withColumn("json", F.when(F.col("typed").isNull(), F.lit(None)).otherwise(F.coalesce(F.element_at("rest", "$"), text)))
