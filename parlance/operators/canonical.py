"""Ragged reasoning traces brought into one fixed nested schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import is_object, strict_variant, strip


#: The entries of a reasoning trace, and of a turn that is read.
TRACE_KEYS = ("question", "retrieval_queries", "evidence", "premises", "thinking", "confidence", "known_limits")
TURN_KEYS = ("turn_index", "assistant_message", "did_web_search", "reasoning_trace")


def kind_of(v: Column) -> Column:
    """OBJECT, ARRAY, or the name of a scalar's type; null for null."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def text_of(v: Column) -> Column:
    """A scalar as text, true and false in lower case; blank for null, JSON text for the rest."""
    kind = kind_of(v)
    return F.when(v.isNull() | kind.isin("VOID", ""), "").when(kind.isin("OBJECT", "ARRAY"), F.to_json(v)).otherwise(F.coalesce(v.cast("string"), F.lit("")))


def items_of(v: Column) -> Column:
    """The entries of a JSON array as variants; anything else but null is its one entry."""
    kind = kind_of(v)
    return F.when(kind == "ARRAY", v.cast("array<variant>")).when(v.isNull() | (kind == "VOID"), F.array().cast("array<variant>")).otherwise(F.array(v))


def list_of(v: Column) -> Column:
    """An array's texts that are neither null nor blank, untrimmed."""
    return F.filter(F.transform(items_of(v), text_of), lambda x: strip(x) != "")


def first_text(v: Column, *names: str) -> Column:
    """The first of the named entries that isn't blank, untrimmed; blank if all are."""
    found = [F.when(strip(text_of(get(v, f"$.{n}"))) != "", text_of(get(v, f"$.{n}"))) for n in names]
    return F.coalesce(*found, F.lit(""))


def retrieval_queries(v: Column) -> Column:
    return F.struct(list_of(get(v, "$.vector_db_search")).alias("vector_db_search"), list_of(get(v, "$.web_search")).alias("web_search"))


def evidence(v: Column) -> Column:
    """Entries as (id, cue, content); a scalar is content."""
    return F.transform(
        items_of(v),
        lambda e: F.struct(
            F.when(is_object(e), first_text(e, "id")).otherwise("").alias("id"),
            F.when(is_object(e), first_text(e, "cue")).otherwise("").alias("cue"),
            F.when(is_object(e), first_text(e, "content")).otherwise(text_of(e)).alias("content"),
        ),
    )


def premises(v: Column) -> Column:
    """Entries as (id, text, evidence_refs, assumption); a scalar is text; notes stand in for a missing assumption."""
    return F.transform(
        items_of(v),
        lambda e: F.struct(
            F.when(is_object(e), first_text(e, "id")).otherwise("").alias("id"),
            F.when(is_object(e), first_text(e, "text")).otherwise(text_of(e)).alias("text"),
            F.when(is_object(e), list_of(get(e, "$.evidence_refs"))).otherwise(F.array().cast("array<string>")).alias("evidence_refs"),
            F.when(is_object(e), first_text(e, "assumption", "note", "text_note")).otherwise("").alias("assumption"),
        ),
    )


def thinking(v: Column) -> Column:
    """Entries as (text): the text, else the first entry that may stand for it; a scalar is text, null a blank one."""
    return F.transform(
        items_of(v),
        lambda e: F.struct(
            F.when(is_object(e), first_text(e, "text", "assumption", "text_is_assumption", "note", "content", "thought")).otherwise(text_of(e)).alias("text")
        ),
    )


def trace(v: Column) -> Column:
    """The seven entries of a reasoning trace, each there and of one type; null unless ``v`` is an object."""
    return F.when(
        is_object(v),
        F.struct(
            text_of(get(v, "$.question")).alias("question"),
            retrieval_queries(get(v, "$.retrieval_queries")).alias("retrieval_queries"),
            evidence(get(v, "$.evidence")).alias("evidence"),
            premises(get(v, "$.premises")).alias("premises"),
            thinking(get(v, "$.thinking")).alias("thinking"),
            text_of(get(v, "$.confidence")).alias("confidence"),
            list_of(get(v, "$.known_limits")).alias("known_limits"),
            others(v, TRACE_KEYS).alias("extras"),
        ),
    )


def others(v: Column, known: tuple[str, ...]) -> Column:
    """The entries of an object but the known ones, as JSON texts by name."""
    rest = F.map_filter(F.when(is_object(v), v.cast("map<string,variant>")), lambda k, _: ~k.isin(*known))
    return F.transform_values(rest, lambda _, x: F.to_json(x))


def sanitize(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """Adds to raw JSON lines their canonical assistant_reasoning; ``parsed`` tells lines that are objects, the others stay as they are."""
    row = strict_variant(F.col(value))
    turns = F.transform(
        items_of(get(row, "$.assistant_reasoning")),
        lambda t: F.struct(
            get(t, "$.turn_index", "int").alias("turn_index"),
            text_of(get(t, "$.assistant_message")).alias("assistant_message"),
            get(t, "$.did_web_search", "boolean").alias("did_web_search"),
            trace(get(t, "$.reasoning_trace")).alias("reasoning_trace"),
            others(t, TURN_KEYS).alias("extras"),
        ),
    )
    return lines.withColumn("parsed", is_object(row)).withColumn("assistant_reasoning", F.when(F.col("parsed"), turns))


def sanitized_lines(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """JSON lines with the traces in their assistant_reasoning made canonical, other entries and other lines as they are."""
    row = strict_variant(F.col(value))
    turns = get(row, "$.assistant_reasoning")
    merged = lambda v, name, made: F.to_json(F.map_concat(F.map_filter(v.cast("map<string,variant>"), lambda k, _: k != name), F.create_map(F.lit(name), F.parse_json(made))))

    def whole(t: Column) -> Column:
        held = get(t, "$.reasoning_trace")
        made = trace(held)
        rest = F.map_filter(held.cast("map<string,variant>"), lambda k, _: ~k.isin(*TRACE_KEYS))
        fixed = F.from_json(F.to_json(made.dropFields("extras")), "map<string,string>")
        parts = F.transform_values(fixed, lambda k, x: F.when(k.isin("question", "confidence"), F.parse_json(F.to_json(F.array(x)))).otherwise(F.parse_json(x)))
        parts = F.transform_values(parts, lambda k, x: F.when(k.isin("question", "confidence"), get(x, "$[0]")).otherwise(x))
        return F.when(is_object(held), merged(t, "reasoning_trace", F.to_json(F.map_concat(parts, rest)))).otherwise(F.to_json(t))

    listed = F.concat(F.lit("["), F.array_join(F.transform(items_of(turns), whole), ","), F.lit("]"))
    touched = is_object(row) & (kind_of(turns) == "ARRAY")
    return lines.withColumn(value, F.when(touched, merged(row, "assistant_reasoning", listed)).otherwise(F.col(value)))


def lenient_float(v: Column) -> Column:
    """Numbers and numeric texts as doubles; booleans and the rest as null."""
    return F.when(kind_of(v) == "BOOLEAN", None).when(kind_of(v).isin("OBJECT", "ARRAY"), None).otherwise(v.cast("string").try_cast("double"))


#: Single words that models write in place of a query, naming a language or region.
PLACEHOLDERS = (
    "ar", "en", "fr", "english", "french", "arabic", "morocco", "moroccan", "egypt", "egyptian", "levantine", "uae", "gulf", "saudi",
)


def clean_queries(queries: Column) -> Column:
    """Queries trimmed; without blanks, single-word placeholders, and single words of two characters or fewer."""
    trimmed = F.transform(F.filter(queries, lambda q: q.isNotNull()), lambda q: strip(q))
    return F.filter(trimmed, lambda q: (q != "") & (q.contains(" ") | ((F.length(q) > 2) & ~F.lower(q).isin(*PLACEHOLDERS))))
