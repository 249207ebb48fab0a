"""Scalar functions on text columns: white space, normal forms, counts, lenient parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a run of the characters that count as white space in Unicode, which \\s alone doesn't cover.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
FENCE = "```"
#: Letters whose upper case is several characters, but that have one of a single character as well; others of that kind stay.
LONG_UPPER = {"ß": "ẞ"} | {c: c.title() for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > 1 and len(c.title()) == 1}
#: Words that stand for true and for false in settings.
TRUE_WORDS = ("1", "true", "yes", "on")
FALSE_WORDS = ("0", "false", "no", "off", "")


def collapse(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, WS, " "))


def strip(x: Column) -> Column:
    """``x`` without white space at its ends."""
    return F.regexp_replace(x, f"^{WS}|{WS}$", "")


def simple_upper(x: Column) -> Column:
    """``x`` in upper case, one character for each, as SQL engines do that map code points; so places in ``x`` stay."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, "".join(LONG_UPPER), "".join(LONG_UPPER.values())))
    each = F.array_join(F.transform(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), one), "")
    return F.when(F.length(F.upper(x)) == F.length(x), F.upper(x)).otherwise(each)


def normalize_question(x: Column) -> Column:
    """The form in which questions count as equal: lower case, white space collapsed; null stays null."""
    return collapse(F.lower(x))


def text_hash(x: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(x, 256), 1, 16)


def question_hash(x: Column) -> Column:
    return text_hash(normalize_question(x))


def word_count(x: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    flat = collapse(x)
    return F.when(flat.isNull() | (flat == ""), 0).otherwise(F.size(F.split(flat, " "))).cast("long")


def token_estimate(x: Column) -> Column:
    """A quarter of the stripped text's characters, rounded up; 0 for null and blank."""
    n = F.length(strip(x))
    return F.when(n.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("long")


def strip_code_fences(x: Column) -> Column:
    """``x`` without the lines that begin with a code fence."""
    lines = F.filter(F.split(strip(x), r"\R"), lambda line: ~strip(line).startswith(FENCE))
    return strip(F.array_join(lines, "\n"))


def outer_object(x: Column) -> Column:
    """From the first opening to the last closing brace; null if there are none in that order."""
    first, last = F.locate("{", x), F.length(x) - F.locate("}", F.reverse(x)) + 1
    return F.when((first > 0) & (F.locate("}", x) > 0) & (last > first), F.substring(x, first, last - first + 1))


def strict_variant(x: Column) -> Column:
    """``x`` as a variant if the whole of it is one JSON value, else null: the value must be alone in an array with an end mark."""
    held = F.try_parse_json(F.concat(F.lit("["), x, F.lit(',"~end~"]')))
    alone = (F.try_variant_get(held, "$[1]", "string") == "~end~") & F.try_variant_get(held, "$[2]", "variant").isNull()
    return F.when(alone, F.try_variant_get(held, "$[0]", "variant"))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def parse_object(x: Column) -> Column:
    """A JSON object as a variant: the text itself, else what its outermost braces hold once fences are gone; else null.

    A text that is JSON but no object gives null without a second attempt.
    """
    direct = strict_variant(strip(x))
    inner = strict_variant(outer_object(strip_code_fences(x)))
    return F.when(direct.isNotNull(), F.when(is_object(direct), direct)).otherwise(F.when(is_object(inner), inner))


def as_bool(x: Column, default: bool = False) -> Column:
    """Words for true and false; anything else is ``default``."""
    word = F.lower(strip(x.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(default)


def as_text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def compact_list(x: Column) -> Column:
    """The entries of a text array that are neither null nor blank, as they are; an empty array for null."""
    return F.coalesce(F.filter(x, lambda e: e.isNotNull() & (strip(e) != "")), F.array().cast("array<string>"))


def clamp(x: Column, low: float, high: float, default: float) -> Column:
    """A lenient number within bounds; ``default`` if it is none."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x.try_cast("double"), F.lit(default))))


def language_tag(x: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one dash, none at the ends; ``lang`` if nothing is left."""
    dashed = F.regexp_replace(F.lower(strip(x)), r"[^\p{L}\p{N}]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(trimmed.isNull() | (trimmed == ""), "lang").otherwise(trimmed)


def text_quality(x: Column) -> Column:
    """Share of letters among the characters."""
    return F.length(F.regexp_replace(x, r"[^\p{L}]", "")) / F.greatest(F.length(x), F.lit(1))


def better_text(first: Column, second: Column) -> Column:
    """Of two readings of a page the one with the larger share of letters; the longer one, then the first, if they tie."""
    a, b = F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))
    wins = (text_quality(b) > text_quality(a)) | ((text_quality(b) == text_quality(a)) & (F.length(b) > F.length(a)))
    return F.when(wins, b).otherwise(a)


def source_descriptor(path: Column, chunk: Column) -> Column:
    """File name and chunk number."""
    return F.concat(F.element_at(F.split(path, "/"), -1), F.lit("#chunk"), chunk.cast("string"))


def utc_text(ts: Column) -> Column:
    """A UTC time as ISO 8601 text with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def capitalized(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 30)))


def uniform(*cols: Column, seed: int | str = 0) -> Column:
    """A number in [0, 1) fixed by seed and columns, by MD5, so that any SQL engine finds the same."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
