"""Seed questions: layouts brought into one table, variants chosen."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "variant string, topic string, pos int, question string, place int"
DEFAULT = "english"
#: Variants of the languages that have one by default, names that tell a variant, keys that are no topic.
DEFAULT_VARIANTS = {"ar": "msa", "en": "english", "fr": "france"}
VARIANT_NAMES = ("english", "france", "msa", "morocco", "egypt", "gulf", "levantine", "saudi", "ar", "en", "fr", "arabic", "french")
META_KEYS = ("version", "aliases", "defaults", "variants", "topics", "final_fallback", "default_variant_by_target_language")


def is_topic_first(payload: dict) -> bool:
    """Whether a mapping goes from topics to variants, not the other way round: no key is known as metadata, under half
    of the keys are known names of variants, and every value is a mapping that holds a list."""
    names = [str(k).strip().lower() for k in payload]
    if not any(names) or set(names) & set(META_KEYS):
        return False
    nested = all(isinstance(v, dict) and any(isinstance(x, list) for x in v.values()) for v in payload.values())
    return nested and sum(n in VARIANT_NAMES for n in names) < 0.5 * sum(map(bool, names))


def seed_blocks(payload: dict) -> Iterator[tuple[str, str, int, list]]:
    """Lists of questions in a mapping of any layout: variant, topic, the list's place among those of its topic, questions.

    Variants with topics stand under ``variants`` or ``topics`` or alone; topics with variants, or with questions, stand
    alone. Names of variants are trimmed and lower-cased. Other keys of settings hold no questions.
    """
    held = next((payload[k] for k in ("variants", "topics") if isinstance(payload.get(k), dict)), None)
    rest = {k: v for k, v in payload.items() if str(k).strip().lower() not in META_KEYS}
    if held is None and is_topic_first(payload):
        nested = [(v, t, place, qs) for t, variants in rest.items() for place, (v, qs) in enumerate(variants.items())]
    elif held is None and not all(isinstance(v, dict) for v in rest.values()):
        nested = [(DEFAULT, t, 0, qs) for t, qs in rest.items()]
    else:
        nested = [(v, t, 0, qs) for v, topics in (held or rest).items() if isinstance(topics, dict) for t, qs in topics.items()]
    for v, t, place, qs in nested:
        if isinstance(qs, list):
            yield str(v).strip().lower(), str(t), place, qs


def seed_rows(payload: dict) -> list[tuple[str, str, int, str, int]]:
    """Rows (variant, topic, pos, question, place): what is no text, or blank, is left out, and so a topic without questions."""
    return [(v, t, k, q.strip(), place) for v, t, place, qs in seed_blocks(payload) for k, q in enumerate(qs) if isinstance(q, str) and q.strip()]


def seed_table(spark: SparkSession, payload: dict) -> DataFrame:
    """The rows of one mapping, see ``seed_rows``."""
    return spark.createDataFrame(seed_rows(payload), SCHEMA)


def seed_files(files: DataFrame, parse: Callable[[str], object] = json.loads) -> DataFrame:
    """The rows of many files (path, text), each a mapping of any layout: path and what ``seed_rows`` gives. Texts that ``parse`` refuses, or that are no mapping, have none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    payload = parse(text) if text else None
                except ValueError:
                    payload = None
                found += [(path, *r) for r in seed_rows(payload)] if isinstance(payload, dict) else []
            yield pd.DataFrame(found, columns=["path", "variant", "topic", "pos", "question", "place"])

    return files.select("path", "text").mapInPandas(rows, f"path string, {SCHEMA}")


def for_variant(seeds: DataFrame, variant: str, *, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each topic's questions in a variant: its own list, else the english one, else the first that the topic has.

    ``keys`` are columns that tell files apart. Topics whose layout puts variants first have one list in each variant.
    """
    wanted = F.lit(variant.strip().lower())
    rank = F.when(F.col("variant") == wanted, -2).when(F.col("variant") == DEFAULT, -1).otherwise(F.col("place"))
    best = F.min(rank).over(W.partitionBy(*keys, "topic"))
    return seeds.withColumn("_rank", rank).withColumn("_best", best).filter("_rank = _best").drop("_rank", "_best")


def pivot(seeds: DataFrame) -> DataFrame:
    """One row for each variant: its topics with their questions in order, as a map."""
    kept = F.array_sort(F.collect_list(F.struct("pos", "question")))
    topics = seeds.groupBy("variant", "topic").agg(F.transform(kept, lambda x: x["question"]).alias("questions"))
    entries = F.array_sort(F.collect_list(F.struct("topic", "questions")))
    return topics.groupBy("variant").agg(F.map_from_entries(entries).alias("topics")).orderBy("variant")


def summary(seeds: DataFrame, *keys: str) -> DataFrame:
    """Variants, topics and questions, of all or for each file that ``keys`` tell apart."""
    return seeds.groupBy(*keys).agg(F.countDistinct("variant").alias("variants"), F.countDistinct("topic").alias("topics"), F.count("*").alias("questions"))


@dataclass(frozen=True)
class Choices:
    """What a file says of its variants: their names, other names for them, the variant of each language, and the last resort."""

    variants: frozenset[str]
    aliases: Mapping[str, str]
    targets: Mapping[str, str]
    last: str = DEFAULT


def folded(mapping: object) -> dict[str, str]:
    """A mapping's entries trimmed and in lower case, those without key or value left out; none of what is no mapping."""
    pairs = [(str(k).strip().lower(), str(v).strip().lower()) for k, v in mapping.items()] if isinstance(mapping, dict) else []
    return {k: v for k, v in pairs if k and v}


def choices(payload: dict) -> Choices:
    """The choices of a file of variants; ``defaults`` may hold the languages' variants and the last resort, or they stand by themselves."""
    defaults = payload.get("defaults") if isinstance(payload.get("defaults"), dict) else {}
    targets = folded(defaults.get("by_target_language")) or folded(payload.get("default_variant_by_target_language"))
    named = [x.strip().lower() for x in (payload.get("final_fallback"), defaults.get("final_fallback")) if isinstance(x, str) and x.strip()]
    return Choices(frozenset(r[0] for r in seed_rows(payload)), folded(payload.get("aliases")), targets, next(iter(named), DEFAULT))


def resolve_variant(
    available: set[str], *, explicit: str = "", language: str = "", aliases: dict[str, str] | None = None, targets: dict[str, str] | None = None, file_default: str = ""
) -> str:
    """The first that exists of: the explicit name, its alias, the language's target or else its alias, the built-in
    default of the language, the file's own default, english; blank if none does. Case and outer blanks don't matter."""
    names, aliases, targets = {v.strip().lower() for v in available}, folded(aliases), folded(targets)
    explicit, language = explicit.strip().lower(), language.strip().lower()
    tries = (explicit, aliases.get(explicit), targets.get(language) or aliases.get(language), DEFAULT_VARIANTS.get(language), file_default.strip().lower(), DEFAULT)
    return next((v for v in tries if v and v in names), "")


def chosen_variant(payload: dict, *, explicit: str = "", language: str = "") -> str:
    """The variant of a file for a wish and a language, see ``resolve_variant``."""
    known = choices(payload)
    return resolve_variant(set(known.variants), explicit=explicit, language=language, aliases=dict(known.aliases), targets=dict(known.targets), file_default=known.last)
