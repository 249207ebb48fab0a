"""How far sources are used: counts, ratios, pools, recent questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.tables import numbered
from parlance.functions.text import question_hash, utc_text

RECENT, LEDGER_LINES, SNIPPETS, SNIPPET_RECENT = 8, 2000, 6, 5


def ledger_source() -> Column:
    """The source of a ledger row; older rows have it in another column. Blank counts as none."""
    return F.coalesce(F.nullif("source_path", F.lit("")), F.nullif("source", F.lit("")))


def usage(ledger: DataFrame) -> DataFrame:
    """Ledger rows of each source: source, usage."""
    return ledger.select(ledger_source().alias("source")).filter("source is not null").groupBy("source").agg(F.count("*").alias("usage"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"))


def coverage_ratio(chunk_count: DataFrame, used: DataFrame) -> DataFrame:
    """Uses for each chunk of a source: source, chunks, usage, ratio. A source without uses has 0, one without chunks counts as 1."""
    both = chunk_count.join(used, "source", "left").withColumn("usage", F.coalesce("usage", F.lit(0)).cast("long"))
    return both.withColumn("ratio", F.col("usage") / F.greatest(F.col("chunks"), F.lit(1)))


def least_covered(ratios: DataFrame, fraction: float) -> DataFrame:
    """The given share of sources with the least ratio, one at least, by name where they tie; the share is held in [0.05, 1]."""
    fraction = min(1.0, max(0.05, fraction))
    n = ratios.agg(F.count("*").alias("n"))
    # Sources are numbered within stretches of the ratio, a thousandth each, so no task ranks them all.
    stretch = F.floor(F.least(F.col("ratio"), F.lit(1e6)) * 1000)
    ranked = numbered(ratios, stretch, "ratio", "source").withColumn("place", (F.col("place") + 1).cast("int")).join(F.broadcast(n))
    return ranked.filter(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") * fraction))).drop("n")


def source_pool(ratios: DataFrame, *, balance: bool, draw: float, epsilon: float = 0.15, fraction: float = 0.25) -> DataFrame:
    """Sources to draw from: all if balancing is off or ``draw`` is under ``epsilon``; else the unused; else the least covered."""
    if not balance or draw < epsilon:
        return ratios.select("source")
    unused = ratios.filter("usage = 0").select("source")
    least = least_covered(ratios, fraction).select("source")
    some = ratios.agg(F.max((F.col("usage") == 0).cast("int")).alias("some"))
    return unused.unionByName(least.join(F.broadcast(some.filter("some = 0")), how="inner").select("source"))


def recent_per_source(ledger: DataFrame, n: int = RECENT) -> DataFrame:
    """The last ``n`` questions of each source, oldest first: source, questions. ``seq`` is the ledger's order."""
    rows = ledger.select(ledger_source().alias("source"), "question", "seq").filter("source is not null and question <> ''")
    last = rows.withColumn("back", F.row_number().over(W.partitionBy("source").orderBy(F.desc("seq")))).filter(F.col("back") <= n)
    kept = F.array_sort(F.collect_list(F.struct("seq", "question")))
    return last.groupBy("source").agg(F.transform(kept, lambda x: x["question"]).alias("questions"))


def question_hashes(ledger: DataFrame) -> DataFrame:
    """Distinct question hashes of each source, one a row."""
    return ledger.select(ledger_source().alias("source"), question_hash(F.col("question")).alias("question_hash")).filter("source is not null").distinct()


def ledger_tail(lines: DataFrame, n: int = LEDGER_LINES) -> DataFrame:
    """The last ``n`` physical lines of a ledger, then without blank ones: ``lines`` has seq and value."""
    return lines.orderBy(F.desc("seq")).limit(n).filter(F.trim("value") != "")


def recent_questions(ledger_recent: Column, own: Column, n: int = 10) -> Column:
    """The ledger's recent questions followed by the conversation's own, the last ``n`` of them."""
    both = F.concat(ledger_recent, own)
    return F.slice(both, F.greatest(F.lit(1), F.size(both) - n + 1), n)


def topic_snippets(candidates: DataFrame, recent: DataFrame) -> DataFrame:
    """Each slot's first candidates with the last questions asked of their sources."""
    top = candidates.filter(F.col("rank") <= SNIPPETS)
    last = F.slice("questions", F.greatest(F.lit(1), F.size("questions") - SNIPPET_RECENT + 1), SNIPPET_RECENT)
    return top.join(recent.select("source", last.alias("recent_questions")), "source", "left").withColumn(
        "recent_questions", F.coalesce("recent_questions", F.array().cast("array<string>"))
    )


def resolve_source(slots: DataFrame, snippets: DataFrame) -> DataFrame:
    """The source path of each slot's topic through the first snippet with its id; its descriptor, else blank, where there is none."""
    first = snippets.groupBy("slot", "topic_id").agg(F.min_by(F.struct("source_path", "source_descriptor"), "rank").alias("found"))
    return slots.join(first, ["slot", "topic_id"], "left").withColumn(
        "source_path", F.coalesce(F.nullif("found.source_path", F.lit("")), "found.source_descriptor", F.lit(""))
    ).drop("found")


def ledger_rows(accepted: DataFrame) -> DataFrame:
    """Rows to append to the ledger: those with a question, hashed."""
    asked = accepted.filter(F.trim(F.coalesce("question", F.lit(""))) != "")
    return asked.withColumn("question_hash", question_hash(F.col("question"))).withColumn(
        "timestamp", utc_text(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))
    )
