"""Seeded choices: question modes, seed questions, turn counts, personas. All follow from md5 of seed and keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.tables import numbered, small
from parlance.functions.text import question_hash, uniform

#: Chances of followup, adjacent, fresh and off_topic questions, up to the second turn and after it.
EARLY = (("followup", 0.70), ("adjacent", 0.20), ("fresh", 0.08), ("off_topic", 0.02))
LATE = (("followup", 0.45), ("adjacent", 0.30), ("fresh", 0.23), ("off_topic", 0.02))


def question_mode(turn: Column, has_seed: Column, has_answer: Column, u: Column) -> Column:
    """How the next question is found: seeded on a seeded first turn, fresh before any answer, else by chance."""

    def drawn(chances: tuple[tuple[str, float], ...]) -> Column:
        total, out = 0.0, None
        for mode, chance in chances:
            total += chance
            out = F.when(u <= total, mode) if out is None else out.when(u <= total, mode)
        return out.otherwise("fresh")

    return F.when((turn == 1) & has_seed, "seeded").when(~has_answer, "fresh").when(turn <= 2, drawn(EARLY)).otherwise(drawn(LATE))


def turn_count(u: Column, low: int, high: int, *, distribution: str = "poisson", mean: float | None = None) -> Column:
    """Turns of a conversation by inverse transform of ``u``, held in [low, high]; the mean is by default the middle."""
    if low > high:
        raise ValueError("the least number of turns exceeds the greatest")
    mean = (low + high) / 2 if mean is None else mean
    if distribution == "uniform":
        drawn = low + F.floor(u * (high - low + 1))
    elif distribution in ("exponential", "exp"):
        drawn = F.bround(-F.log(1 - u) * mean)
    elif distribution in ("poisson", "pois"):
        # Steps of the cumulative chances up to where the bound cuts off.
        p = total = math.exp(-mean)
        drawn = F.when(u <= total, 0)
        for k in range(1, high + 1):
            p *= mean / k
            total += p
            drawn = drawn.when(u <= total, k)
        drawn = drawn.otherwise(high)
    else:
        raise ValueError(f"no such distribution: {distribution}")
    return F.least(F.lit(high), F.greatest(F.lit(low), drawn)).cast("int")


def assign_personas(slots: DataFrame, personas: DataFrame, *, seed: int = 0) -> DataFrame:
    """A persona for each slot so that all are used equally: slot i takes place i mod n of the i div n-th shuffle.

    ``slots`` has slot from 0, ``personas`` an id and is a small dimension; without personas the id is null.
    """
    n = personas.count()
    if not n:
        return slots.withColumn("persona_id", F.lit(None).cast("string"))
    cycles = slots.select(F.expr(f"slot div {n}").cast("long").alias("cycle")).distinct()
    order = W.partitionBy("cycle").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cycle").cast("string"), "persona_id")), "persona_id")
    # Each cycle has all personas: as many rows as there are slots, and a cycle more.
    pool = cycles.join(small(personas.select(F.col("id").alias("persona_id")))).withColumn("place", F.row_number().over(order) - 1)
    keyed = slots.withColumns({"cycle": F.expr(f"slot div {n}").cast("long"), "place": F.expr(f"cast(slot % {n} as int)")})
    return keyed.join(pool, ["cycle", "place"], "left").drop("cycle", "place")


def seed_question(seeds: DataFrame, ledger: DataFrame, slots: DataFrame, *, seed: int = 0, probability: float = 1.0) -> DataFrame:
    """For each slot a seed question not used yet, of the least used topics, chosen by hash; none if its draw fails.

    ``seeds`` has topic and question, ``ledger`` seed_topic and seed_question_hash, ``slots`` slot.
    """
    hashed = seeds.withColumn("seed_question_hash", question_hash(F.col("question")))
    left = hashed.join(ledger.select("seed_question_hash").distinct(), "seed_question_hash", "left_anti")
    used = ledger.filter("seed_topic <> ''").groupBy(F.col("seed_topic").alias("topic")).agg(F.count("*").alias("used"))
    eligible = left.join(used, "topic", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    least = eligible.agg(F.min("used").alias("least"))
    eligible = eligible.join(F.broadcast(least)).filter("used = least").drop("used", "least")
    # Eligible questions are numbered in an order fixed by the seed; each slot's draw picks a number.
    eligible = eligible.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(str(seed)), "seed_question_hash")))
    listed = numbered(eligible, F.substring("order_key", 1, 3), "order_key", "topic", "question").drop("order_key")
    n = eligible.agg(F.count("*").alias("n"))
    asks = slots.filter(uniform(F.col("slot"), seed=f"{seed}-p") <= probability).join(F.broadcast(n))
    asks = asks.withColumn("place", F.floor(uniform(F.col("slot"), seed=f"{seed}-q") * F.col("n")).cast("int"))
    return asks.join(listed, "place").drop("place", "n")


#: Modes whose snippets are searched for, and which text is asked.
SEARCHED = ("seeded", "followup", "adjacent")


def snippet_queries(slots: DataFrame) -> DataFrame:
    """What is searched for each slot (slot, mode, seed_query, last_assistant): slot and query; none for other modes and blank texts."""
    last = F.coalesce(F.nullif("last_assistant", F.lit("")), F.col("seed_query"))
    query = F.when(F.col("mode") == "seeded", F.col("seed_query")).when(F.col("mode").isin("followup", "adjacent"), last)
    return slots.select("slot", query.alias("query")).filter("query <> ''")


def draws(slots: DataFrame, chunks: DataFrame, n: int, *, seed: int = 0) -> DataFrame:
    """For each slot ``n`` different chunks (id and other columns) with their rank, all chunks alike in chance.

    Chunks lie in a row by the hash of seed and id; a slot takes those from a place on that its own hash names, round
    the end. So slots meet their chunks by place, in one join.
    """
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    laid = numbered(chunks.withColumn("_hash", hashed), F.substring("_hash", 1, 2), "_hash", "id").drop("_hash")
    count = laid.agg(F.count("*").alias("_n"))
    first = slots.select("slot").join(F.broadcast(count)).filter("_n > 0").withColumn("_at", F.floor(uniform(F.col("slot"), seed=f"{seed}-draw") * F.col("_n")).cast("long"))
    asked = first.withColumn("rank", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), F.col("_n").cast("int"))))).withColumn("place", (F.col("_at") + F.col("rank") - 1) % F.col("_n"))
    return asked.join(laid, "place").drop("place", "_n", "_at")


def snippet_cascade(
    slots: DataFrame, found: DataFrame, chunks: DataFrame, used: DataFrame, preferred: DataFrame, *, n: int = 6, drawn: int = 8, seed: int = 0, search: str = "slot"
) -> DataFrame:
    """Snippets of each slot: what its search found, less used chunks, of preferred sources if any is among them; else
    chunks drawn from preferred sources; else chunks drawn from all. Adds ``way`` (0, 1 or 2); the first ``n`` of each.

    ``slots`` has slot and mode, ``found`` slot, rank and the columns of ``chunks`` (id, source), ``used`` id, and
    ``preferred`` source, see ``retrieval.effective_preference``. Slots of other modes than SEARCHED have no search.
    Slots that share a search name it in a column ``search``, which ``found`` has instead of slot: what it found is
    chosen from once, and only the first ``n`` go to its slots.
    """
    searched = slots.filter(F.col("mode").isin(*SEARCHED)).select("slot", *({search} - {"slot"}))
    hits = found.join(searched, search, "left_semi").join(used.select("id").distinct(), "id", "left_anti")
    marks = small(preferred.select("source").distinct().withColumn("_wanted", F.lit(True)))
    hits = hits.join(marks, "source", "left").withColumn("_wanted", F.coalesce("_wanted", F.lit(False)))
    # The first n of either kind, which each task keeps of its own before the shuffle; more can't be used.
    hits = hits.withColumn("_n", F.row_number().over(W.partitionBy(search, "_wanted").orderBy("rank", "id"))).filter(F.col("_n") <= n)
    hits = hits.withColumn("_some", F.max("_wanted").over(W.partitionBy(search))).filter("_wanted OR NOT _some").drop("_wanted", "_some", "_n")
    if search != "slot":
        hits = hits.join(searched, search).drop(search)
    free = chunks.join(used.select("id").distinct(), "id", "left_anti")
    names = ["slot", "rank", *chunks.columns]
    left = slots.select("slot").join(hits.select("slot").distinct(), "slot", "left_anti")
    near = draws(left, free.join(marks, "source", "left_semi"), drawn, seed=seed)
    rest = draws(left.join(near.select("slot").distinct(), "slot", "left_anti"), free, drawn, seed=seed)
    tries = [df.select(*names).withColumn("way", F.lit(k)) for k, df in enumerate((hits, near, rest))]
    out = tries[0].unionByName(tries[1]).unionByName(tries[2])
    return out.withColumn("_n", F.row_number().over(W.partitionBy("slot").orderBy("rank", "id"))).filter(F.col("_n") <= n).drop("_n")


def snippets(tries: list[DataFrame], n: int = 6) -> DataFrame:
    """For each slot the results of the first way that found any, the first ``n``: each table has slot, rank and the result.

    Every task keeps its own first ``n`` of a slot, earlier ways first, before the shuffle; what later ways have among
    the ``n`` kept goes afterwards. So a slot with very many results moves few.
    """
    out = None
    for way, df in enumerate(tries):
        df = df.withColumn("way", F.lit(way))
        out = df if out is None else out.unionByName(df)
    kept = out.withColumn("n", F.row_number().over(W.partitionBy("slot").orderBy("way", "rank", "id"))).filter(F.col("n") <= n)
    return kept.withColumn("first", F.min("way").over(W.partitionBy("slot"))).filter("way = first").drop("first", "n", "way")


def plan_waves(total: int, batch: int, languages: list[str], done: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """Waves (language, number, size) until every language has ``total``; a batch without size is an error."""
    if batch < 1:
        raise ValueError("a wave makes no progress")
    out = []
    for language in languages:
        have, wave = (done or {}).get(language, 0), 0
        while have < total:
            size = min(batch, total - have)
            out.append((language, wave, size))
            have, wave = have + size, wave + 1
    return out
