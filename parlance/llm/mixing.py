"""Mixing of sources to target weights by Pareto order sampling, in DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save, small, unit

#: Bins of the Pareto rank; sums per source and bin find the bin in which a sample ends.
BINS = 65_536
WORD = r"[^\x20\x09-\x0D]+"
SEED = 6


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """Targets of the sources: ``sizes`` has source and source_size; adds weight and target.

    Sources in order of code point, null last, weigh ``weights`` in turn. They share ``share`` of all sizes by weight;
    a target stops at ``most`` times its source's size, and the excess is shared again. All are below their cap at the
    level where the sum of min(cap, level * weight) is the whole: sorted by cap over weight, the capped ones come first.
    """
    every = W.partitionBy()
    turn = F.pmod(F.row_number().over(every.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1, F.lit(len(weights)))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    df = sizes.withColumn("weight", weigh).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    df = df.withColumn("all_words", F.sum("source_size").over(every) * F.lit(float(share)))
    order = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    df = df.withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", (F.col("all_words") - F.col("capped")) / F.col("open_weight"))
    # The level is that of the first source which, with all after it, stays within its cap.
    df = df.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"]
    df = df.withColumn("final", level)
    return df.select(
        "source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target")
    )


@dataclass
class Mix:
    """What decides on a row: its source's plan, where the source's sample ends, and the rows at that border that are in."""

    plan: DataFrame
    border: DataFrame
    winners: DataFrame
    seed: int

    def decide(self, rows: DataFrame) -> DataFrame:
        """``rows`` has id, source, size and key (a hash of the text), and whatever else it may carry; adds source_size, target and copies.

        The plan and the borders have a row for each source; the winners, rows of one bin for each source, are told by
        their own number u, which is as good as unique. All three are joined by broadcast, so ``rows`` stay where they are.
        """
        out = _ranked(rows.withColumn("u", number(F.col("id"), F.col("key"), self.seed)), self.plan)
        out = out.join(small(self.border), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        won = small(self.winners.select(F.col("source").alias("w_source"), F.col("u").alias("w_u"), F.lit(True).alias("won")))
        out = out.join(won, F.col("source").eqNullSafe(F.col("w_source")) & (F.col("u") == F.col("w_u")), "left")
        sampled = F.col("border").isNull() | (F.col("bin") < F.col("border")) | ((F.col("bin") == F.col("border")) & F.col("won").isNotNull())
        extra = F.when(F.col("certain") | (F.col("rank").isNotNull() & sampled), 1).otherwise(0)
        return out.withColumn("copies", (F.col("sure") + extra).cast("int")).drop(
            "u", "weight", "sure", "part", "level", "rest", "certain", "rank", "bin", "border", "start", "w_source", "w_u", "won"
        )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    return F.coalesce(F.md5(text.cast("binary")), F.lit("~"))


def number(id_: Column, key: Column, seed: int) -> Column:
    """A row's own number in (0, 1), fixed by its id and text, so null and repeated ids are told apart by their texts."""
    return unit(id_, key, seed=seed)


def measure(size: Column) -> Column:
    """What a row's chance to be sampled grows with: the root of its size, rounded up. Whole, so that sums are exact."""
    return F.ceil(F.sqrt(size.cast("double"))).cast("long")


def plan_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    weights: tuple[int, ...] = (5, 2, 1),
    most: float = 2.0,
    seed: int = SEED,
) -> Mix:
    """Targets of the sources, chances of their rows and the borders of their samples.

    A source whose target is c whole times its size and a part besides takes each row c times for certain. The part's
    words come from a Pareto order sample: a row's chance is a level times its measure, where the level makes the
    expected words those of the part, and rows whose chance would exceed 1 are certain, too. The others are ranked by
    u / (1 - u) over chance / (1 - chance), u being the row's own number, and taken in that order up to the words that
    are left: the sample's size is fixed in words, as targets are. The row at the border is in if that comes nearer.
    No row is taken in part, so a source misses its target by half of its border row's size at most; rows alike in
    source, id and text share u, count as one row, and are in or out together.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), text_key(F.col(text_col)).alias("key"))
    rows = save(rows.select("source", "size", number(F.col("id"), F.col("key"), seed).alias("u")), "rows")
    # A row for each source and measure, that is for each root of a size.
    classes = save(rows.groupBy("source", measure(F.col("size")).alias("x")).agg(F.sum("size").alias("words")), "classes")
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = save(
        source_targets(sources, share, weights, most)
        .withColumn("sure", F.floor(ratio).cast("long"))
        .withColumn("part", F.greatest(F.lit(0.0), F.col("target") - F.col("sure") * F.col("source_size"))),
        "targets",
    )
    plan = save(_levels(targets, classes), "plan")
    keyed = _ranked(rows, plan)
    # Of each source, the bin whose words reach over what is left of the part: at most BINS rows a source go in.
    binned = keyed.filter("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("bin"))
    border = save(
        binned.withColumn("end", upto)
        .withColumn("start", F.col("end") - F.col("words"))
        .filter((F.col("start") <= F.col("rest")) & (F.col("end") > F.col("rest")))
        .select(F.col("source").alias("s"), F.col("bin").alias("border"), "start"),
        "border",
    )
    at = keyed.join(small(border), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("border")))
    alike = at.groupBy("source", "rank", "u", "size", "rest", "start").agg((F.count("*") * F.col("size")).alias("words"))
    w = W.partitionBy("source").orderBy("rank", "u", "size").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("start") + F.coalesce(F.sum("words").over(w), F.lit(0))
    winners = save(alike.withColumn("ahead", ahead).filter(2 * F.col("ahead") + F.col("words") <= 2 * F.col("rest")).select("source", "u"), "winners")
    return Mix(plan, border, winners, seed)


def _levels(targets: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds to the sources' targets ``level``, the chance for each unit of measure, and ``rest``, the part's words less those of certain rows.

    From the largest measure down: if all above are certain, the level spreads the words left over the rest in
    proportion to measure times words. The first measure whose chance is below 1 at its level gives the source's level.
    """
    named = classes.join(small(targets.select(F.col("source").alias("s"), "part")), F.col("source").eqNullSafe(F.col("s")))
    down = W.partitionBy("source").orderBy(F.desc("x"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum(F.col("x").cast("decimal(20,0)") * F.col("words").cast("decimal(18,0)")).over(down.rowsBetween(0, W.unboundedFollowing)).cast("double")
    rest = F.col("part") - above
    found = named.filter("x > 0 and part > 0").withColumn("rest", rest).withColumn("level", F.col("rest") / weight)
    found = found.filter("level * x < 1").groupBy("source").agg(F.max(F.struct("x", "level", "rest")).alias("at"))
    found = found.select(F.col("source").alias("s"), F.col("at.level").alias("level"), F.col("at.rest").alias("rest"))
    return targets.join(small(found), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """How many words of every row the mix takes, repeats counted; see ``plan_mix`` for the options.

    Returns id, source, size, source_size, target, copies, taken. Null texts and empty ones have size 0 and are never
    sampled; a null source is a source of its own; rows with equal or null ids are told apart by their texts. An empty
    table gives no rows. Reruns agree, as nothing depends on the partitioning. Other columns are not read.
    """
    made = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    text = F.col(text_col)
    out = made.decide(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), text_key(text).alias("key")))
    out = out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.col("copies").cast("long").alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix: each row of ``docs``, with its columns, as many times as the mix takes it."""
    made = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    text = F.col(text_col)
    row = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), text_key(text).alias("key"), F.struct("*").alias("row"))
    return made.decide(row).select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies")))).select("row.*")


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan of each row's source, whether the sample has the row for certain, else its Pareto rank, null where it has no chance, and the rank's bin."""
    out = rows.join(small(plan).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    chance = F.col("level") * measure(F.col("size"))
    odds = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
    out = out.withColumn("certain", F.coalesce(chance >= 1, F.lit(False)))
    return out.withColumn("rank", F.when((chance > 0) & (chance < 1), odds)).withColumn("bin", pareto_bin())


def pareto_bin() -> Column:
    """Bin of the rank, in its order: the rank over one plus itself lies between 0 and 1."""
    return F.when(F.col("rank").isNotNull(), F.least(F.lit(BINS - 1), F.floor(F.col("rank") / (1 + F.col("rank")) * BINS))).cast("int")
