"""What the trained scorers share: folds, the bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts (with ``label`` as an int) of at most ``per_class`` labelled rows of either class, those of least hash.

    ``keep`` says by id which labels may be learnt. Ids labelled twice count once, by the larger label; null labels
    and null texts are left out. Only ids are sorted; the texts stay where they are.
    """
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id", F.lit(11))
    picked = ids.filter("label = 1").orderBy(order, "doc_id").limit(per_class).unionByName(ids.filter("label = 0").orderBy(order, "doc_id").limit(per_class))
    # At most 2 * per_class rows of two numbers.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return save(texts.join(F.broadcast(picked), "doc_id").select("text", "label"), "sample")
