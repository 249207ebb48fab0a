"""From raw documents to shards of a training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontamination, jaccard_join, mixing, quality, sharding
from parlance.llm.common import save, table, without
from parlance.llm.learning import fold

#: Score that a document needs, similarity from which documents form a group, shards.
LEAST_QUALITY, SIMILAR, N_SHARDS = 0.3, 0.8, 40


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier lets through; null and empty texts are scored like others, rows alike stay or go together."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return docs.filter(quality.scorer(model)(F.col("text")) >= LEAST_QUALITY)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, of least id; null texts and those without words stay all, of rows alike one stays."""
    return jaccard_join.one_of_each(docs, threshold=SIMILAR)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, rows alike stay or go together."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    # Names that no column of the documents has.
    of_id, of_key = (f"gone_{'_'.join(docs.columns)}_{x}" for x in ("id", "key"))
    gone = save(found.select(F.col("doc_id").alias(of_id), F.col("text_key").alias(of_key)).distinct(), "gone")
    text_key = F.xxhash64("text")
    return without(docs, text_key, gone, of_key, F.col("doc_id").eqNullSafe(F.col(of_id)) & (text_key == F.col(of_key)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, twice at most; null texts have no words and are taken as whole copies only."""
    return mixing.mixed_rows(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document of the mix; repeated rows have a slot each, null texts the least size."""
    return sharding.shard(docs, N_SHARDS)


STAGES = [
    ("quality_classifier", keep_good),
    ("jaccard_join", keep_distinct),
    ("decontamination", keep_clean),
    ("source_mixing", mix_sources),
    ("sharding", deal_shards),
]

#: A trained model and texts' word sets decide, which SQL doesn't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied in turn to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
