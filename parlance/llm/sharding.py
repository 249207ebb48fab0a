"""Vector bin packing of documents into shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save

#: Parcels of hashed groups per shard; the packing sees at most shards * (PARCELS + 3 * LARGE) of them and of pieces.
PARCELS = 64
#: A group over 1/LARGE of a shard in any dimension is a parcel of its own.
LARGE = 32
#: A group over 1/WHOLE of a shard in any dimension is split into pieces of about 1/PIECE of a shard.
WHOLE, PIECE = 2, 8
#: Share of each dimension (bytes, tokens, rows) in the dot product.
WEIGHTS = (1.0, 0.5, 0.25)


def pack(sizes: np.ndarray, bins: int, weights=WEIGHTS) -> np.ndarray:
    """The bin of each row of ``sizes`` (items x dimensions, in units of one bin's capacity).

    Items are placed largest first where the dot product of item and residual capacity is highest, the lowest bin
    winning ties. The first dimension is the law: once no residual capacity tells bins apart in it, it decides.
    """
    out = np.zeros(len(sizes), dtype=np.int32)
    left = np.ones((bins, sizes.shape[1]))
    w = np.asarray(weights)
    # A large item may look at all dimensions; the many small ones that follow even out the first.
    order = np.lexsort((np.arange(len(sizes)), -(sizes @ w)))
    turn = max(1, int(0.5 * len(order)))
    for n, i in enumerate(order):
        aim = w if n < turn else np.where(np.arange(len(w)) == 0, 1.0, 0.02) * w
        best = int(np.argmax(left @ (sizes[i] * aim))) if sizes[i, 0] > 0 else int(np.argmax(left.sum(axis=1)))
        out[i] = best
        left[best] -= sizes[i]
    return out


def shard(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Assign every row to one of ``n_shards``, evening out bytes first, then tokens and rows.

    Rows of equal text form a group, and a group goes to one shard unless it exceeds half a shard in some dimension:
    then it is split by id into pieces. Small groups are hashed into a number of parcels that depends on ``n_shards``
    alone; only the parcels' sums reach the driver, which packs them.

    Returns id, size (UTF-8 bytes plus ``overhead``), text_crc32, shard and slot (from 0, gapless in each shard).
    A null text counts as one of 0 bytes and forms a group apart from the empty text, with checksum 0 as the empty
    text has. Null ids and repeated rows are rows like others; rows alike in id and text are interchangeable.
    An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = save(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
            F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
            F.coalesce(F.xxhash64(text, F.lit(7)), F.lit(0)).alias("grp"),
        ),
        "rows",
    )
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    schema = "id {}, size long, text_crc32 long, shard int, slot long".format(docs.schema[id_col].dataType.simpleString())
    if not total[2]:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    cap = [max(1.0, (t or 0) / n_shards) for t in total]
    names = ["size", "tokens", "n"]

    def over(part: float) -> Column:
        return F.greatest(*[F.col(c) / F.lit(k) for c, k in zip(names, cap)]) > F.lit(1.0 / part)

    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    biggest = F.greatest(*[F.col(c) / F.lit(k) for c, k in zip(names, cap)])
    # At most 3 * LARGE * n_shards rows, for each exceeds 1/LARGE of a shard in one of three dimensions.
    large = save(
        groups.filter(over(LARGE)).select("grp", F.when(biggest > 1.0 / WHOLE, F.ceil(biggest * PIECE)).otherwise(1).cast("int").alias("pieces")),
        "large",
    )
    hashed = F.pmod(F.xxhash64("grp", F.lit(1)), F.lit(PARCELS * n_shards))
    piece = F.pmod(F.xxhash64("id", F.lit(2)), F.col("pieces").cast("long"))
    # A large group's parcel is a number of its own: negative, and told apart by hash.
    dealt = rows.join(F.broadcast(large), "grp", "left").withColumn(
        "parcel", F.when(F.col("pieces").isNull(), F.concat_ws(":", F.lit("h"), hashed)).otherwise(F.concat_ws(":", F.lit("g"), "grp", piece))
    )
    parcels = dealt.groupBy("parcel").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
    parcels.sort(key=lambda r: r.parcel)
    sizes = np.array([[r[c] / k for c, k in zip(names, cap)] for r in parcels])
    bins = pack(sizes, n_shards)
    before = [0] * n_shards
    placed = []
    for r, b in zip(parcels, bins):
        placed.append((r.parcel, int(b), before[b]))
        before[b] += r.n
    where = F.broadcast(spark.createDataFrame(placed, "parcel string, shard int, first_slot long"))
    w = W.partitionBy("parcel").orderBy("id", "crc", "grp")
    return dealt.join(where, "parcel").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first_slot") + F.row_number().over(w) - 1).alias("slot")
    )
