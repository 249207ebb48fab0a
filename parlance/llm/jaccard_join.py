"""Self-join of texts on the Jaccard similarity of their word shingles, by chosen paths."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, matching, save, sift, small, whole_groups, without
from .components import components
from .shingles import WordHashes, hashed, mix, shingle_set, words_of

#: Levels of splitting at most, and texts of a bucket that is compared by brute force without splitting it further.
DEPTH, BUCKET = 3, 768
#: Minhashes of a text. A pair at the threshold agrees in fewer than SIFT of them once in ten million times.
SKETCH, SIFT = 64, 0.5
#: Chance that a pair at the threshold meets in some run, even if all its buckets are split to the last level.
RECALL = 0.999


def runs_needed(threshold: float, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold has met with chance ``recall``: it stays together at a level with the threshold's chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def sift_loss(threshold: float) -> float:
    """Chance that a pair at the threshold agrees in too few minhashes to pass the sift."""
    return sum(math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k) for k in range(math.ceil(SIFT * SKETCH)))


#: Odd multipliers, one for each hash function: multiplication by an odd number permutes the 64-bit numbers.
FACTORS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The least of the shingles' hashes under each of SKETCH hash functions."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[k : k + 1024, None] * FACTORS).min(axis=0), out=out)
    return out


def paths(sketch: np.ndarray, runs: int) -> np.ndarray:
    """Of each run, the paths to each level: a path is told by the sampled shingles that were chosen on the way."""
    chosen = sketch[: runs * DEPTH].reshape(runs, DEPTH)
    value, out = np.arange(1, runs + 1, dtype=np.uint64), np.empty((runs, DEPTH), dtype=np.uint64)
    for level in range(DEPTH):
        value = out[:, level] = mix(value * np.uint64(0x9E3779B97F4A7C15) + chosen[:, level])
    return out.view(np.int64).ravel()


def owned_pairs(sketch: np.ndarray, leaves: np.ndarray, sizes: np.ndarray, run: int, side: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket that may reach the threshold, by sketch and size, and that met in no earlier run.

    With ``cross`` only pairs of the two sides count. Works in strips, so memory stays bounded.
    """
    left, right = [], []
    n = len(sketch)
    for at in range(0, n, 512):
        strip = slice(at, min(n, at + 512))
        if n <= 32:
            same = (sketch[:, None, :] == sketch[None, :, :]).sum(axis=2)
        else:
            same = np.zeros((strip.stop - at, n), dtype=np.uint8)
            for k in range(SKETCH):
                same += sketch[strip, k][:, None] == sketch[None, :, k]
        a, b = np.nonzero(same >= SIFT * SKETCH)
        a += at
        ok = (a < b) & (np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]))
        if cross:
            ok &= side[a] != side[b]
        a, b = a[ok], b[ok]
        if run:
            met = ((leaves[a, :run] == leaves[b, :run]) & (leaves[a, :run] != 0)).any(axis=1)
            a, b = a[~met], b[~met]
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold, counted exactly."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if len(a) <= 4 * len(sets):
        inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], dtype=np.int64)
    else:
        # Intersections of many pairs at once: products of strips of the incidence matrix of shared shingles.
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = times[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        total = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            lo, hi = np.searchsorted(column, [at, at + 2048])
            strip = np.zeros((len(sets), 2048), dtype=np.float32)
            strip[row[lo:hi], column[lo:hi] - at] = 1
            total += strip @ strip.T
        inter = total[a, b].astype(np.int64)
    return inter >= threshold * (sizes[a] + sizes[b] - inter) - 1e-9


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` nodes' component under the links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def join(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """Of every row its class of similar texts and its number of links.

    Texts link if the Jaccard similarity of their sets of five-word shingles is at least ``threshold``. Texts with the
    same words are copies and share one set. In each run the sets are split by the shingle that a minhash samples from
    them; a bucket with more than BUCKET sets is split again, down to DEPTH levels, and one that is still larger is
    compared in pairs of blocks, so nothing is left out. Pairs of a bucket are sifted by sketches, then counted exactly
    in the first run in which they meet; only links' numbers and a spanning forest leave a bucket.

    Returns id, class_id (the least id of the class), n_links (the other rows that the row's text is similar to,
    copies included), is_first (whether id and text are the class's first) and text_key (xxhash64 of the text). Texts without words, null ones too, are alone in their class with no links. Rows alike count
    each. Null ids are least of no class unless all its ids are null. An empty table gives no rows. A threshold at
    which the sketches don't reach the recall is an error.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    runs = runs_needed(threshold, recall)
    if runs > SKETCH // DEPTH or sift_loss(threshold) > 1 - recall:
        raise ValueError(f"sketches of {SKETCH} minhashes don't reach a recall of {recall} at a threshold of {threshold}")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))

    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = words_of(text)
                if not words:
                    out.append((None, 0, None, None))
                    continue
                shingles = shingle_set(hashed(words, hashes))
                sketch = minhashes(shingles)
                name = hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()
                out.append((name, len(shingles), (sketch >> np.uint64(32)).astype(np.uint32).tobytes(), paths(sketch, runs)))
            made = pd.DataFrame(out, columns=["name", "size", "sketch", "paths"])
            yield pd.concat([batch[["id", "text_key"]].reset_index(drop=True), made], axis=1)

    members = save(rows.mapInPandas(sketches, f"id {kind}, text_key long, name binary, size int, sketch binary, paths array<long>"), "members")
    worded = members.filter("name is not null")
    # One row for each different sequence of words; copies agree in all that is taken first.
    sets = worded.groupBy("name").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("least"), F.count("*").alias("copies"), F.first("size").alias("size")
    )
    sets = save(sets.select("name", F.col("least.id").alias("id"), F.col("least.text_key").alias("text_key"), "copies", "size"), "sets")

    chosen = worded.select("name", "paths").dropDuplicates(["name"])
    tree = save(
        chosen.select("name", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.slice("paths", r * DEPTH + 1, DEPTH))).alias("run", "path")),
        "tree",
    )
    leaves, active = None, tree
    for level in range(1, DEPTH + 1):
        key = F.element_at("path", level)
        counts = save(active.groupBy(key.alias("leaf")).agg(F.count("*").alias("n")).filter("n > 1"), "counts")
        last = level == DEPTH
        ended = counts if last else counts.filter(F.col("n") <= BUCKET)
        here = active.withColumn("leaf", key).join(small(ended), "leaf").select("name", "run", "leaf", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks"))
        leaves = here if leaves is None else leaves.unionByName(here)
        larger = counts.filter(F.col("n") > BUCKET).select("leaf")
        if last or not larger.limit(1).count():
            break
        active = active.withColumn("leaf", key).join(small(larger), "leaf", "left_semi").drop("leaf")
    placed = leaves.groupBy("name").agg(F.collect_list(F.struct("run", "leaf", "blocks")).alias("leaves"))
    placed = save(placed.join(worded.select("name", "sketch").dropDuplicates(["name"]), "name").join(sets.select("name", "size", "copies"), "name"), "placed")
    by_run = F.expr(f"transform(sequence(0, {runs - 1}), r -> coalesce(try_element_at(filter(leaves, x -> x.run = r), 1).leaf, 0L))")
    block = F.pmod(F.xxhash64("name"), F.col("at.blocks").cast("long")).cast("int")
    dealt = placed.withColumn("by_run", by_run).withColumn("at", F.explode("leaves")).withColumn("block", block)
    # A bucket of several blocks is met in pairs of blocks.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("at.blocks") - 1))).select(
        F.col("at.leaf").alias("leaf"), F.col("at.run").alias("run"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "name", "sketch", "size", "copies", "by_run",
    )

    bucket = ["leaf", "low", "high"]

    def pairs_in(rows: pd.DataFrame, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of each bucket in the rows that has pairs: its bounds and the pairs, counted from its start."""
        sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint32).reshape(len(rows), SKETCH)
        by_run = np.array(rows["by_run"].tolist(), dtype=np.int64).reshape(len(rows), runs)
        sizes, block, run = (rows[c].to_numpy() for c in ("size", "block", "run"))
        cross = (rows["low"] != rows["high"]).to_numpy()
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo < 2:
                continue
            a, b = owned_pairs(sketch[lo:hi], by_run[lo:hi], sizes[lo:hi], int(run[lo]), block[lo:hi], bool(cross[lo]), threshold)
            if len(a):
                yield lo, hi, a, b

    def sifted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in whole_groups(batches, bucket):
            stay = np.zeros(len(rows), dtype=bool)
            for lo, _, a, b in pairs_in(rows, bounds):
                stay[lo + a] = stay[lo + b] = True
            yield rows[stay]

    sorted_buckets = lambda df: df.repartition(*bucket).sortWithinPartitions(*bucket)
    held = save(sorted_buckets(dealt).mapInPandas(sifted, dealt.schema), "held")
    # Texts of the sets that are left: looked up by id and hash, one row for each.
    wanted = save(held.select("name").distinct().join(sets.select("name", F.col("id").alias("want_id"), F.col("text_key").alias("want_key")), "name"), "wanted")
    same = (F.col("text_key") == F.col("want_key")) & F.col("id").eqNullSafe(F.col("want_id"))
    texts = matching(rows, "text_key", wanted, "want_key", same, 100_000).select("name", "text").dropDuplicates(["name"])

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "shingles": [shingle_set(hashed(words_of(t), hashes)).tobytes() for t in batch["text"]]})

    full = save(texts.mapInPandas(shingled, "name binary, shingles binary"), "shingles")

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in whole_groups(batches, bucket):
            name, copies, shingles = (rows[c].to_numpy() for c in ("name", "copies", "shingles"))
            out = []
            for lo, hi, a, b in pairs_in(rows, bounds):
                ok = similar([np.frombuffer(s, dtype=np.uint64) for s in shingles[lo:hi]], a, b, threshold)
                a, b = a[ok], b[ok]
                links = np.zeros(hi - lo, dtype=np.int64)
                np.add.at(links, a, copies[lo:hi][b])
                np.add.at(links, b, copies[lo:hi][a])
                root = roots(hi - lo, a, b)
                out += [(name[lo + k], name[lo + root[k]], int(links[k])) for k in np.flatnonzero(links)]
            yield pd.DataFrame(out, columns=["name", "root", "links"])

    links = save(sorted_buckets(held.join(full, "name")).mapInPandas(linked, "name binary, root binary, links long"), "links")
    classes = components(links.select(F.col("name").alias("a"), F.col("root").alias("b")))
    numbers = links.groupBy("name").agg(F.sum("links").alias("links"))
    named = sets.join(classes.withColumnRenamed("node", "name"), "name", "left").join(numbers, "name", "left")
    least = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    of_root = named.filter("root is not null").groupBy("root").agg(F.min(least).alias("first"))
    named = named.withColumn("own", least).join(of_root, "root", "left").withColumn("first", F.coalesce("first", "own"))
    named = named.select("name", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))
    out = worded.select("id", "text_key", "name").join(named, "name").select("id", F.col("first.id").alias("class_id"), "n_links", is_first.alias("is_first"), "text_key")
    alone = members.filter("name is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("is_first"), "text_key")
    return out.unionByName(alone).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its columns, one row of each class of similar texts: that of least id, then of least text hash.

    Of rows alike in id and text one stays. Texts without words stay all. Rows that stay are not shuffled. Columns of
    any name may be there.
    """
    classes = join(docs, id_col=id_col, text_col=text_col, **options)
    # Names that no column of the documents has.
    own_id, own_key = (_free(name, docs.columns) for name in ("class_of_id", "class_of_key"))
    classes = save(classes.select(F.col(id_col).alias(own_id), F.col("text_key").alias(own_key), "is_first", "n_links"), "classes")
    text_key = F.xxhash64(text_col)
    key = F.col(id_col).eqNullSafe(F.col(own_id)) & text_key.eqNullSafe(F.col(own_key))
    gone = save(classes.filter(~F.col("is_first")).select(own_id, own_key).distinct(), "gone")
    again = save(classes.filter("is_first and n_links > 0").groupBy(own_id, own_key).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "again")
    kept = without(docs, text_key, gone, own_key, key)
    if not again.limit(1).count():
        return kept
    repeats = docs.join(F.broadcast(again), key, "left_semi") if is_small(again) else docs.filter(sift(again, own_key)(text_key)).join(again, key, "left_semi")
    return without(kept, text_key, again, own_key, key).unionByName(repeats.dropDuplicates([id_col, text_col]))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name
