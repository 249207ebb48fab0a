"""A manifest of a dataset as a Merkle tree of 16-fold nodes: the root, and for each row the siblings that lead from it there."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import is_small, save, spread, whole_groups

#: Children of a node, levels of a block: a task holds the hashes of one block of FANOUT ** LEVELS leaves.
FANOUT, LEVELS = 16, 3
BLOCK = FANOUT**LEVELS


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf(*fields: Column) -> Column:
    """The hash of a row: each field as the length of its UTF-8 form, a colon and its value, a null one as a dash."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def fold(node: Column, places: Column, siblings: Column) -> Column:
    """The root that a leaf and its proof lead to: on each level the node is put at its place among its siblings and they are hashed together."""
    step = lambda s, x: F.sha2(F.concat(F.substring(x["siblings"], F.lit(1), 64 * x["places"]), s, F.substring(x["siblings"], 64 * x["places"] + 1, F.length(x["siblings"]))), 256)
    return F.aggregate(F.arrays_zip(places.alias("places"), siblings.alias("siblings")), node, step)


class TreeHash:
    """The nodes of one level of a stretch of leaves, made leaf by leaf; of each level below it holds one unfinished node's children."""

    def __init__(self, level: int) -> None:
        self.nodes: list[str] = []
        self.stacks: list[list[str]] = [[] for _ in range(level)]

    def push(self, node: str) -> None:
        for stack in self.stacks:
            stack.append(node)
            if len(stack) < FANOUT:
                return
            node = digest("".join(stack))
            stack.clear()
        self.nodes.append(node)

    def finish(self) -> list[str]:
        """All nodes, the last of them perhaps of fewer children."""
        for k, stack in enumerate(self.stacks):
            if stack:
                above = self.stacks[k + 1] if k + 1 < len(self.stacks) else self.nodes
                above.append(digest("".join(stack)))
                stack.clear()
        return self.nodes


def n_levels(n: int) -> int:
    """Levels of a tree of n leaves: as often as there are several nodes, they are put together."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def block_root(leaves: list[str], levels: int) -> str:
    tree = TreeHash(levels)
    for x in leaves:
        tree.push(x)
    return tree.finish()[0]


def traverse(leaves: list[str], levels: int) -> Iterator[tuple[list[int], list[str]]]:
    """Each leaf's place and siblings on every level of a block, in order of the leaves.

    The run of siblings in use on each level is held, and the next run of that level is made meanwhile: one of its leaves
    is pushed for each leaf that is passed, so it is whole when it is due, and no level holds more than two runs and the
    stacks of one. The highest level has one run only.
    """
    spans = [FANOUT ** (h + 1) for h in range(levels)]
    runs, coming = [], []
    for h, span in enumerate(spans):
        tree = TreeHash(h)
        for x in leaves[:span]:
            tree.push(x)
        runs.append(tree.finish())
        coming.append(TreeHash(h))
    others: list[str] = [""] * levels
    for i in range(len(leaves)):
        places = [i // (span // FANOUT) % FANOUT for span in spans]
        for h, span in enumerate(spans):
            # The siblings on a level stay the same until its node is passed.
            if i % (span // FANOUT) == 0:
                others[h] = "".join(runs[h][: places[h]] + runs[h][places[h] + 1 :])
        yield places, list(others)
        for h, span in enumerate(spans):
            if i + span < len(leaves):
                coming[h].push(leaves[i + span])
            if (i + 1) % span == 0:
                runs[h], coming[h] = coming[h].finish(), TreeHash(h)


def positions(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows``, which must be saved, with pos, their number from 0 in their tree in the order of ``order``, and n, their tree's number of rows.

    Rows are dealt by ranges and numbered as they lie there; where a tree's part in a range begins follows from a table
    of the parts' sizes, of as many rows as there are ranges and trees.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lying = rows.repartitionByRange(n, tree, *order).sortWithinPartitions(tree, *order).withColumn("_at", F.monotonically_increasing_id())
    lying = save(lying, "lying").withColumn("_range", F.expr("_at div 8589934592"))
    parts = lying.groupBy(F.col(tree).alias("_tree"), F.col("_range").alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    of_tree = W.partitionBy("_tree")
    before = F.coalesce(F.sum("_rows").over(of_tree.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_tree).alias("n"))
    joined = lying.join(parts, (F.col(tree) == F.col("_tree")) & (F.col("_range") == F.col("_part")))
    return joined.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_tree", "_part", "_shift", "_first")


def block_roots(nodes: DataFrame) -> DataFrame:
    """One node for each block of ``nodes`` (tree, pos, n, node), numbered as the nodes of a tree above: tree, pos, n, node."""
    blocks = nodes.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "node")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, ["tree", "block"]):
            trees, block, n, node = (rows[c].to_numpy() for c in ("tree", "block", "n", "node"))
            made = [(trees[a], block[a], -(-int(n[a]) // BLOCK), block_root(node[a:b].tolist(), min(LEVELS, n_levels(int(n[a]))))) for a, b in zip(starts, starts[1:])]
            yield pd.DataFrame(made, columns=["tree", "pos", "n", "node"])

    return spread(blocks, "tree", "block").sortWithinPartitions("tree", "block", "pos").mapInPandas(hashed, "tree string, pos long, n long, node string")


def with_paths(nodes: DataFrame, upper: DataFrame, carry: list[str]) -> DataFrame:
    """``nodes`` (tree, pos, n, node and ``carry``) with the proofs of their blocks' tops appended to their own: adds places, siblings, tops.

    ``upper`` has tree, pos, the block, places, siblings and tops, which all rows of a block share; it goes to the block's
    task ahead of its rows, once.
    """
    none = {"places": F.lit(None).cast("array<int>"), "siblings": F.lit(None).cast("array<string>"), "tops": F.lit(None).cast("array<string>")}
    rows = nodes.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "node", *carry).withColumns(none)
    heads = upper.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "places", "siblings", "tops")
    rows = spread(rows.unionByName(heads, allowMissingColumns=True), "tree", "block").sortWithinPartitions("tree", "block", "pos")
    kept, path = ["tree", "pos", "node", *carry], list(none)

    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, starts in _whole_blocks(batches):
            up = {c: group[c].take(starts[:-1]).to_pylist() for c in path}
            n = group["n"].take(starts[:-1] + 1).to_pylist()
            node = group["node"].to_pylist()
            places, siblings, tops = [], [], []
            for k, (a, b) in enumerate(zip(starts, starts[1:])):
                for own, others in traverse(node[a + 1 : b], min(LEVELS, n_levels(n[k]))):
                    places.append(own + up["places"][k])
                    siblings.append(others + up["siblings"][k])
                    tops.append(up["tops"][k])
            keep = np.ones(group.num_rows, dtype=bool)
            keep[starts[:-1]] = False
            out = group.select(kept).filter(pa.array(keep))
            for name, values, kind in (("places", places, pa.int32()), ("siblings", siblings, pa.string()), ("tops", tops, pa.string())):
                out = out.append_column(name, pa.array(values, pa.list_(kind)))
            yield from out.to_batches(max_chunksize=BLOCK)

    return rows.mapInArrow(proven, rows.select(*kept, *path).schema)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables that end where a block ends, each with the bounds of its blocks."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        # A block's first row is that of its top.
        starts = np.flatnonzero(table["pos"].to_numpy() < 0)
        rest = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def proofs(nodes: DataFrame, carry: list[str], above=None) -> DataFrame:
    """The proofs of ``nodes``, saved rows (tree, pos, n, node): first up, block by block, until each tree is one node, then down again.

    ``above`` makes the proofs of the trees' own tops (tree, pos 0, places, siblings, tops) from a saved table of them;
    without it the tops are the roots.
    """
    tops = save(block_roots(nodes), "tops")
    if not is_small(tops.filter("n > 1"), 0):
        upper = proofs(tops, [], above).select("tree", "pos", "places", "siblings", "tops")
    elif above:
        upper = above(tops)
    else:
        upper = tops.select("tree", "pos", F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("siblings"), F.array("node").alias("tops"))
    return with_paths(nodes, upper, carry)


def manifest(rows: DataFrame, *, source: str = "source", order: str = "doc_id", leaf_col: str = "leaf") -> DataFrame:
    """Rows with the hashes that prove them part of the dataset: subroot, that of their source, root, and a proof (places, siblings).

    ``rows`` has a source, an order, a leaf hash in ``leaf_col`` (see ``leaf``), and other columns, which are kept and
    should be narrow: texts need not come along. Leaves of a source stand in ascending ``order``, null first, equal ones by
    hash; 16 nodes in turn, fewer at the end, are hashed into one until one is left, the subroot; subroots in the order of
    the sources, null first, by bytes, likewise give the root. A proof has for each level from the leaf to the root the
    node's place and its siblings' hashes as one text; ``fold`` leads back to the root. Repeated rows are leaves each, an
    empty table has no rows and no root. Columns that clash with those added are an error.
    """
    added = {"subroot", "root", "places", "siblings"}
    if clash := {c.lower() for c in rows.columns} & added:
        raise ValueError(f"columns would be hidden: {sorted(clash)}")
    names = {c: f"c{k}" for k, c in enumerate(rows.columns)}
    # Names of our own, so that no column clashes; a tree is a source, the null one before all.
    named = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in names.items()])
    named = named.withColumn("tree", F.coalesce(F.concat(F.lit("s"), F.col(names[source])), F.lit("")))
    leaves = positions(save(named, "leaves"), "tree", names[order], names[leaf_col])
    leaves = save(leaves.withColumn("node", F.col(names[leaf_col])), "placed")

    def sources(tops: DataFrame) -> DataFrame:
        one = save(tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node"), "subroots")
        placed = save(positions(one, "tree", "of"), "sources")
        found = proofs(placed, ["of"])
        return found.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "places", "siblings", F.array(F.col("node"), F.element_at("tops", 1)).alias("tops"))

    out = proofs(leaves, list(names.values()), sources)
    return out.select(*[F.col(k).alias(c) for c, k in names.items()], F.element_at("tops", 1).alias("subroot"), F.element_at("tops", 2).alias("root"), "places", "siblings")
