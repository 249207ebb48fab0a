"""Approximate nearest neighbours: stable projections to a few dimensions, a kd-tree over them, chi-square stopping."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save, small, spread

#: Dimensions of the projection (even), chance that a neighbour lies inside the radius where a search stops.
PROJECTED, INSIDE = 8, 0.98
#: Vectors of a block, vectors of a leaf, queries that are put to a block at once.
BLOCK, LEAF, QUERIES = 16_384, 128, 16_384
#: Projected points, by expectation, from which the upper splits of the tree are taken; every row is indexed by them.
SAMPLE = 50_000
SEED = 7


def chi_square_quantile(p: float, dims: int) -> float:
    """The value that a chi-square variable of an even number of dimensions stays under with chance ``p``."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def halves(points: np.ndarray, part: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray] | None:
    """The part cut at the median of its widest axis: axis, value, the rows below the value and the others; none if it can't be cut."""
    axis = int(np.argmax(np.ptp(points[part], axis=0)))
    at = points[part, axis]
    value = float(np.median(at))
    low = at < value
    if not low.any():
        low = at <= value
        value = float(np.nextafter(value, math.inf))
    return None if low.all() else (axis, value, part[low], part[~low])


class Splits:
    """The upper splits of the kd-tree, down to its blocks."""

    def __init__(self, points: np.ndarray, blocks: int):
        self.axis, self.value, self.next, self.blocks = [], [], [], 0
        most = max(4, len(points) // max(1, blocks))
        self._grow(points, np.arange(len(points)), most)

    def _grow(self, points: np.ndarray, part: np.ndarray, most: int) -> int:
        """Adds the splits below a part; returns the number of its node, blocks counting down from -1."""
        cut = halves(points, part) if len(part) > most else None
        if cut is None:
            self.blocks += 1
            return -self.blocks
        node = len(self.axis)
        self.axis.append(cut[0])
        self.value.append(cut[1])
        self.next.append((0, 0))
        self.next[node] = (self._grow(points, cut[2], most), self._grow(points, cut[3], most))
        return node

    def block_of(self, points: np.ndarray) -> np.ndarray:
        if not self.axis:
            return np.zeros(len(points), dtype=np.int64)
        axis, value, after = np.array(self.axis), np.array(self.value), np.array(self.next)
        node = np.zeros(len(points), dtype=np.int64)
        while (node >= 0).any():
            at = np.flatnonzero(node >= 0)
            n = node[at]
            node[at] = after[n, (points[at, axis[n]] >= value[n]).astype(np.int64)]
        return -1 - node


def leaves_of(points: np.ndarray) -> np.ndarray:
    """The number of each point's leaf: the tree goes on below a block until LEAF points are left."""
    out, n, todo = np.zeros(len(points), dtype=np.int64), 0, [np.arange(len(points))]
    while todo:
        part = todo.pop()
        cut = halves(points, part) if len(part) > LEAF else None
        if cut is None:
            out[part] = n
            n += 1
        else:
            todo += [cut[2], cut[3]]
    return out


def box_distance(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distance of each point (rows) from each box (columns)."""
    gap = np.maximum(0, np.maximum(low[None] - points[:, None], points[:, None] - high[None]))
    return (gap**2).sum(axis=2)


class Leaves:
    """The leaves of a block: its rows in order of their leaves, and the leaves' bounding boxes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, points: np.ndarray, leaf: np.ndarray, times: np.ndarray | None = None):
        order = np.argsort(leaf, kind="stable")
        self.ids, self.x, points, leaf = ids[order], x[order], points[order], leaf[order]
        #: How many rows of the table each row stands for.
        self.times = np.ones(len(ids), dtype=np.int64) if times is None else times[order]
        self.start = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        self.end = np.r_[self.start[1:], len(leaf)]
        self.low, self.high = np.minimum.reduceat(points, self.start), np.maximum.reduceat(points, self.start)
        self.verified = 0


def search(tree: Leaves, query_ids: np.ndarray, q: np.ndarray, points: np.ndarray, bar: np.ndarray, top: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest inner products that each query finds in the leaves, none under its ``bar``: places of the query and of the row, scores.

    Leaves are verified outward from the query's projection, one, then two, four and so on at once. With t the k-th best
    so far, a row as good lies within a squared distance of |q|^2 + top^2 - 2t once norms are evened out to ``top``; its
    projection then lies within the chi-square quantile times that, with the wanted chance, and the search ends where
    the next box lies farther out. The row whose id and vector are the query's own is given only if it stands for others too.
    """
    most, out = chi_square_quantile(INSIDE, points.shape[1]), []
    for at in range(0, len(q), 512):
        v, p, ids, floor = q[at : at + 512], points[at : at + 512], query_ids[at : at + 512], bar[at : at + 512].copy()
        norm = (v * v).sum(axis=1)
        slack, norm = 1e-12 * top * np.sqrt(norm), norm + top * top
        far = box_distance(tree.low, tree.high, p)
        order = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, order, axis=1)
        who, row, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        done, width = 0, 1
        while done < far.shape[1]:
            need = far[:, done : done + width] <= most * np.maximum(0, norm - 2 * floor)[:, None] + 1e-9
            asking, col = np.nonzero(need)
            if not len(asking):
                break
            leaf = order[asking, done + col]
            by_leaf = np.argsort(leaf, kind="stable")
            asking, leaf = asking[by_leaf], leaf[by_leaf]
            tree.verified += len(leaf)
            cut = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
            new = [(who, row, score)]
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(leaf)]):
                first, last, some = tree.start[leaf[lo]], tree.end[leaf[lo]], asking[lo:hi]
                a, b = np.nonzero(v[some] @ tree.x[first:last].T >= (floor - slack)[some][:, None])
                a, b = some[a], first + b
                other = tree.ids[b] != ids[a]
                if not other.all():
                    other |= (tree.times[b] > 1) | (tree.x[b] != v[a]).any(axis=1)
                    a, b = a[other], b[other]
                new.append((a, b, (tree.x[b] * v[a]).sum(axis=1)))
            who, row, score = (np.concatenate(c) for c in zip(*new))
            best = np.lexsort((tree.ids[row], -score, who))
            who, row, score = who[best], row[best], score[best]
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            place = np.arange(len(who)) - np.repeat(starts, np.diff(np.r_[starts, len(who)]))
            floor[who[place == k - 1]] = np.maximum(floor[who[place == k - 1]], score[place == k - 1])
            who, row, score = who[place < k], row[place < k], score[place < k]
            done, width = done + width, 2 * width
        out.append((who + at, row, score))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def floats(column: pd.Series, width: int) -> np.ndarray:
    """Packed vectors as a matrix."""
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), width)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that ``is_query`` picks, the k other rows of largest inner product that the search finds.

    Vectors are projected by one matrix of normal variables, after a coordinate that evens out the norms, so that the
    nearest by distance are the largest by product. The upper splits of a kd-tree, taken from a sample of projections,
    deal all rows to blocks; each block is planted once, and saved in the order of its leaves. A query is put to the
    block where its projection lies first; its k-th best there is the bar for the rest, and it goes on to those blocks
    only whose boxes the chi-square test can't rule out. So rows are moved a fixed number of times, and queries as often
    as there are blocks that may hold neighbours of theirs. A block with more than BLOCK rows (one vector may be that
    frequent) is dealt over parts, and one with more than QUERIES visits answers them in groups.

    Returns query_id, rank from 1, id and score, ties in order of id. Rows with a null id and vectors that are null,
    zero, of another length than the longest or hold a null or non-finite component take no part. Rows alike in id and
    vector are one query, asked once, and as many candidates as there are rows (less the query's own); they move as one
    row with a count. A row that shares the query's id but not its vector is a candidate. A query with fewer than k
    candidates gets all; an empty table gives no rows. Long vectors make blocks smaller, so a block's bytes are bounded.
    Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("is_query")).filter("id is not null")
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.filter(F.col("v").isNotNull() & sound)
    dims, peak = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    out = f"query_id long, rank int, {id_col} long, score double"
    if dims is None:
        return spark.createDataFrame([], out)
    # A power of two brings all components into -1 to 1 without rounding.
    scale = 2.0 ** math.ceil(math.log2(peak))
    rows = rows.filter(F.size("v") == dims).withColumn("v", F.transform("v", lambda c: c / scale))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    n, top = rows.agg(F.count("*"), F.max(square)).first()
    top, block = math.sqrt(top), max(256, min(BLOCK, (16 << 20) // (8 * dims)))
    matrix = np.random.default_rng(SEED).normal(size=(dims + 1, PROJECTED))

    def project(x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, top * top - (x * x).sum(axis=1)))
        return x @ matrix[:-1] + rest[:, None] * matrix[-1]

    share = min(1.0, SAMPLE / n)
    picked = rows.filter(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) < share * (1 << 30)).select("v").limit(4 * SAMPLE)

    def projections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"p": list(project(np.stack(batch["v"].to_numpy())))})

    # At most 4 * SAMPLE points of a few dimensions.
    sample = [r.p for r in picked.mapInPandas(projections, "p array<double>").collect()]
    splits = Splits(np.array(sample).reshape(len(sample), PROJECTED), math.ceil(n / block))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy())
                points = project(x)
                made = pd.DataFrame({"id": batch["id"].to_numpy(), "v": [r.tobytes() for r in x], "p": list(points), "is_query": batch["is_query"].to_numpy(), "block": splits.block_of(points)})
                again = made.groupby(["id", "v"], sort=False)["block"].transform("size")
                yield made.assign(times=again).drop_duplicates(["id", "v"])

    columns = "id long, v binary, p array<double>, is_query boolean, block long, times long"
    dealt = save(rows.mapInPandas(placed, columns), "dealt")
    axes = [F.element_at("p", i + 1) for i in range(PROJECTED)]
    boxes = dealt.groupBy("block").agg(F.count("*").alias("n"), F.array(*map(F.min, axes)).alias("low"), F.array(*map(F.max, axes)).alias("high"))
    boxes = save(boxes.withColumn("parts", F.ceil(F.col("n") / block).cast("int")), "boxes")
    # As many rows as the sample has blocks, at most.
    listed = boxes.orderBy("block").toPandas()
    names, low, high = listed["block"].to_numpy(), np.array(listed["low"].tolist()), np.array(listed["high"].tolist())
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")

    def planted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(times=group.groupby(["id", "v"], sort=False)["times"].transform("sum")).drop_duplicates(["id", "v"])
        return group.assign(leaf=leaves_of(np.stack(group["p"].to_numpy())))

    pool = dealt.drop("is_query").join(small(boxes.select("block", "parts")), "block").withColumn("part", part).drop("parts")
    trees = save(spread(pool, "block", "part").groupBy("block", "part").applyInPandas(planted, "id long, v binary, p array<double>, block long, times long, part int, leaf long"), "trees")

    def answered(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        tree = Leaves(candidates["id"].to_numpy(), floats(candidates["v"], dims), np.stack(candidates["p"].to_numpy()), candidates["leaf"].to_numpy(), candidates["times"].to_numpy())
        q, ids = floats(asked["v"], dims), asked["id"].to_numpy()
        who, row, score = search(tree, ids, q, q @ matrix[:-1], asked["bar"].to_numpy(), top, k)
        own = (tree.ids[row] == ids[who]) & (tree.x[row] == q[who]).all(axis=1)
        # More than k of a kind are never among the k best.
        made = pd.DataFrame({"query_id": ids[who], "id": tree.ids[row], "score": score})
        return made.loc[np.repeat(made.index, np.minimum(tree.times[row] - own, k))]

    def meet(visits: DataFrame, name: str) -> DataFrame:
        """What queries (block, id, v, bar) find in the blocks that they visit."""
        deal = visits.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups")).join(boxes.select("block", "parts"), "block")
        deal = small(save(deal, f"{name}_deal"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = spread(trees.join(deal.drop("parts"), "block").withColumn("group", every("groups")).drop("groups"), "block", "part", "group")
        right = visits.join(deal, "block").withColumn("part", every("parts")).withColumn("group", F.pmod(F.xxhash64("id", F.lit(2)), F.col("groups")).cast("int"))
        right = spread(right.select("block", "part", "group", "id", "v", "bar"), "block", "part", "group")
        found = left.groupBy("block", "part", "group").cogroup(right.groupBy("block", "part", "group")).applyInPandas(answered, "query_id long, id long, score double")
        return save(found, name)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = splits.block_of(floats(batch["v"], dims) @ matrix[:-1])
                # A query's place may be one that holds no row; any block does to begin with.
                near = names[np.minimum(np.searchsorted(names, near), len(names) - 1)]
                yield batch[["id", "v"]].assign(block=near, bar=-math.inf)

    asks = dealt.filter("is_query").select("id", "v").dropDuplicates(["id", "v"])
    visits = save(asks.mapInPandas(home, "id long, v binary, block long, bar double"), "visits")
    found = meet(visits, "home")
    best = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    if len(names) > 1:
        bars = best(found).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        asks = visits.join(bars, "id", "left").select("id", "v", "block", F.coalesce("least", "bar").alias("bar"))

        def onward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            most = chi_square_quantile(INSIDE, PROJECTED)
            strip = max(1, 2_000_000 // len(names))
            for batch in batches:
                for at in range(0, len(batch), strip):
                    some = batch.iloc[at : at + strip].reset_index(drop=True)
                    q, bar = floats(some["v"], dims), some["bar"].to_numpy()
                    radius = most * np.maximum(0, (q * q).sum(axis=1) + top * top - 2 * bar)
                    who, block = np.nonzero((box_distance(low, high, q @ matrix[:-1]) <= radius[:, None] + 1e-9) & (names[None] != some["block"].to_numpy()[:, None]))
                    for k in range(0, len(who), 20_000):
                        yield some.iloc[who[k : k + 20_000]].assign(block=names[block[k : k + 20_000]])

        found = found.unionByName(meet(save(asks.mapInPandas(onward, "id long, v binary, block long, bar double"), "onward"), "away"))
    return best(found).select("query_id", "rank", F.col("id").alias(id_col), (F.col("score") * (scale * scale)).alias("score"))
