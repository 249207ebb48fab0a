"""The best vectors for each query within one piece of both, for tasks that compare blocks with blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that are held at a time, and pairs that are scored once more, exactly.
SCORES_AT_ONCE, PAIRS_AT_ONCE = 4_000_000, 50_000


class Vectors:
    """A column of vectors: each one's length, -1 for null, and whether it has all its components."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
        held = pa.concat_arrays(arrays) if arrays else pa.array([], column.type)
        self.length = pc.fill_null(pc.list_value_length(held), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        values = held.flatten()
        self.start = np.cumsum(np.maximum(self.length, 0)) - np.maximum(self.length, 0)
        gone = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))]) if values.null_count else np.zeros(len(values) + 1, dtype=np.int64)
        end = self.start + np.maximum(self.length, 0)
        self.whole = (self.length >= 0) & (gone[end] == gone[self.start])
        self.flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)

    def rows(self, at: np.ndarray, dims: int) -> np.ndarray:
        return self.flat[self.start[at][:, None] + np.arange(dims)]


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves go away from zero, as in SQL."""
    if digits is None:
        return x
    scaled = np.abs(x) * 10.0**digits
    low = np.floor(scaled)
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(scaled), np.copysign((low + (scaled - low >= 0.5)) / 10.0**digits, x), x)


def exact(q: np.ndarray, v: np.ndarray, digits: int | None) -> np.ndarray:
    """Inner products of rows, summed up from the first component on: equal for equal vectors wherever they stand."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * v[:, k]
    return rounded(out, digits)


def distinct_enough(v: np.ndarray, k: int) -> np.ndarray:
    """Places of vectors of which fewer than ``k`` equal ones stand before; others can't be among the best k."""
    if len(v) <= k or not v.shape[1]:
        return np.arange(min(len(v), k))
    keys = np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, 8 * v.shape[1]))).ravel()
    group = np.unique(keys, return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    first = np.searchsorted(group[order], group[order], side="left")
    return np.sort(order[np.arange(len(v)) - first < k])


def best(q: np.ndarray, v: np.ndarray, k: int, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k vectors of largest inner product with each query: places of query and vector and the score, ties to the earlier vector.

    A matrix product tells which come near the k-th; those are scored again, exactly. NaN counts as the largest.
    """
    kept = distinct_enough(v, k)
    v = v[kept]
    n, dims = v.shape
    if not n or not len(q):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    odd = ~np.isfinite(v).all(axis=1)
    found = []
    with np.errstate(invalid="ignore", over="ignore"):
        longest = np.sqrt((v[~odd] ** 2).sum(axis=1)).max(initial=0.0)
        step = max(1, SCORES_AT_ONCE // n)
        for begin in range(0, len(q), step):
            some = q[begin : begin + step]
            if n > k:
                near = some @ v.T
                near[:, odd] = -np.inf
                least = np.partition(near, n - k, axis=1)[:, n - k]
                slack = 4 * (dims + 2) * np.finfo(float).eps * np.sqrt((some**2).sum(axis=1)) * longest
                slack = slack + (0.0 if digits is None else 1.01 * 10.0**-digits + 4 * np.finfo(float).eps * np.abs(least))
                least = least - slack
                least[~np.isfinite(least)] = -np.inf
                held = near >= least[:, None]
                held[:, odd] = True
                held[~np.isfinite(some).all(axis=1)] = True
                qi, vi = np.nonzero(held)
            else:
                qi, vi = np.repeat(np.arange(len(some)), n), np.tile(np.arange(n), len(some))
            pieces = range(0, len(qi), PAIRS_AT_ONCE)
            score = np.concatenate([exact(some[qi[p : p + PAIRS_AT_ONCE]], v[vi[p : p + PAIRS_AT_ONCE]], digits) for p in pieces])
            found.append(first_of_each(qi + begin, kept[vi], score, k))
    return tuple(np.concatenate(x) for x in zip(*found))


def first_of_each(qi: np.ndarray, vi: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs with their scores each query's best ``k``, best first."""
    nan = np.isnan(score)
    order = np.lexsort((vi, np.where(nan, 0.0, -score), ~nan, qi))
    qi, vi, score = qi[order], vi[order], score[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[keep], vi[keep], score[keep]


def best_rows(asked: pa.Table, held: pa.Table, k: int, digits: int | None, columns: list[str]) -> pa.Table:
    """For each row of ``asked`` (query_id, q) its best k of ``held`` (id, v): ``columns`` of held, query_id and score.

    Pairs of vectors of different lengths, and those with a null or a null component, have no score and come last, by id.
    """
    held = held.take(pc.sort_indices(held, sort_keys=[("id", "ascending")], null_placement="at_start"))
    q, v = Vectors(asked["q"]), Vectors(held["v"])
    qs, vs, scores = [], [], []
    for dims in np.unique(q.length):
        of_q = np.flatnonzero(q.whole & (q.length == dims))
        of_v = np.flatnonzero(v.whole & (v.length == dims))
        qi, vi, score = best(q.rows(of_q, dims), v.rows(of_v, dims), k, digits) if dims >= 0 else (of_q, of_q, np.zeros(0))
        qs.append(of_q[qi])
        vs.append(of_v[vi])
        scores.append(score)
        # Where fewer are scored, those without a score follow.
        for asks, scored in ((of_q, of_v), (np.flatnonzero(~q.whole & (q.length == dims)), of_v[:0])):
            if len(scored) < k and len(asks) and len(scored) < held.num_rows:
                rest = np.setdiff1d(np.arange(min(held.num_rows, k + len(scored))), scored)[: k - len(scored)]
                qs.append(np.repeat(asks, len(rest)))
                vs.append(np.tile(rest, len(asks)))
                scores.append(np.full(len(rest) * len(asks), np.nan))
    if not qs:
        qs, vs, scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    qi, vi = np.concatenate(qs), np.concatenate(vs)
    unscored = ~(q.whole[qi] & v.whole[vi] & (q.length[qi] == v.length[vi]))
    out = held.select(columns).take(pa.array(vi))
    return out.append_column("query_id", asked["query_id"].take(pa.array(qi))).append_column("score", pa.array(np.concatenate(scores), mask=unscored))
