"""Fuzzy passages that texts share: seeds of words joined, chained in order with gap costs, and aligned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bitmap, matching, save, spread
from .shingles import BASE, INVERSE, KnownWords, grams, hashed_texts, mix

#: Words of a seed. A seed whose hash is a multiple of SAMPLED is kept wherever it stands, so edits beside it don't matter;
#: of each window of WINDOW seeds without such a one the least is kept.
SEED_WORDS, SAMPLED, WINDOW = 5, 4, 16
#: Words that a passage has at least, and share of them that match.
PASSAGE, IDENTITY = 50, 0.8
#: Cost of each word between two seeds of a chain, in either text; a seed is worth SEED_WORDS.
GAP = 0.1
#: Words between the seeds of a chain's ends, at least, for it to be aligned.
REACH = 8
#: Words between two neighbouring shared seeds, at most, for them to make a pair; words that a passage steps over at most.
NEAR, APART = 30, 50
#: Words on either side of a chain that are looked at first, in passages; where a passage goes on beyond them, more are.
MARGIN = 2
#: A mismatch costs so much, a match gains one, and an end is drawn no further once it has lost DROP.
MISMATCH, DROP = 1, 8


def minimizers(values: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places and texts of the seeds that are kept: the sampled ones, and the least in windows that have none; one at least.

    ``bounds`` says where the words of each text begin and end, if there are several. A seed that comes again in its text
    is given again with its number of occurrence in the hash, so that stretches which repeat a word or a line chain with
    others of their kind.
    """
    bounds = np.array([0, len(values)]) if bounds is None else bounds
    seeds = grams(values, SEED_WORDS)
    begin, end = bounds[:-1], bounds[1:] - SEED_WORDS + 1
    text = np.flatnonzero(end > begin)
    begin, end = begin[text], end[text]
    if not len(text):
        return seeds[:0], text, text
    depth = np.zeros(len(seeds) + 1, dtype=np.int8)
    depth[begin] += 1
    depth[end] -= 1
    inside = np.cumsum(depth, dtype=np.int8)[:-1] > 0  # others reach over into the next text
    at = np.flatnonzero(inside & (seeds % np.uint64(SAMPLED) == 0))
    edges = np.sort(np.concatenate([begin - 1, at, end]))
    wide = np.diff(edges) - WINDOW
    gaps = np.flatnonzero(wide > 0)
    gaps = gaps[inside[edges[gaps] + 1]]
    kept = [at]
    if len(gaps):
        # Where the windows in wide gaps begin, for all gaps at once.
        windows = wide[gaps]
        first = np.repeat(edges[gaps] + 1 - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
        steps = np.arange(WINDOW)
        kept += [x + seeds[x[:, None] + steps].argmin(axis=1) for x in np.split(first, range(50_000, len(first), 50_000))]
    # Texts of few seeds, none of them sampled.
    few = np.flatnonzero((np.searchsorted(at, begin) == np.searchsorted(at, end)) & (end - begin < WINDOW))
    kept += [np.array([int(b + np.argmin(seeds[b:e])) for b, e in zip(begin[few].tolist(), end[few].tolist())], dtype=np.int64)]
    at = np.unique(np.concatenate(kept))
    found = seeds[at]
    whose = text[np.searchsorted(begin, at, side="right") - 1]
    turn = turns(found ^ mix(whose.astype(np.uint64)))
    again = turn > 0
    at = at - bounds[whose]
    if again.any():
        found = np.concatenate([found, mix(found[again] ^ mix(turn[again].astype(np.uint64)))])
        at, whose = (np.concatenate([x, x[again]]) for x in (at, whose))
    return found, at, whose


def turns(values: np.ndarray) -> np.ndarray:
    """How often each value has come before in the array."""
    order = np.argsort(values, kind="stable")
    inorder = values[order]
    out = np.zeros(len(values), dtype=np.int64)
    same = inorder[1:] == inorder[:-1]
    if same.any():
        first = np.concatenate([[True], ~same])
        out[order] = np.arange(len(values)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return out


def long_grams(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values, in order, at a cost that doesn't grow with the width."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    powers = np.full(len(values), BASE, dtype=np.uint64)
    powers[0] = 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(values) * np.cumprod(powers))])
    back = np.full(n, INVERSE, dtype=np.uint64)
    back[0] = 1
    return mix((sums[width:] - sums[:n]) * np.cumprod(back))


class Fenwick:
    """Prefix maxima of scores with the item that has them."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, at: int, item: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if item > self.best[at]:
                self.best[at] = item
            at += at & -at

    def most(self, upto: int) -> tuple[float, int]:
        """Over places below ``upto``."""
        out = (-1e18, -1)
        while upto > 0:
            if self.best[upto] > out:
                out = self.best[upto]
            upto -= upto & -upto
        return out


def chains(pos: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """Chains of matches, as places in the arguments: in each, ``pos`` and ``other`` both rise.

    A chain's score is SEED_WORDS for each match less GAP for each word stepped over in either text. With matches in
    order of ``pos``, the best one to follow is a prefix maximum over ``other``, since the cost splits into a part of
    either match. Chains are read off from the best end on; a match is in one chain, and chains are cut at wide gaps.
    """
    where = pos, other
    order = np.lexsort((other, pos))
    pos, other = pos[order], other[order]
    step, leap = np.diff(pos), np.diff(other)
    if (step > 0).all() and (leap > 0).all() and (GAP * (step + leap) < SEED_WORDS).all():
        # All follow one another at less cost than they are worth: the best chain has them all.
        return [order] if len(order) > 1 else []
    ranks = np.unique(other, return_inverse=True)[1]
    tree, n = Fenwick(int(ranks.max()) + 1), len(pos)
    # Single items of lists are reached far sooner than those of arrays.
    rank, at_, cost = ranks.tolist(), pos.tolist(), (GAP * (pos + other)).tolist()
    score, before = [0.0] * n, [-1] * n
    k = 0
    while k < n:
        same = k
        while same < n and at_[same] == at_[k]:
            gain, prior = tree.most(rank[same])
            own = float(SEED_WORDS)
            if prior >= 0 and gain - cost[same] > 0:
                own += gain - cost[same]
                before[same] = prior
            score[same] = own
            same += 1
        for j in range(k, same):
            tree.put(rank[j], (score[j] + cost[j], j))
        k = same
    used, out = [False] * n, []
    for end in np.argsort(-np.array(score), kind="stable").tolist():
        chain, at = [], end
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(at)
            at = before[at]
        if len(chain) < 2:
            continue
        found = order[np.array(chain[::-1], dtype=np.int64)]
        # Passages don't go on over more than APART other words, so a gap never costs more than APART squared to align.
        wide = np.flatnonzero(np.maximum(np.diff(where[0][found]), np.diff(where[1][found])) > APART + SEED_WORDS) + 1
        out += [part for part in np.split(found, wide) if len(part) > 1] if len(wide) else [found]
    return out


def chains_of(start: np.ndarray, end: np.ndarray, pos: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains of many groups of matches, each a stretch of the arguments: the matches of all chains in turn, and each chain's number of them and group."""
    size = end - start
    step, leap = np.diff(pos), np.diff(other)
    broken = np.concatenate([[0], np.cumsum(~((step > 0) & (leap > 0) & (GAP * (step + leap) < SEED_WORDS)))])
    # Groups whose matches all follow one another are chains as they are.
    plain = (size > 1) & (broken[np.maximum(start, end - 1)] == broken[start])
    of = np.flatnonzero(plain)
    width = size[of]
    out = [np.repeat(start[of] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))]
    more: list[tuple[int, int]] = []
    for k in np.flatnonzero(~plain & (size > 1)).tolist():
        for chain in chains(pos[start[k] : end[k]], other[start[k] : end[k]]):
            out.append(start[k] + chain)
            more.append((len(chain), k))
    rest = np.array(more, dtype=np.int64).reshape(-1, 2)
    return np.concatenate(out), np.concatenate([width, rest[:, 0]]), np.concatenate([of, rest[:, 1]])


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence of two short runs."""
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    # A bit for each word of b, cleared where the length grows: one sum for each word of a.
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        met = row & places.get(x, 0)
        row = (row + met | row - met) & whole
    return len(b) - row.bit_count()


def draw(a: list[int], b: list[int]) -> tuple[int, int]:
    """How far two runs go on alike, and how many words match: the best prefix before the score falls by DROP.

    Past a mismatch the runs may go on with one word more in either.
    """
    i = j = score = best = matched = 0
    out = (0, 0, 0)
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            score, matched, i, j = score + 1, matched + 1, i + 1, j + 1
            if score > best:
                best, out = score, (i, j, matched)
            continue
        score -= MISMATCH
        if score <= best - DROP:
            break
        if a[i + 1 : i + 3] == b[j : j + 2] and j + 1 < len(b):
            i += 1
        elif a[i : i + 2] == b[j + 1 : j + 3] and i + 1 < len(a):
            j += 1
        else:
            i, j = i + 1, j + 1
    return out


def align(a: list[int], b: list[int], pos: list[int], other: list[int]) -> tuple[int, int, int, int, int]:
    """Spans in both texts of the passage about a chain, and its matching words."""
    i, j = pos[0], other[0]
    matched = 0
    end_i, end_j = i, j
    for p, o in zip(pos, other):
        if p < end_i or o < end_j:  # overlaps the seed before
            step = max(end_i - p, end_j - o)
            if step >= SEED_WORDS:
                continue
            p, o = p + step, o + step
            width = SEED_WORDS - step
        else:
            width = SEED_WORDS
        if p - end_i == o - end_j and a[end_i:p] == b[end_j:o]:
            matched += p - end_i
        else:
            matched += common_words(a[end_i:p], b[end_j:o])
        matched += width
        end_i, end_j = p + width, o + width
    left = draw(a[:i][::-1], b[:j][::-1])
    right = draw(a[end_i:], b[end_j:])
    return i - left[0], end_i + right[0], j - left[1], end_j + right[1], matched + left[2] + right[2]


def seams(text: np.ndarray, own: np.ndarray, h: np.ndarray, of: np.ndarray, pos: np.ndarray, of_pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, own texts and places of both seeds, of the pairs of neighbouring shared seeds that no one least text explains.

    Such a pair lies where one shared stretch ends and the next begins. A pair that matches with one text lead over is
    not given: the passage is found in that text. ``text`` numbers the texts and must rise, and ``pos`` within each; a
    seed given twice makes pairs in either form.
    """
    new = np.r_[True, (text[1:] != text[:-1]) | (pos[1:] != pos[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(pos)] - 1
    open_ = ~bridged(text, own, of, pos, of_pos, np.cumsum(new) - 1)[:-1] & (text[first[:-1]] == text[first[1:]]) & (np.diff(pos[first]) <= NEAR)
    twice = last != first
    out = []
    for x, either in ((first, open_), (last, open_ & twice[:-1])):
        for y, both in ((first, either), (last, either & twice[1:])):
            a, b = x[:-1][both], y[1:][both]
            step = of_pos[b] - of_pos[a]
            ok = (of[a] != of[b]) | (step <= 0) | (step > NEAR)
            a, b = a[ok], b[ok]
            out.append((mix(h[a] ^ mix(h[b])).view(np.int64), own[a], pos[a], pos[b]))
    return tuple(np.concatenate(x) for x in zip(*out))


def bridged(text: np.ndarray, own: np.ndarray, of: np.ndarray, pos: np.ndarray, of_pos: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each place of matches, whether what follows up to the next one lies between two matches with one other text than its own.

    Such matches follow each other at nearly one distance, near enough for their chain to lead over what is between.
    ``place`` numbers the places in order.
    """
    order = np.lexsort((of, text))
    i, of, at, apart, place = text[order], of[order], pos[order], (pos - of_pos)[order], place[order]
    near = (i[1:] == i[:-1]) & (of[1:] == of[:-1]) & (of[1:] != own[order][1:]) & (np.diff(at) <= 2 * NEAR) & (np.abs(np.diff(apart)) <= SEED_WORDS)
    n = int(place.max()) + 1
    return np.cumsum(np.bincount(place[:-1][near], minlength=n) - np.bincount(place[1:][near], minlength=n)) > 0


def stretches(text: np.ndarray, pos: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of matches that begin a stretch, and words, from and to, outside of which no exact passage can lie that another text has.

    A passage's own minimizers are shared and at most WINDOW apart; they leave WINDOW - 1 words at most before the first
    and behind the last seed.
    """
    start = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (np.diff(pos) > WINDOW)])
    end = np.r_[start[1:], len(pos)] - 1
    a, b = np.maximum(0, pos[start] - WINDOW + 1), pos[end] + SEED_WORDS + WINDOW - 1
    long = b - a >= passage
    return start[long], a[long], b[long]


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Lists of ints that follow one another in ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, identity: float = IDENTITY) -> DataFrame:
    """Passages of at least ``passage`` words that different rows share, edits allowed.

    Every seed that several texts have is matched with its place in the least of them (by hash of the text), so matches
    grow with the texts, not with pairs of them; a passage's seeds agree on that text but for those which edits broke
    there. Matches of two texts are chained, and chains that reach far enough aligned word by word.

    Returns id, start_word, end_word (words are runs of letters, digits and underscores, from 0), n_words, matched,
    kind and other_id (the least id of the text it was found in, or matched by). Kinds: ``copy``, a whole text that
    other rows have too; ``repeat``, a passage found in another text; ``source``, the places in a text where others'
    were found, those which overlap as one. Null texts, empty ones and those under ``passage`` words
    have none; rows alike in text are copies of each other, whatever their ids; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = KnownWords(), set()
        for batch in batches:
            fresh = []
            for k, key in enumerate(batch["t"].tolist()):
                if key in seen:
                    continue
                if len(seen) > 500_000:  # forgetting only means that a copy is seen again
                    seen.clear()
                seen.add(key)
                fresh.append(k)
            keys = batch["t"].to_numpy()[fresh]
            for first, values, bounds in hashed_texts(batch["text"].iloc[fresh].tolist(), known):
                own = keys[first : first + len(bounds) - 1]
                h, at, whose = minimizers(values, bounds)
                yield pd.DataFrame({"h": np.concatenate([h.view(np.int64), own]), "t": np.concatenate([own[whose], own]), "pos": np.concatenate([at, -np.diff(bounds)])})

    # A text's row with place -n, under a hash of its own, says that it has n words.
    places = rows.select("t", "text").mapInPandas(seeds, "h long, t long, pos int")

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of rows in order of seed, text and place: those of seeds that several texts have, with the seed's first, and the numbers of words.

        Of a seed that a batch ends in, its rows wait for the next batch while they are of one text; once several have it,
        its first is all that is kept, however many rows there are.
        """
        waiting, known = pd.DataFrame({"h": [], "t": [], "pos": []}, dtype=np.int64), None
        for batch in batches:
            if batch.empty:
                continue
            h, t, pos = (np.concatenate([waiting[c].to_numpy(), batch[c].to_numpy()]).astype(np.int64) for c in ("h", "t", "pos"))
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            first_t, first_pos = t[start], pos[start]
            if known and known[0] == h[0]:
                first_t[0], first_pos[0] = known[1:]
            size = np.diff(np.r_[start, len(h)])
            of, of_pos = np.repeat(first_t, size), np.repeat(first_pos, size)
            several = np.logical_or.reduceat(t != of, start)
            if known and known[0] == h[0]:
                several[0] = True
            known = (int(h[-1]), int(first_t[-1]), int(first_pos[-1])) if several[-1] else None
            tail = start[-1] if known is None else len(h)
            waiting = pd.DataFrame({"h": h[tail:], "t": t[tail:], "pos": pos[tail:]})
            out = np.flatnonzero(np.repeat(several, size)[:tail] | (pos[:tail] < 0))
            yield pd.DataFrame({"t": t[out], "pos": pos[out], "h": h[out], "of": of[out], "of_pos": of_pos[out]})
        rest = waiting[waiting["pos"] < 0]
        yield pd.DataFrame({"t": rest["t"], "pos": rest["pos"], "h": rest["h"], "of": rest["t"], "of_pos": rest["pos"]})

    held_by = save(spread(places, "h").sortWithinPartitions("h", "t", "pos").mapInPandas(shared, "t long, pos int, h long, of long, of_pos int"), "shared")
    lengths = held_by.filter("pos < 0").groupBy("t").agg((-F.min("pos")).alias("n_words"))
    # By text: the first text of a seed itself takes part too, as its pairs and long runs may be others' partners.
    matches = held_by.filter("pos >= 0").groupBy("t").agg(F.collect_set(F.struct("pos", "h", "of", "of_pos")).alias("m")).filter(F.size("m") > 1)
    matches = matches.select("t", *[F.col(f"m.{c}").alias(c) for c in ("pos", "h", "of", "of_pos")])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["pos"]).to_numpy(zero_copy_only=False))
            pos, h, of, of_pos = (batch[c].flatten().to_numpy().astype(np.int64) for c in ("pos", "h", "of", "of_pos"))
            order = np.lexsort((h, pos, text))
            text, pos, h, of, of_pos = (x[order] for x in (text, pos, h, of, of_pos))
            own = batch["t"].to_numpy()[text]
            at, a, b = stretches(text, pos, passage)
            yield linked_rows("run", own[at], np.zeros_like(at), np.c_[a, b].ravel(), np.full(len(at), 2))
            key, t, a, b = seams(text, own, h.view(np.uint64), of, pos, of_pos)
            yield linked_rows("pair", t, key, np.c_[a, b].ravel(), np.full(len(key), 2))
            group = np.lexsort((of, text))
            text, own, of, pos, of_pos = (x[group] for x in (text, own, of, pos, of_pos))
            start = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (of[1:] != of[:-1])])
            end = np.r_[start[1:], len(group)]
            # A chain needs two matches that are far enough apart.
            far = (pos[end - 1] - pos[start] >= max(1, REACH - SEED_WORDS)) & (of[start] != own[start])
            chained, sizes, k = chains_of(start[far], end[far], pos, of_pos)
            p, o, ends = pos[chained], of_pos[chained], np.cumsum(sizes)
            wide = p[ends - 1] + SEED_WORDS - p[ends - sizes] >= REACH
            inside, k = np.repeat(wide, sizes), start[far][k[wide]]
            yield linked_rows("chain", own[k], of[k], p[inside], sizes[wide], o[inside])

    def linked_rows(what: str, t: np.ndarray, of: np.ndarray, pos: np.ndarray, sizes: np.ndarray, of_pos: np.ndarray | None = None) -> pa.RecordBatch:
        others = lists(pos[:0], np.zeros_like(sizes)) if of_pos is None else lists(of_pos, sizes)
        return pa.RecordBatch.from_arrays([pa.array([what]).take(pa.array(np.zeros_like(sizes))), pa.array(t), pa.array(of), lists(pos, sizes), others], ["what", "t", "of", "pos", "of_pos"])

    links = save(matches.mapInArrow(linked, "what string, t long, of long, pos array<int>, of_pos array<int>"), "chains")
    found = links.filter("what = 'chain'").select("t", "of", "pos", "of_pos")

    def hubs(keyed: DataFrame) -> DataFrame:
        """Places of a text (``pos``) and of the least text with the same key (``of``), by both texts."""
        first = keyed.groupBy("key").agg(F.min(F.struct("t", "pos")).alias("first"), F.max("t").alias("last")).filter("first.t < last")
        both = keyed.join(first.select("key", F.col("first.t").alias("of"), F.col("first.pos").alias("of_pos")), "key").filter("t <> of")
        return both.groupBy("t", "of").agg(F.collect_set(F.struct("pos", "of_pos")).alias("m"))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.repeat(np.arange(batch.num_rows), 2 * pc.list_value_length(batch["m"]).to_numpy(zero_copy_only=False))
            # Each match has two places in either text; no place twice.
            pos, other = (pc.struct_field(batch["m"].flatten(), c).flatten().to_numpy().astype(np.int64) for c in ("pos", "of_pos"))
            order = np.lexsort((other, pos, group))
            group, pos, other = (x[order] for x in (group, pos, other))
            new = np.r_[True, (group[1:] != group[:-1]) | (pos[1:] != pos[:-1]) | (other[1:] != other[:-1])]
            group, pos, other = group[new], pos[new], other[new]
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            chained, sizes, k = chains_of(start, np.r_[start[1:], len(group)], pos, other)
            k = group[start[k]]
            yield pa.RecordBatch.from_arrays([batch["t"].take(pa.array(k)), batch["of"].take(pa.array(k)), lists(pos[chained], sizes), lists(other[chained], sizes)], ["t", "of", "pos", "of_pos"])

    chain_columns = "t long, of long, pos array<int>, of_pos array<int>"
    pairs = save(hubs(links.filter("what = 'pair'").select(F.col("of").alias("key"), "t", "pos")).mapInArrow(paired, chain_columns), "pairs")
    spanned = found.groupBy("t", "of").agg(F.collect_list(F.struct(F.element_at("pos", 1).alias("a"), F.element_at("pos", -1).alias("b"))).alias("spans"))
    inside = F.exists("spans", lambda x: (x["a"] <= F.element_at("pos", 1)) & (x["b"] >= F.element_at("pos", -1)))
    pairs = pairs.join(spanned, ["t", "of"], "left").filter(~F.coalesce(inside, F.lit(False))).drop("spans")
    runs = links.filter("what = 'run'").select("t", F.struct(F.col("pos")[0].alias("a"), F.col("pos")[1].alias("b")).alias("run"))
    runs = save(runs.groupBy("t").agg(F.flatten(F.collect_set(F.array("run.a", "run.b"))).alias("runs")), "runs")
    members = save(rows.select("id", "t"), "members")
    texts = save(members.groupBy("t").agg(F.min("id").alias("least_id"), F.count("*").alias("copies")), "texts")
    wanted = found.unionByName(pairs).select(F.explode(F.array("t", "of")).alias("t")).unionByName(runs.select("t")).distinct()
    # Of copies the row of least id is read.
    wanted = save(wanted.join(texts, "t").select(F.col("t").alias("want"), F.col("least_id").alias("want_id")), "wanted")

    def hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownWords()
        for batch in batches:
            for first, values, bounds in hashed_texts(batch["text"].to_pylist(), known):
                # Half a hash tells words apart well enough, beside a seed or fifty in a row.
                words = lists((values >> np.uint64(32)).astype(np.uint32).view(np.int32), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([batch["t"].slice(first, len(words)), words], ["t", "words"])

    own = (F.col("t") == F.col("want")) & F.col("id").eqNullSafe(F.col("want_id"))
    words = save(matching(rows, "t", wanted, "want", own).select("t", "text").mapInArrow(hashes_of, "t long, words array<int>"), "words")
    if words.groupBy("t").count().filter("count > 1").limit(1).count():  # rows alike in id and text
        words = save(words.dropDuplicates(["t"]), "words_once")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Windows that follow one another in both texts are one passage, alike word for word."""
        for batch in batches:
            out = []
            for t, of, pos, other in zip(batch["t"], batch["of"], batch["pos"], batch["of_pos"]):
                order = np.lexsort((pos, pos - other))
                pos, other = pos[order].astype(np.int64), other[order].astype(np.int64)
                cut = np.flatnonzero((np.diff(pos) != 1) | (np.diff(other) != 1)) + 1
                for a, b in zip(np.r_[0, cut].tolist(), (np.r_[cut, len(pos)] - 1).tolist()):
                    out.append((t, of, int(pos[a]), int(pos[b]) + passage, int(other[a]), int(other[b]) + passage, int(pos[b]) - int(pos[a]) + passage))
            yield pd.DataFrame(out, columns=["t", "of", "start_word", "end_word", "of_start", "of_end", "matched"])

    def those(wanted: DataFrame, name: str) -> DataFrame:
        """The words of the texts that ``want`` names, with what else is given of each; others' stay where they are."""
        return matching(words, "t", save(wanted, name), "want", F.col("t") == F.col("want")).drop("want")

    # Of either text only the stretch about the chain goes on.
    def about(chained: DataFrame, reach: int) -> DataFrame:
        # Either side reads only the texts that it needs; those that others lead to are far fewer.
        own, other = (those(chained.select(F.col(c).alias("want")).distinct(), f"needed_{c}") for c in ("t", "of"))
        cut = lambda w, p: F.slice(w, F.greatest(F.lit(1), F.element_at(p, 1) + 1 - reach), F.element_at(p, -1) - F.greatest(F.lit(0), F.element_at(p, 1) - reach) + SEED_WORDS + reach)
        start = lambda p: F.greatest(F.lit(0), F.element_at(p, 1) - reach)
        near = chained.join(own, "t").select("t", "of", "pos", "of_pos", cut(F.col("words"), "pos").alias("a"), start("pos").alias("a0"), F.size("words").alias("a_all"))
        near = near.join(other.withColumnRenamed("t", "of"), "of")
        return near.select("t", "of", "pos", "of_pos", "a", "a0", "a_all", cut(F.col("words"), "of_pos").alias("b"), start("of_pos").alias("b0"), F.size("words").alias("b_all"))

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                s, e, os, oe, matched = align(r.a.tolist(), r.b.tolist(), [p - r.a0 for p in r.pos], [p - r.b0 for p in r.of_pos])
                n = max(e - s, oe - os)
                # Where the passage reaches the end of what was looked at, it may go on in both texts.
                more = (s == 0 and r.a0 > 0) or (os == 0 and r.b0 > 0) or (e == len(r.a) and r.a0 + e < r.a_all) or (oe == len(r.b) and r.b0 + oe < r.b_all)
                if more or min(e - s, oe - os) >= passage and matched >= identity * n:
                    out.append((r.t, r.of, s + r.a0, e + r.a0, os + r.b0, oe + r.b0, matched, more, r.pos, r.of_pos))
            yield pd.DataFrame(out, columns=["t", "of", "start_word", "end_word", "of_start", "of_end", "matched", "more", "pos", "of_pos"])

    def passages_of(chained: DataFrame, name: str) -> DataFrame:
        """The passages about the chains; the few that outgrow what was looked at are aligned again over more."""
        reach, found = MARGIN * passage, None
        while True:
            done = save(about(chained, reach).mapInPandas(aligned, f"{span_columns}, more boolean, pos array<int>, of_pos array<int>"), f"{name}_{reach}")
            some = done.filter("not more").drop("more", "pos", "of_pos")
            found = some if found is None else found.unionByName(some)
            chained = done.filter("more").select("t", "of", "pos", "of_pos")
            if not chained.limit(1).count():
                return found
            reach *= 64

    span_columns = "t long, of long, start_word int, end_word int, of_start int, of_end int, matched int"
    spans = passages_of(found.unionByName(pairs), "spans")

    def sides(spans: DataFrame) -> DataFrame:
        """Where either text of a passage has it."""
        own = spans.select("t", F.struct("start_word", "end_word").alias("s"))
        return own.unionByName(spans.select(F.col("of").alias("t"), F.struct(F.col("of_start").alias("start_word"), F.col("of_end").alias("end_word")).alias("s")))

    # Of those that begin at a word the longest: no more rows than words.
    held = sides(spans).groupBy("t", "s.start_word").agg(F.max("s.end_word").alias("end_word"))
    held = save(held.groupBy("t").agg(F.collect_list(F.struct("start_word", "end_word")).alias("held")), "held")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Windows of a text's stretches that no passage found so far holds whole (open), and the others that ``listed`` may have."""
        for batch in batches:
            h, t, pos = [], [], []
            for key, lo, values, runs, held in zip(batch["t"].tolist(), batch["lo"].tolist(), batch["words"], batch["runs"], batch["held"]):
                n = lo + len(values)
                closed = np.zeros(n + 1, dtype=np.int64)
                for x in held if held is not None else ():
                    if x["end_word"] - x["start_word"] >= passage:
                        closed[min(x["start_word"], n)] += 1
                        closed[min(x["end_word"] - passage + 1, n)] -= 1
                inside = np.cumsum(closed) > 0
                for a, b in zip(runs[::2].tolist(), runs[1::2].tolist()):
                    keys = long_grams(values[a - lo : b - lo].view(np.uint32).astype(np.uint64), passage)
                    # A window that comes again in a stretch is told by its number, so that its places don't multiply.
                    turn = turns(keys)
                    keys = np.where(turn > 0, mix(keys ^ mix(turn.astype(np.uint64))), keys).view(np.int64)
                    at = np.arange(a, a + len(keys))
                    ok = ~inside[at] if listed is None else inside[at] & listed(keys)
                    h.append(keys[ok])
                    pos.append(at[ok])
                    t.append(np.full(int(ok.sum()), key))
            if h:
                yield pd.DataFrame({"key": np.concatenate(h), "t": np.concatenate(t), "pos": np.concatenate(pos)})

    # Windows of ``passage`` words that lie in no passage yet may still be shared: with each other, or with one that does.
    # Of a text only what lies from its first stretch to its last goes on.
    outer = those(runs.select(F.col("t").alias("want"), F.array_min("runs").alias("lo"), F.array_max("runs").alias("hi")), "outer")
    outer = outer.select("t", "lo", F.slice("words", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("words"))
    stretched = save(outer.join(runs, "t").join(held, "t", "left"), "stretched")
    listed = None
    open_ = save(stretched.mapInPandas(exact, "key long, t long, pos int"), "open")
    listed = bitmap(open_, "key")
    same = open_.unionByName(save(stretched.mapInPandas(exact, "key long, t long, pos int"), "closed"))
    same = hubs(same).select("t", "of", *[F.col(f"m.{c}").alias(c) for c in ("pos", "of_pos")]).mapInPandas(joined, span_columns)
    spans = spans.unionByName(save(same, "same"))
    copies = texts.filter("copies > 1").join(lengths, "t").filter(F.col("n_words") >= passage).select(
        "t", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), F.col("n_words").alias("matched"), F.lit("copy").alias("kind"), F.col("least_id").alias("other_id")
    )
    named = spans.join(texts.select(F.col("t").alias("of"), F.col("least_id").alias("other_id")), "of")
    repeats = named.groupBy("t", "start_word", "end_word").agg(F.max("matched").alias("matched"), F.min("other_id").alias("other_id"))
    repeats = repeats.select("t", "start_word", "end_word", "matched", F.lit("repeat").alias("kind"), "other_id")
    # In the texts where passages were found: the stretches that they cover, where they overlap or touch as one.
    ends = spans.join(texts.select("t", F.col("least_id").alias("other_id")), "t").groupBy(F.col("of").alias("t"), F.col("of_start").alias("start_word"))
    ends = ends.agg(F.max("of_end").alias("end_word"), F.max("matched").alias("matched"), F.min("other_id").alias("other_id"))
    by_start = W.partitionBy("t").orderBy("start_word")
    apart = F.col("start_word") > F.max("end_word").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    ends = ends.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("stretch", F.sum("apart").over(by_start))
    back = ends.groupBy("t", "stretch").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.max("matched").alias("matched"), F.min("other_id").alias("other_id"))
    back = back.select("t", "start_word", "end_word", "matched", F.lit("source").alias("kind"), "other_id")
    out = members.join(copies.unionByName(repeats).unionByName(back), "t")
    return out.select(F.col("id").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "matched", "kind", F.col("other_id").cast(kind).alias("other_id"))
