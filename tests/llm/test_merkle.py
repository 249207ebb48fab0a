"""Merkle proofs held against trees that are built as a whole."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import merkle


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def whole_tree(leaves):
    """The root, and each leaf's place and siblings by level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            paths[k].append((i % 16, "".join(run[: i % 16] + run[i % 16 + 1 :])))
        level = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 32, 255, 256, 257, 1000, 4095, 4096])
def test_traversal_gives_every_path(n):
    leaves = [h(str(k)) for k in range(n)]
    root, paths = whole_tree(leaves)
    levels = merkle.n_levels(n)
    assert levels == (0 if n == 1 else math.ceil(round(math.log(n, 16), 9)))
    assert merkle.block_root(leaves, levels) == root
    assert [list(zip(*p)) for p in merkle.traverse(leaves, levels)] == paths


def test_traversal_holds_few_nodes():
    tree = merkle.TreeHash(2)
    for k in range(16**3 - 1):
        tree.push(h(str(k)))
        assert all(len(s) < 16 for s in tree.stacks) and len(tree.nodes) <= 16


def rows(spark, sizes):
    rng = random.Random(2)
    out = [(k * 7 % 100_003, s, h(f"{s}{k}")) for s, n in sizes.items() for k in range(n)]
    rng.shuffle(out)
    return out, spark.createDataFrame(out, "doc_id long, source string, leaf string").repartition(3)


@pytest.mark.parametrize("block", [1, 3])
def test_manifest_equals_a_whole_tree(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "LEVELS", block)
    monkeypatch.setattr(merkle, "BLOCK", 16**block)
    sizes = {None: 3, "": 1, "a": 700, "b": 17, "é": 16, "z": 300} | {f"s{k}": 1 for k in range(20)}
    listed, df = rows(spark, sizes)
    want, tops = {}, []
    for s in sorted(sizes, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted((i, x) for i, t, x in listed if t == s)
        root, paths = whole_tree([x for _, x in leaves])
        tops.append(root)
        want |= {(s, i): (x, root, p) for (i, x), p in zip(leaves, paths)}
    top, above = whole_tree(tops)
    upper = dict(zip(tops, above))
    out = merkle.manifest(df.withColumn("tampered", F.when(F.col("doc_id") % 3 == 0, F.sha2("leaf", 256))))
    out = out.withColumn("folded", merkle.fold(F.coalesce("tampered", "leaf"), F.col("places"), F.col("siblings")))
    got = out.collect()
    assert len(got) == len(listed)
    for r in got:
        leaf, root, path = want[r.source, r.doc_id]
        assert (r.leaf, r.subroot, r.root) == (leaf, root, top)
        assert list(zip(r.places, r.siblings)) == path + upper[root]
        assert (r.folded == r.root) == (r.doc_id % 3 != 0)


def test_leaves_tell_fields_apart(spark):
    row = spark.createDataFrame([("é1", None, 12), ("", "x", None)], "a string, b string, c int")
    got = [r.h for r in row.select(merkle.leaf(F.col("a"), F.col("b"), F.col("c")).alias("h")).collect()]
    assert got == [h_bytes("3:é1-2:12"), h_bytes("0:1:x-")]


def h_bytes(x):
    return hashlib.sha256(x.encode("utf-8")).hexdigest()


def test_odd_rows(spark):
    big = (1 << 60) + 1
    data = [(big, "a", h("1")), (big, "a", h("1")), (None, "a", h("2")), (None, None, h("3")), (1, "a", h("4"))]
    df = spark.createDataFrame(data, "doc_id long, source string, leaf string").withColumns({c: F.lit("clash") for c in ("tree", "pos", "n", "node", "tops", "c0", "block", "_at")})
    got = merkle.manifest(df).collect()
    assert sorted((r.doc_id or 0, r.leaf) for r in got) == sorted((i or 0, x) for i, _, x in data)
    first = next(r for r in got if r.leaf == h("2"))
    assert first.places[0] == 0 and len({r.root for r in got}) == 1 and all(r.tree == "clash" for r in got)
    assert merkle.manifest(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(df.withColumn("Root", F.lit(1)))
    lone = merkle.manifest(df.filter("doc_id = 1")).collect()[0]
    assert lone.root == lone.subroot == lone.leaf and list(lone.places) == []
