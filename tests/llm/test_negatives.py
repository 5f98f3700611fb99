"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from resrisk.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<double>, id string, score string, v string, rank string"


def by_hand(rows, is_anchor, positives=5, first=10, window=(30, 90)):
    size = 0
    good = [(i, y, [math.floor(256 * c) for c in v]) for i, y, v in rows
            if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, _, v in good]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n)) if good else 0
    good = [r for r in good if len(r[2]) == size]
    anchors = {}
    for i, y, v in sorted(good):
        if is_anchor(i):
            anchors.setdefault(i, (y, v))
    out = []
    for a, (label, vector) in anchors.items():
        scored = {(-sum(x * y for x, y in zip(vector, v)), i, y == label) for i, y, v in good if i != a}
        same = sorted({(s, i) for s, i, own in scored if own})[:positives]
        for s, p in same:
            fits = sorted({(t, i) for t, i, own in scored if not own and window[0] * -s <= 100 * -t <= window[1] * -s})
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fits[:first], 1)]
    return sorted(out)


def run(spark, rows, every=5, **kw):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % every == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def clustered(n, size, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, size))
    return [(i, int(rng.integers(0, 4)), (middles[i % 6] + 0.2 * rng.normal(size=size)).tolist()) for i in range(n)]


@pytest.mark.parametrize("broadcast_bytes", [16 << 20, 0])
def test_equal_to_all_pairs(spark, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(negatives, "_CANDIDATES", 16)
    monkeypatch.setattr(negatives, "_ANCHORS", 8)
    rows = clustered(150, 6, 1)
    rows += [(1000 + i, i % 3, rows[7][2]) for i in range(40)]  # one common vector: ties
    rows += [(2000, 1, None), (2001, None, rows[0][2]), (2002, 1, [math.nan] * 6), (2003, 2, [math.inf] * 6), (None, 1, rows[0][2]),
             (2004, 1, [1.0] * 5 + [None]), (2005, 1, [1.0, 2.0]), (2006, 3, []), (2010, 3, [0.0] * 6), (2015, 9, rows[3][2])]
    rows += [rows[5], rows[5], (10, 3, rows[9][2]), (11, 3, rows[9][2])]  # repeated rows, shared keys
    got = run(spark, rows, broadcast_bytes=broadcast_bytes)
    assert got == by_hand(rows, lambda i: i % 5 == 0) and len(got) > 300


def test_no_anchors_no_partners_and_empty_tables(spark):
    rows = [(1, 0, [1.0]), (2, 0, [2.0]), (3, 1, [0.5])]
    assert run(spark, rows, every=7) == [] and run(spark, []) == [] and run(spark, [(5, 1, [1.0])]) == []
    assert run(spark, [(5, 1, [1.0]), (6, 1, [1.0])]) == []


def test_large_numbers_are_exact(spark):
    big = [(i, i % 2, [2.0 ** 18 + i, -(2.0 ** 18) - 3 * i, 2.0 ** 19 + i]) for i in range(12)]
    assert run(spark, big, window=(10, 100)) == by_hand(big, lambda i: i % 5 == 0, window=(10, 100)) != []


def test_trees_are_shortest_and_bounds_save_scores():
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(size=(40, 5)) * 256)
    order, parent, edge = negatives.spanning_tree(v)
    assert sorted(order) == list(range(40)) and parent[0] == -1 and all(p < i for i, p in enumerate(parent) if i)
    lengths = np.sqrt(((v[:, None] - v) ** 2).sum(2))
    joined, total = {0}, 0.0
    while len(joined) < 40:
        step = min((lengths[i, j], j) for i in joined for j in range(40) if j not in joined)
        joined.add(step[1])
        total += step[0]
    assert abs(edge[1:].sum() - total) < 1e-6 * total
    near = np.floor(v[:1] + rng.normal(size=(40, 5)))
    order, parent, edge = negatives.spanning_tree(near)
    block = {"ids": np.arange(40).tobytes(), "labels": np.zeros(40, np.int64).tobytes(), "vectors": near[order].tobytes(),
             "parent": parent.tobytes(), "edge": edge.tobytes(), "positive_ids": [[7]] * 40,
             "positive_scores": [[int(near[0] @ near[0])]] * 40}
    anchors = negatives._Anchors(block, 5, 10, (30, 90))
    far = np.floor(rng.normal(size=(1000, 5)) * 200)
    taken = anchors.meet(np.arange(100, 1100), np.ones(1000, np.int64), far)
    assert taken < 0.5 * 40 * 1000
    for a in range(40):
        s = far @ near[order][a]
        fits = [x for x in sorted(s, reverse=True) if anchors.low[a] <= x <= anchors.high[a]]
        assert list(anchors.found.scores[a]) == fits[:10]
