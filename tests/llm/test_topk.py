import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import topk


def brute(rows, wanted, k, scale=64):
    fine = [(n, i, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in fine:
        if wanted(i):
            s = sorted(((-sum(a * b for a, b in zip(q, v)), math.inf if j is None else j) for m, j, v in fine if m != n))[:k]
            out += [(i, r + 1, None if j == math.inf else j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out, key=repr)


def got(spark, rows, k, chunk=3):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, row int")
    return sorted((tuple(r) for r in topk.search(topk.build_index(df), "vec_id % 20 = 0", k, chunk).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200, None), (220, [1.0, None]), (240, [float("nan")]), (260, [float("inf")] * 6), (280, [0.0] * 6), (300, []), (0, [1.0]), (None, [9.0] * 6), (20, rows[20][1]), (320, [-0.001, 0.0])]
    assert got(spark, rows, 7) == brute(rows, lambda i: i is not None and i % 20 == 0, 7)
    assert got(spark, rows[:3], 7) == brute(rows[:3], lambda i: i % 20 == 0, 7)
    assert got(spark, [], 7) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.integers(1, 5))
def test_threshold_algorithm_with_ties(seed, n, d):
    rng = np.random.default_rng(seed)
    values = rng.integers(-2, 3, (n, d))
    block = topk.Block(topk._pack(np.arange(n), rng.permutation(n), values))
    q = rng.integers(-2, 3, d)
    old, topk.FIRST_DEPTH, topk.DEEPER = (topk.FIRST_DEPTH, topk.DEEPER), 1, 2
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    want = sorted((-int(values[j] @ q), int(block.ids[j])) for j in range(1, n))[:5]
    floor = None if len(want) < 5 or rng.integers(0, 2) else -want[4][0]
    try:
        s, i, ended, seen = topk.threshold_search(block, q, 0, 5, *none, floor)
    finally:
        topk.FIRST_DEPTH, topk.DEEPER = old
    assert ended == "bound" or seen == n - 1
    assert [(-int(a), int(b)) for a, b in zip(s, i)] == want
    assert (block.bounds(q[None, :])[0] >= values[1:] @ q).all()


def test_blocks_without_a_chance_are_not_walked(spark):
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(6, 12)) * 4
    rows = [(i, [float(x) for x in heads[i % 6] + rng.normal(size=12) * 0.05]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = topk.build_index(df, block=60)
    assert index.count() >= 6 and index.agg({"n": "sum"}).first()[0] == 600
    got_rows = sorted((tuple(r) for r in topk.search(index, "vec_id % 20 = 0", 7).collect()), key=repr)
    assert got_rows == brute(rows, lambda i: i % 20 == 0, 7)
    blocks = [topk.Block(r.asDict()) for r in index.collect()]
    skipped = walked = 0
    for home in blocks:
        for row in np.flatnonzero(home.ids % 20 == 0):
            q = home.exact[row]
            s, i, ended, seen = topk.threshold_search(home, q, home.rows[row], 7, np.zeros(0, np.int64), np.zeros(0, np.int64))
            for other in blocks:
                if other is not home:
                    skip = other.bounds(q[None, :])[0] < s[-1]
                    skipped, walked = skipped + skip, walked + (not skip)
                    assert skip or topk.threshold_search(other, q, -1, 7, s, i, s[-1])[2] in ("bound", "lists")
    assert skipped > walked


def test_stops_early():
    rng = np.random.default_rng(2)
    values = np.zeros((4000, 8), np.int64)
    values[np.arange(4000), rng.integers(0, 8, 4000)] = rng.integers(0, 1000, 4000)
    block = topk.Block(topk._pack(np.arange(4000), np.arange(4000), values))
    *_, ended, seen = topk.threshold_search(block, np.array([1, 0, 0, 0, 0, 0, 0, 0]), -1, 5, np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert ended == "bound" and seen < 400
