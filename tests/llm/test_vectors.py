"""op11 and op12 against plain loops: exact numbers, odd input, clashing columns."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import centroids, vectors, whitening

BIG = 1 << 40


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-BIG, BIG) | st.integers(-200, 200), min_size=3, max_size=3), max_size=8))
def test_packed_rows_come_back_and_are_equal_only_if_the_numbers_are(rows):
    x = np.array(rows, np.int64).reshape(-1, 3)
    packed = vectors.pack(x)
    assert vectors.unpack(packed, 3).tolist() == x.tolist()
    assert len(set(packed)) == len({tuple(r) for r in rows})
    assert vectors.unpack(packed, 5)[:, 3:].tolist() == [[0, 0]] * len(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-BIG, BIG), min_size=2, max_size=2), min_size=1, max_size=6))
def test_products_are_exact(rows):
    x = np.array(rows, np.int64)
    want = [[sum(a[k] * b[k] for k in range(2)) for b in rows] for a in rows]
    assert [[int(v) for v in r] for r in vectors.product(x, x.T)] == want


def lloyd(rows, k, rounds, length, scale=64, seed=1):
    """All of it over all rows, in Python's numbers."""
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == length and all(c is not None and math.isfinite(c) for c in v)]
    kept = [(i, [max(-centroids.LIMIT, min(centroids.LIMIT, c)) for c in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", vectors.pack(np.array([r[1]]))[0]))
    centres = [v for _, v in order[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for _ in range(rounds + 1):
        where = [min(range(len(centres)), key=lambda c: (apart(v, centres[c]), c)) for _, v in kept]
        last = centres
        centres = [[sum(col) // len(mine) for col in zip(*mine)] if (mine := [v for (_, v), w in zip(kept, where) if w == c]) else old for c, old in enumerate(centres)]
    far = [apart(v, last[w]) for (_, v), w in zip(kept, where)]
    by = {c: sum(d for d, w in zip(far, where) if w == c) for c in set(where)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last]
    return sorted(((i, w, d, by[w], sum(far), digest[w]) for (i, _), w, d in zip(kept, where, far)), key=str)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def clustered(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, cluster int, weight double")
    return sorted((tuple(r) for r in centroids.cluster(df, **how).select(*COLUMNS).collect()), key=str)


def some_vectors(n, length, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.round(rng.normal(size=length) * 3 + (i % 5) * 4, 1)]) for i in range(n)]


def test_lloyd_equals_a_plain_one(spark, monkeypatch):
    rows = some_vectors(60, 4)
    rows += [(100 + i, rows[7][1]) for i in range(40)] + [(7, rows[7][1]), (8, rows[3][1]), (None, [0.5] * 4), (None, [0.5] * 4)]
    rows += [(200, None), (201, [1.0, None, 2.0, 3.0]), (202, [1.0, float("nan"), 0.0, 0.0]), (203, [float("inf")] * 4), (204, [1.0] * 3), (205, []), (206, [1e300, -1e300, 0.0, -0.01])]
    for hot in (1_000, 5):  # with 5, the vector of 42 rows goes by broadcast
        monkeypatch.setattr(centroids, "HOT_ROWS", hot)
        for k, rounds in ((6, 3), (3, 0), (200, 2)):
            assert clustered(spark, rows, k=k, rounds=rounds, length=4) == lloyd(rows, k, rounds, 4)


def test_ties_go_to_the_smaller_number_and_sums_are_rounded_down(spark):
    rows = [(i, [x]) for i, x in enumerate([0.0, 2.0, 1.0, 1.0, -1.0, -2.0, -1.5])]
    assert clustered(spark, rows, k=2, length=1, scale=1) == lloyd(rows, 2, 3, 1, scale=1)
    same = [(i, [3.0]) for i in range(50)]
    assert {r[1] for r in clustered(spark, same, k=4, length=1)} == {0}


def test_no_vectors(spark):
    assert clustered(spark, [], length=4) == []
    assert clustered(spark, [(1, None), (2, [1.0])], length=4) == []


def plain_whitening(rows, components, scale=1024):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d, n = max(len(v) for _, v in kept), len(kept)
    x = [[max(-whitening.LIMIT, min(whitening.LIMIT, c)) + 100_000 for c in v] + [100_000] * (d - len(v)) for _, v in kept]
    s = [sum(c) for c in zip(*x)]
    y = [[n * a - b for a, b in zip(r, s)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return [i for i, _ in kept], n, [sum(a * a for a in r) for r in y], np.array([[float(Fraction(a, n)) for a in r] for r in y]) @ u / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("tile,rows_of_a_block", [(32, 1_024), (2, 3), (3, 1)])
def test_whitening_equals_a_plain_one(spark, tile, rows_of_a_block):
    rng = np.random.default_rng(5)
    rows = [(i, [float(a) for a in rng.normal(size=7) * np.arange(1, 8) / 50 + 0.3]) for i in range(90)]
    rows += [(5, rows[4][1]), (None, rows[9][1]), (91, rows[3][1][:5]), (92, None), (93, [0.1] * 6 + [None]), (94, [float("inf")] * 7), (95, [float("nan")] * 7)]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<double>, n int, whitened string")
    out = whitening.whiten(df, 4, tile=tile, rows=rows_of_a_block).collect()
    ids, n, deviation, w, explained = plain_whitening(rows, 4)
    assert len(out) == 4 * len(ids) and {r.n for r in out} == {n}
    assert sorted((str(r.vec_id), r.deviation) for r in out if r.component == 1) == sorted(zip(map(str, ids), deviation))
    for k in range(4):
        mine = sorted(r.whitened for r in out if r.component == k + 1)
        assert min(np.abs(np.array(mine) - np.sort(s * w[:, k])).max() for s in (1, -1)) < 1e-9
        assert [r.explained for r in out if r.component == k + 1] == pytest.approx([explained[k]] * len(ids), rel=1e-9)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9


def test_very_large_components_stay_exact(spark):
    rows = [(i, [float(3 ** (i % 9)) * 1e5, float(i % 4), -1e300 if i == 7 else 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, n, deviation, w, explained = plain_whitening(rows, 3)
    out = {(r.vec_id, r.component): r for r in whitening.whiten(df, 3, tile=2, rows=7).collect()}
    assert [out[i, 1].deviation for i in ids] == [x if x < 1 << 63 else None for x in deviation]
    assert out[0, 1].explained == pytest.approx(explained[0], rel=1e-9) and out[0, 1].identity_error < 1e-4


def test_components_without_spread(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<float>")
    out = whitening.whiten(same).collect()
    assert len(out) == 6 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in out} == {(None, None, None, 0)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)], "vec_id long, embedding array<float>")
    out = {(r.vec_id, r.component): r for r in whitening.whiten(line).collect()}
    assert out[0, 1].explained == pytest.approx(1) and out[0, 1].whitened is not None and out[0, 2].whitened is None
    assert whitening.whiten(same.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")).count() == 0
