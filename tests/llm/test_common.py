import numpy as np
import pyarrow as pa

from quillspark.llm import common


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (120, 2))] + [(-5, 7), (7, 7), (9, -5), (7, -5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    got = common.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in touched)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_map_groups_gives_whole_groups(spark):
    df = spark.range(5000).selectExpr("id % 37 AS k", "id AS v").repartition(5)

    def fn(table, offsets):
        k, v = table.column("k").to_numpy(), table.column("v").to_numpy()
        for a, b in zip(offsets[:-1], offsets[1:]):
            assert len(set(k[a:b])) == 1 and (np.diff(v[a:b]) > 0).all()
            yield pa.RecordBatch.from_pydict({"k": [int(k[a])], "n": [int(b - a)]})

    got = common.map_groups(df, ["k"], ["v"], fn, "k long, n long", min_rows=10).collect()
    assert sorted((r.k, r.n) for r in got) == [(k, 5000 // 37 + (k < 5000 % 37)) for k in range(37)]


def test_span_hashes():
    data = np.frombuffer(b"abcabcxabc", np.uint8)
    p = common.prefix_hashes(data)
    h = common.span_hashes(p, np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]
