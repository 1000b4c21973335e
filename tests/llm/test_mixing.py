import re
from collections import Counter

import numpy as np

from quillspark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(seed=0, n=600):
    rng = np.random.default_rng(seed)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 40))), "abcde"[int(min(4, rng.geometric(0.4) - 1))]) for i in range(n)]
    return rows + [(9000, None, "a"), (9001, "x y", None), (9002, "only", "empty-ish"), (9003, "", "zero"), (5, "w w w w", "a"), (5, "w w w w", "a"), (None, "q r s", "b")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "own") for i, t, s in rows], "doc_id long, text string, source string, size string")


def brute_targets(sizes):
    """Water filling by exact shares in rounds."""
    from fractions import Fraction

    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: i % 3 + 1 for i, k in enumerate(order)}
    total, target, free = Fraction(sum(sizes.values())), {}, set(order)
    while free:
        share = total / sum(weight[k] for k in free)
        over = [k for k in free if share * weight[k] > 3 * sizes[k]]
        if not over:
            return target | {k: share * weight[k] for k in free}
        for k in over:
            target[k] = Fraction(3 * sizes[k])
            total -= target[k]
            free.discard(k)
    return target


def test_targets_and_taken(spark):
    rows = documents()
    df = frame(spark, rows)
    plan = mixing.plan_mix(df, block_words=50)
    got = mixing.mixed(df, plan).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) < 1e-6
        assert r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - float(want[s])) <= max(6, 0.02 * float(want[s])), (s, taken[s], want[s])
    again = mixing.mixed(df.repartition(7), mixing.plan_mix(df.repartition(5), block_words=50)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_tree(spark):
    df = frame(spark, documents(1))
    plan = mixing.plan_mix(df, block_words=20, shard_words=1500)
    assert plan.shards >= 4
    leaves = np.zeros((plan.shards, len(plan.sources)), np.int64)
    for k, (shard, upto) in enumerate(mixing.leaves(plan)):
        leaves[shard, k] = np.diff(upto, prepend=0)
        assert (np.diff(shard) > 0).all()
    assert (leaves.sum(axis=0) == mixing.quotas(plan)).all()
    assert leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= int(np.log2(plan.shards)) + 1
    # what the documents take is what the leaves hold
    got = mixing.dealt(mixing.sized(df, plan.seed), plan).collect()
    held, words = Counter(), Counter()
    for r in got:
        assert r.taken == r["size"] * len(r.shards) and len(r.shards) <= 3
        for shard, i in zip(r.shards, r._instances):
            held[r._k, i] |= 1 << shard
            words[shard] += r["size"]
    for (k, i), mask in held.items():
        shard, upto = mixing.leaves(plan)[k]
        assert mask == 1 << int(shard[np.searchsorted(upto, i, side="right")])  # a block instance is in one shard
    assert sum(words.values()) == sum(r.taken for r in got) and len(words) == plan.shards
    ordered = mixing.write_order(df, plan)
    assert ordered.count() == sum(len(r.shards) for r in got) == mixing.taken_rows(df, plan).count()
    assert Counter(r.shard for r in ordered.collect()) == Counter(s for r in got for s in r.shards)
    assert mixing.taken_rows(df, plan).columns == df.columns and set(df.columns) <= set(ordered.columns)


def test_leaves_follow_the_hypergeometric_distribution():
    sources = tuple(mixing.Source(str(k), 10, 1, quota=n) for k, n in enumerate((30, 60, 10)))
    drawn = []
    for seed in range(800):
        shard, upto = mixing.leaves(mixing.Plan(sources, seed, 2))[0]
        drawn.append(int(np.diff(upto, prepend=0)[shard == 0].sum()))
    # of 50 drawn from 100, 30 of them of the source
    assert abs(np.mean(drawn) - 15) < 0.4 and abs(np.var(drawn) - 50 * 0.3 * 0.7 * 50 / 99) < 1


def test_long_texts_and_a_hot_source(spark):
    rows = [(i, "w " * 20_000 if i % 50 == 0 else "a b c", "hot" if i % 3 else f"s{i % 40}") for i in range(300)]
    df = frame(spark, rows)
    got = mixing.mixed(df, mixing.plan_mix(df, shard_words=50_000)).collect()
    assert len(got) == 300 and {r["size"] for r in got} == {20_000, 3}
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        left = mine[0].target - sum(r.taken for r in mine)
        once = Counter()
        for r in mine:
            if r.taken < 3 * r["size"]:
                once[r.doc_id] += r["size"]
        assert 0 <= left < min(once.values(), default=1) + 1


def test_empty(spark):
    df = frame(spark, [])
    plan = mixing.plan_mix(df)
    assert mixing.mixed(df, plan).count() == 0 and mixing.taken_rows(df, plan).count() == 0


def test_nothing_that_fits_is_left(spark):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        sizes = [(int(i), int(rng.integers(5, 80)), "a") for i in range(200)]
        sizes.append((200, sum(n for _, n, _ in sizes) // 2, "a"))  # a third of its source
        sizes += [(1000 + i, int(rng.integers(5, 80)), "b") for i in range(200)] + [(1000 + i, 9, "b") for i in range(3)] + [(5000, 3, None)]
        df = frame(spark, [(i, " ".join(["w"] * n), s) for i, n, s in sizes])
        got = mixing.mixed(df, mixing.plan_mix(df, seed=seed, block_words=100)).select("doc_id", "source", "size", "target", "taken").collect()
        for s in ("a", "b", None):
            left = {r.source: r.target for r in got}[s] - sum(r.taken for r in got if r.source == s)
            once = Counter()  # equal documents go together
            for r in got:
                if r.source == s and r.taken < 3 * r["size"]:
                    once[r.doc_id, r["size"]] += r["size"]
            assert 0 <= left < min(once.values(), default=1), (seed, s, left)


def test_columns_of_the_caller_pass(spark):
    own = ["_k", "_blocks", "_quota", "_name", "_key", "_place", "_within", "_row", "_starts", "_limits", "_instances"]
    rows = [(i, f"some words of document {i}", f"s{i % 3}", *range(11), "mine", 7.0) for i in range(30)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *own, "Target", "size"])
    plan = mixing.plan_mix(df)
    out = mixing.mixed(df, plan)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and set(out.columns) == {"doc_id", "text", "source", *own, *mixing.RESULTS}
    for r in out.collect():
        assert [r[c] for c in own] == list(range(11)) and r["size"] == 5 and r.target > 0
    assert mixing.taken_rows(df, plan).columns == df.columns
