import numpy as np
import pytest

from quillspark.llm import jaccard


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    classes = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            classes[r] = min(d, classes.get(r, d))
    return sorted(((d, classes.get(root(i)), links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def documents(seed, near=40):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(2000)]
    out = [None, "", "  ", "one two", "one two", "one  two", "a b c d e", "a b c d e f"]
    base = [words[i] for i in rng.integers(0, 2000, 200)]
    for i in range(near):  # a dense group
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 200))] = f"x{i}"
        out.append(" ".join(w))
    for i in range(60):  # pairs around the threshold, and passages that others share
        w = [words[k] for k in rng.integers(0, 2000, int(rng.integers(6, 150)))]
        v = list(w)
        for _ in range(max(1, len(w) // 60)):
            v[int(rng.integers(0, len(v)))] = f"y{i}"
        out += [" ".join(w), " ".join(v), " ".join(w + base[:60])]
    out += [out[10], out[60], out[60]]
    return [(i, t) for i, t in zip(rng.permutation(len(out)).tolist(), out)]


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    return df, jaccard.join(df, **how)


@pytest.mark.parametrize("seed,small,block", [(1, 64, 1024), (2, 3, 8)])
def test_against_brute_force(spark, seed, small, block):
    rows = documents(seed)
    _, got = run(spark, rows, small=small, block=block)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=repr) == brute(rows)


def test_keep_one(spark):
    rows = documents(3, 10)
    rows += [rows[12], (None, "lonely row"), (None, None)]
    df, _ = run(spark, rows)
    kept = sorted((r.doc_id for r in jaccard.keep_one(df).collect()), key=repr)
    want = {c for d, c, _ in brute(rows) if c is not None}
    assert [d for d in kept if d is not None] == sorted(want, key=repr)
    assert kept.count(None) == 2
    assert jaccard.keep_one(df).columns == df.columns
    assert jaccard.join(df.limit(0)).count() == 0


def test_recall_target():
    assert jaccard.runs_needed(0.8) >= 12
    rng = np.random.default_rng(5)
    # a pair at the threshold: 200 tokens each, 178 shared
    missed = 0
    for t in range(300):
        tokens = jaccard.mix(rng.integers(0, 1 << 62, 222).astype(np.uint64))
        a, b = tokens[:200], tokens[22:]
        found = False
        for r in range(jaccard.runs_needed(0.8)):
            level = [[(np.uint64(r), a, b)]]
            paths = [np.uint64(r * 7919 + t)]
            for _ in range(jaccard.DEPTH):
                odd = [jaccard.mix(np.array([p], np.uint64))[0] | np.uint64(1) for p in paths]
                limit = np.uint64(2.0**64 / (jaccard.LAMBDA * 200))
                paths = [q for p, o in zip(paths, odd) for q in jaccard.mix(np.intersect1d(a[a * o < limit], b[b * o < limit]) ^ p)]
            found = found or bool(paths)
        missed += not found
    assert missed <= 1


@pytest.mark.parametrize("same", [None, 7])
def test_keep_one_under_one_id(spark, same):
    texts = [" ".join(f"{g}{i}" for i in range(100)) + end for g in "ab" for end in ("", " x", " y")]
    df, got = run(spark, [(same, t) for t in [*texts, texts[0], "quite another text"]])
    kept = [r.text[:2] for r in jaccard.keep_one(df).collect()]
    assert sorted(kept) == ["a0", "b0", "qu"]
    assert got.select("class_key").distinct().count() == 3


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_patterned_words(spark, n):
    w = "a"
    while len(w) < n:
        w += w.translate({97: 98, 98: 97})
    line = [f"w{i}" for i in range(40)]
    texts = [" ".join([*line[:20], x, *line[20:]]) for x in (w, w.translate({97: 98, 98: 97}), w + " end")]
    rows = list(enumerate(texts))
    _, got = run(spark, rows)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=repr) == brute(rows)
