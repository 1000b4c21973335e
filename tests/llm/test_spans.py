import hashlib
import os
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import spans, substrings, suffixes


def documents(seed, n=60):
    """Texts with copies, near copies, shared passages, repeats within, long and short ones."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}é"[: int(rng.integers(1, 4))] + str(i % 7) for i in range(300)]
    make = lambda k: [words[i] for i in rng.integers(0, 300, k)]
    passage, base = make(60), make(150)
    out = [None, "", "a", " \n\t ", "x" * 5000, "ab " * 1500]
    for i in range(n):
        kind = i % 6
        w = make(int(rng.integers(1, 120)))
        if kind == 1:
            w[len(w) // 2 : len(w) // 2] = passage
        elif kind == 2:
            w = list(base)
            w[int(rng.integers(0, 150))] = f"edit{i}"
        elif kind == 3:
            w = w + w
        elif kind == 4:
            w = list(base) + make(3)
        out.append((" " if i % 2 else "\n ").join(w))
    out += [out[20], out[21], "x" * 4000]
    ids = rng.permutation(len(out)).tolist()
    return list(zip(ids, out))


def brute_words(rows, k):
    rows = sorted(rows)
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            gone[j : j + k] |= key in seen
            seen.add(key)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def brute_bytes(rows, k):
    places = defaultdict(int)
    for _, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - k + 1):
            places[b[j : j + k]] += 1
    out = []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - k + 1):
            if places[b[j : j + k]] > 1:
                gone[j : j + k] = True
        gone = gone[: len(b)]
        n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        out.append((i, len(b), int(gone.sum()), n_spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, start string, id int").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = documents(seed)
    got = substrings.deduplicate(frame(spark, rows), text=False).collect()
    assert sorted(map(tuple, got)) == brute_words(rows, 20)


def alternating(n):
    """A word of n letters in the pattern that polynomial hashes modulo 2**64 can't see, and its complement."""
    w = "a"
    while len(w) < n:
        w += w.translate({97: 98, 98: 97})
    return w[:n], w[:n].translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_patterned_words(spark, n):
    one, other = alternating(n)
    line = [f"w{i}" for i in range(40)]
    rows = [(k, " ".join([*line[:15], w, *line[15:20], f"own{k}"])) for k, w in enumerate([one, other, one])]
    got = substrings.deduplicate(frame(spark, rows), text=False).collect()
    assert sorted(map(tuple, got)) == brute_words(rows, 20)


@pytest.mark.parametrize("bits", [2, 5, 64])
def test_verification_tells_colliding_names_apart(spark, bits):
    rows = documents(4, 30)
    got = substrings.deduplicate(frame(spark, rows), text=False, name_bits=bits).collect()
    assert sorted(map(tuple, got)) == brute_words(rows, 20)


def test_paths(spark):
    edges = [(1, 1, 0, 3, 17), (2, 8, 1, 3, 1), (3, 3, 8, 3, 1), (4, 4, 3, 2, 1), (5, 5, 4, 2, 9), (6, 6, 9, 2, 1)]
    df = spark.createDataFrame([(*e, 7, 0, e[0]) for e in edges], "unit long, tail long, left long, many long, n int, id long, tie long, at long")
    assert sorted((r.unit, r.n) for r in substrings.paths(df).collect()) == [(1, 19), (4, 10), (6, 1)]


@pytest.mark.parametrize("seed,hot", [(1, suffixes.HOT), (2, 2)])
def test_bytes(spark, seed, hot):
    rows = documents(seed)
    got = suffixes.deduplicate(frame(spark, rows), text=False, hot=hot, chunk=3000).collect()
    assert sorted(map(tuple, got)) == brute_bytes(rows, 200)


def test_patterned_and_colliding_bytes(spark):
    one, other = alternating(700)
    rows = documents(5, 24) + [(900, one), (901, other), (902, one[:400] + "z"), (903, "q" + other[:512])]
    for bits in (64, 3):  # with short names, verification finds collisions and starts again
        got = suffixes.deduplicate(frame(spark, rows), text=False, name_bits=bits).collect()
        assert sorted(map(tuple, got)) == brute_bytes(rows, 200)


def test_empty_and_repeated_rows(spark):
    assert substrings.deduplicate(frame(spark, []), text=False).count() == 0
    assert suffixes.deduplicate(frame(spark, [])).count() == 0
    text = " ".join(f"t{i}" for i in range(80))
    rows = [(None, text), (3, text), (3, text), (4, None)]
    got = {(r.doc_id, r.n_removed) for r in substrings.deduplicate(frame(spark, rows)).collect()}
    assert got == {(None, 80), (3, 0), (4, 0)}  # equal rows are one document
    got = {(r.doc_id, r.n_removed) for r in suffixes.deduplicate(frame(spark, rows)).collect()}
    assert got == {(None, len(text)), (3, len(text)), (4, 0)}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80).map(lambda b: bytes(x % 3 + 1 for x in b)))
def test_suffix_array(raw):
    t = np.frombuffer(raw + b"\0", np.uint8)
    order, eights = suffixes.suffix_array(t, 128)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())
    same = suffixes.common_prefixes(order, eights, 3) == 3
    for k in range(1, len(t)):
        a, b = t[order[k - 1] :].tobytes().ljust(3, b"\0")[:3], t[order[k] :].tobytes().ljust(3, b"\0")[:3]
        assert same[k] == (a == b)


def test_bit_map(spark):
    keys = np.random.default_rng(3).integers(0, 1 << 62, 5000)
    bits = spans.bit_map(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k")
    assert spans.in_map(bits, keys.astype(np.uint64)).all()
    assert spans.in_map(bits, np.arange(5000, dtype=np.uint64)).mean() < 0.01


@pytest.mark.parametrize("letters", [2, 26])
def test_runs_of_a_long_text_are_those_of_the_whole(monkeypatch, letters):
    """Stretches of a long text give the runs that one look at it gives, across seams and documents, for bytes and words."""
    rng = np.random.default_rng(letters)
    texts = ["".join(map(chr, 97 + rng.integers(0, letters, n))) for n in (0, 30, 7_000, 1, 45, 3_000)] + ["ab" * 900, "x" * 2_000]
    worded = [" ".join(map(str, rng.integers(0, letters, n))) for n in (900, 0, 3, 2_500)]
    for pieces, given, k, m in ((spans.byte_pieces, texts, 40, 8), (spans.word_pieces, worded, 20, 5)):
        found = []
        for stretch in (10**9, 1_000, 100, 41):
            monkeypatch.setattr(spans, "STRETCH", stretch)
            found.append([tuple(x.tolist() for x in (r.doc, r.at, r.n, r.mz, r.span, r.check)) for p in pieces(given) for r in [spans.runs_of(p, k, m)]])
        assert len(found[0][0][0]) > 20 and all(f == found[0] for f in found)


def test_covered_against_a_loop():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60):
        for _ in range(200):
            starts = rng.integers(0, n, rng.integers(0, 6))
            ends = np.minimum(n, starts + rng.integers(1, 9, len(starts)))
            want = [any(a <= i < b for a, b in zip(starts, ends)) for i in range(n)]
            assert spans.covered(starts, ends, n).tolist() == want


def test_memory_does_not_follow_a_texts_length():
    """A text of 50 MB beside a thousand short ones: the runs of all of them within a worker's bounds."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from quillspark.llm import spans
rng = np.random.default_rng(1)
texts = ["short text " * 30] * 1000 + [rng.integers(97, 123, 50_000_000, dtype=np.uint8).tobytes().decode()]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(len(r.at) for p in spans.byte_pieces(texts) for r in [spans.runs_of(p, 200, 24)])
spans.covered(np.array([5, 7_000_000]), np.array([300, 49_000_000]), 50_000_000)
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    n, peak = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).stdout.split())
    assert n > 400_000 and peak < 1_000
