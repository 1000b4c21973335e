import pytest


def test_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, kept = docs.columns, docs
    counts = [docs.count()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, kept, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        counts.append(kept.count())
        if k < len(pipeline.STAGES) - 1:
            assert kept.columns == columns
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    assert [s for s, _ in pipeline.STAGES] == ["quality", "line_dedup", "ngram_jaccard", "mixing", "bpe"]
    again = pipeline.run(spark, "/root/testdata/sf0.001")
    key = lambda d: sorted((r.doc_id, r.ids_sha256, r.n_tokens) for r in d.collect())
    assert key(again) == key(kept)


CLASHES = "size string, n_lines int, node string, component int, shard string, epoch int, ids string, n_tokens int, _row int, _text string, _key int, words string"


def run_stages(spark, pipeline, docs, folder):
    kept, out = docs, []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, kept, None).write.parquet(str(folder / name))
        kept = spark.read.parquet(str(folder / name))
        out.append(kept)
        if k < len(pipeline.STAGES) - 1:
            assert kept.columns == docs.columns, name
    return out


def test_odd_input(spark, tmp_path):
    """Null texts, ids, languages and sources; empty, repeated and very long rows; columns with the stages' own names."""
    pipeline = pytest.importorskip("corpus_pipeline")
    prose = lambda tag, n=90: " ".join(f"{tag}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}o" for i in range(n))
    own = ("s", 1, "n", 2, "h", 3, "i", 4, 5, "t", 6, "w")
    rows = [(i, prose(f"d{chr(97 + i)}"), "en", f"src{i % 3}", 1, *own) for i in range(12)]
    rows += [(50, None, "en", "src0", 1, *own), (51, "", None, None, 1, *own), (None, prose("nul"), None, None, None, *own), (52, prose("lng", 676 * 30), "en", "src1", 1, *own)]
    rows += [rows[0], rows[0], (None, prose("nul"), "fr", None, 7, *own)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")
    out = run_stages(spark, pipeline, docs, tmp_path)
    ids = [sorted((r.doc_id for r in x.collect()), key=str) for x in out]
    good = sorted([*range(12), None], key=str)  # all but the null, the empty and the repetitive text
    assert ids[0] == ids[1] == sorted([*good, 0, 0, None], key=str) and ids[2] == good
    assert set(ids[3]) <= set(good) and ids[4] == ids[3] and len(ids[3]) > 6
    assert {c for c, _ in out[4].dtypes} >= {"n_tokens", "ids", "ids_sha256", "decoded_sha256", "size", "node"}
    empty = run_stages(spark, pipeline, docs.limit(0), tmp_path / "empty")
    assert all(x.count() == 0 for x in empty)


def test_tables_are_freed(spark, monkeypatch):
    import os

    from quillspark.llm import common

    pipeline = pytest.importorskip("corpus_pipeline")
    before = len(common._written)
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    left = [p for _, p in common._written[before:] if os.path.exists(p.replace("file://", ""))]
    assert out.count() > 0 and len(left) <= 2


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace as Thing

    from quillspark.llm import common

    none = Thing(get=lambda *a: None)
    spark = Thing(sparkContext=Thing(getConf=lambda: none, master="spark://host:7077"), conf=none)
    with pytest.raises(ValueError):
        common.shared_dir(spark)


def brute_lines(rows):
    """Exact templates of five documents, or of two where eight words are no variable field; the first document keeps its line."""
    def template(line):
        return tuple("<*>" if any(c in "0123456789" for c in w) else w for w in line.split())

    holders = {}
    for i, t in rows:
        for line in t.split("\n"):
            if line.split():
                holders.setdefault(template(line), set()).add(i)
    gone = {t: min(ids) for t, ids in holders.items() if len(ids) >= 5 or len(ids) >= 2 and sum(w != "<*>" for w in t) >= 8}
    out = []
    for i, t in rows:
        left = [x for x in t.split("\n") if not x.split() or gone.get(template(x), i) == i]
        if len(left) == len(t.split("\n")) or any(x.split() for x in left):
            out.append((i, "\n".join(left)))
    return out


def test_against_brute_force(spark, tmp_path):
    from collections import Counter

    import numpy as np
    import test_bpe
    import test_jaccard
    import test_mixing
    import test_quality

    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(11)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(3, 9))))
    prose = lambda n: " ".join(word() for _ in range(n))
    footer, passage, base = "share this page with friends", prose(12), [word() for _ in range(120)]
    rows = [(i, prose(int(rng.integers(55, 140)))) for i in range(60)]
    rows += [(100 + i, prose(70) + "\n" + footer + (f" 20{i}" if i % 2 else "")) for i in range(14)]
    rows += [(200 + i, prose(60) + "\n" + passage + "\n" + prose(20)) for i in range(3)] + [(210, passage + "\n" + passage)]
    for i in range(8):  # near copies
        w = list(base)
        w[int(rng.integers(0, 120))] = f"x{word()}"
        rows.append((300 + i, " ".join(w)))
    rows += [(400, rows[5][1]), (401, prose(20)), (402, "12 34 " * 60), (403, prose(60).upper()), (404, "a b c " * 40)]
    sources = {i: "abc"[i % 3] for i, _ in rows}
    docs = spark.createDataFrame([(i, t, "en", sources[i], len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = run_stages(spark, pipeline, docs, tmp_path)
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    want = sorted((i, t) for i, t in rows if test_quality.brute(t)[-1])
    assert texts(out[0]) == want and len(want) < len(rows)
    before, want = len(want), brute_lines(want)
    assert texts(out[1]) == sorted(want) and sum(t.count("\n") for _, t in want) < sum(t.count("\n") for _, t in rows) and len(want) <= before
    first = {c for _, c, _ in test_jaccard.brute(want)}
    before, want = len(want), [(i, t) for i, t in want if i in first]
    assert texts(out[2]) == sorted(want) and len(want) == before - 7  # one of the near copies stays
    # the mix: whole documents, three times at most, as many words as each source's target leaves room for
    taken, kept = Counter(r.doc_id for r in out[3].collect()), dict(want)
    assert set(taken) <= set(kept) and max(taken.values()) <= 3 and {t for t in texts(out[3])} <= set(want)
    sizes = Counter()
    for i, t in want:
        sizes[sources[i]] += len(t.split())
    for s, target in test_mixing.brute_targets(dict(sizes)).items():
        room = target - sum(n * len(kept[i].split()) for i, n in taken.items() if sources[i] == s)
        assert 0 <= room < min((len(t.split()) for i, t in want if sources[i] == s and taken[i] < 3), default=1)
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in out[4].collect())
    assert got == Counter({(i, tuple(ids), len(ids)): n for i, n in taken.items() for ids in [test_bpe.LIB.encode(kept[i], add_special_tokens=False).ids]})
