import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.cli import main
from quillspark.operators import corpus, evaluate, likelihood, stats, train
from quillspark.operators.features import FEATURE_NAMES
from quillspark.operators.heuristic import score
from quillspark.sources import readers
from quillspark.streaming import lint as streaming


def labelled(spark, seed=1, n=200):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, float(rng.randint(0, 12)), rng.randint(0, 1), rng.choice("ab")) for i in range(n)], "id int, s double, y int, g string")


def pairwise(rows):
    p, q = [r.s for r in rows if r.y == 1], [r.s for r in rows if r.y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q))


def test_auc(spark):
    df = labelled(spark)
    rows = df.collect()
    assert stats.auc(df, "s", "y").first().auc == pytest.approx(pairwise(rows))
    for r in stats.auc(df, "s", "y", ["g"]).collect():
        assert r.auc == pytest.approx(pairwise([x for x in rows if x.g == r.g]))
    assert stats.auc(df.where("y = 1"), "s", "y").first().auc is None


def test_bootstrap(spark):
    df = labelled(spark, 2)
    a = stats.bootstrap_auc_ci(df, "s", "y", reps=300).first()
    b = stats.bootstrap_auc_ci(df.repartition(5), "s", "y", reps=300).first()
    assert a == b and a.lo < pairwise(df.collect()) < a.hi and a.reps_used == 300
    assert stats.bootstrap_auc_ci(df.limit(0), "s", "y").first().lo is None


def test_thresholds(spark):
    df = labelled(spark, 3)
    best = stats.best_threshold(df, "s", "y").first()
    f1 = {t: round(stats.confusion_at(df, "s", "y", t).first().f1, 4) for t in range(13)}
    assert best.f1 == max(f1.values()) and best.threshold == min(t for t in f1 if f1[t] == best.f1)
    assert stats.best_threshold(df.limit(0), "s", "y").first().threshold == 0.0
    assert stats.confusion_at(df.limit(0), "s", "y", 1.0).first().f1 == 0.0


def test_dist(spark):
    df = labelled(spark, 4, 37)
    v = sorted(r.s for r in df.collect())
    r = stats.dist(df, "s").first()
    assert (r.n, r.p25, r.p75, r.median, r.min, r.max) == (37, v[9], v[27], v[18], v[0], v[-1])


def test_split_and_samples(spark):
    df = spark.range(300).select("id", (F.col("id") % 60).alias("q"))
    parts = {r.q: r.part for r in corpus.grouped_split(df, "q", "id").collect()}
    assert sum(p == "test" for p in parts.values()) == 18 and len(parts) == 60
    assert corpus.balance_sample(df.withColumns({"source": F.lit(None).cast("string"), "label": F.col("q") % 2}), 10).count() == 20


def test_readers(spark, tmp_path, capsys):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x y", "label": "ai"}\n\n{"id": "2", "text": "z", "label": "human", "extra": 3}\n')
    (tmp_path / "s.jsonl").write_text('{"id": "1", "features": {"ll_perplexity": 1.5}}\n{"id": "1", "ll_perplexity": 2.5}\n')
    (tmp_path / "f.csv").write_text('id,domain,model,generation\n1,news,human,"two\nlines, ""quoted"""\n')
    (tmp_path / "t.txt").write_bytes(b"ok \xff end")
    df = readers.read_corpus(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "none.jsonl")], {"source": "?"})
    assert df.count() == 2 and df.first().source == "?" and "not found" in capsys.readouterr().err
    merged = corpus.merge_scores(df, readers.read_layer2(spark, str(tmp_path / "s.jsonl")))
    assert {r.id: r.ll_perplexity for r in merged.collect()} == {"1": 2.5, "2": None}
    assert readers.read_flat(spark, str(tmp_path / "f.csv")).first().generation == 'two\nlines, "quoted"'
    assert readers.read_texts(spark, [str(tmp_path / "t.txt")]).first().text == "ok � end"


def test_cli(spark, tmp_path, capsys):
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    good.write_text("plain text. " * 3)
    bad.write_text("It is important to leverage robust, scalable synergy. Moreover, we delve into it now. Furthermore, we unlock seamless value here. In essence, we empower all.")
    assert main([str(good)], spark) == 0 and main([], spark) == 2 and main(["--quiet", str(good), str(bad)], spark) == 1
    capsys.readouterr()
    assert main(["--json", str(bad)], spark) == 1
    r = json.loads(capsys.readouterr().out)[0]
    assert r["flagged"] and r["top_issues"] and set(r["features"]) == set(FEATURE_NAMES)
    main(["--json", str(tmp_path / "missing.txt")], spark)


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    out = streaming.lint_stream(streaming.read_stream(spark, str(tmp_path / "in"), "doc_id long, text string", files_a_batch=1))
    streaming.write_stream(out.select("doc_id", "score", "flagged"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    batch = streaming.lint_stream(docs).select("doc_id", "score", "flagged")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)


def test_likelihood(spark, tmp_path):
    base = spark.createDataFrame([(1, "the cat sat on the mat the cat ran"), (2, "a dog sat on a log")], "doc_id int, text string")
    pair = likelihood.NgramPair.fit(base, base)
    df = spark.createDataFrame([(1, "the cat sat"), (2, "zebra quantum flux"), (3, ""), (4, "one"), (5, None)], "doc_id int, text string")
    r = {x.doc_id: x for x in pair.score(df).collect()}
    assert len(r) == 5 and all(r[i][c] is None for i in (3, 4, 5) for c in likelihood.LL_SCHEMA)
    assert r[1].ll_perplexity < r[2].ll_perplexity
    # the expectation over contexts by brute force
    words = [w for t in base.collect() for w in t.text.split()]
    pairs = [p for t in base.collect() for p in zip(t.text.split(), t.text.split()[1:])]
    vocab = sorted(set(words))
    import math

    uni = lambda w: (words.count(w) + 1) / (len(words) + len(vocab) + 1)
    seen = lambda v: sum(a == v for a, _ in pairs)
    prob = lambda w, v: 0.5 * pairs.count((v, w)) / seen(v) + 0.5 * uni(w) if seen(v) else uni(w)
    xent = lambda v: sum(prob(w, v) * -math.log(prob(w, v)) for w in [*vocab, "<?>"])
    nll = [-math.log(prob(b, a)) for a, b in (("the", "cat"), ("cat", "sat"))]
    assert r[1].ll_mean_logprob == pytest.approx(-sum(nll) / 2)
    assert r[1].ll_binoculars == pytest.approx(sum(nll) / (xent("the") + xent("cat")))
    cache = str(tmp_path / "cache")
    ids = df.withColumnRenamed("doc_id", "id")

    assert likelihood.score_pending(ids.limit(2), pair, cache).count() == 2
    assert likelihood.score_pending(ids, pair, cache).count() == 5
    # features follow the text: rows without an id, and rows of one id, keep their own
    odd = spark.createDataFrame([(None, "the cat sat"), (7, "the cat sat"), (7, "zebra quantum flux")], "doc_id int, text string")
    got = sorted((str(x.doc_id), x.text, round(x.ll_mean_logprob, 9)) for x in pair.score(odd).collect())
    one, two = round(r[1].ll_mean_logprob, 9), round(r[2].ll_mean_logprob, 9)
    assert got == [("7", "the cat sat", one), ("7", "zebra quantum flux", two), ("None", "the cat sat", one)]


def test_batch_scorer(spark):
    def load():
        import os

        calls = []

        def model(texts):
            assert 0 < len(texts) <= 3 and all(len(t.split()) > 1 for t in texts)
            calls.append(os.getpid())
            return [(float(len(t)), float(t.count(" ")), None, 1.0) for t in texts]

        return model

    texts = ["", "   ", None, "one", *(f"text number {i} " * (i + 1) for i in range(10))]
    df = spark.createDataFrame([(t, "own") for t in texts], "text string, ll_perplexity string")
    got = {r.text: r for r in likelihood.BatchScorer("lengths", load, size=3).score(df).collect()}
    assert len(got) == 14 and all(got[t].ll_perplexity is None for t in texts[:4])
    assert all(got[t].ll_perplexity == len(t) and got[t].ll_surprisal_stdev is None for t in texts[4:])
    cut = likelihood.BatchScorer("cut lengths", load, size=3, max_words=4).score(df).collect()
    assert all(r.ll_perplexity == len(" ".join(r.text.split()[:4])) for r in cut if r.text in texts[4:])


def test_far_off_scores_and_many_ranges(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 1) + (i % 2), i % 2) for i in range(400)] + [(999, 1e12, 0), (998, -1e12, 1)]
    df = spark.createDataFrame(rows, "id int, s double, y int")
    assert stats.auc(df, "s", "y").first().auc == pytest.approx(pairwise(df.collect()))
    cut, *_ = stats._cut(stats.histogram(df, "s", "y"), [], 8)
    assert max(r["count"] for r in cut.groupBy("_bin").count().collect()) < 100
    few, many = (stats.bootstrap_auc_ci(df, "s", "y", reps=400, cells=c).first() for c in (1_000_000, 20))
    assert abs(few.lo - many.lo) < 0.02 and abs(few.hi - many.hi) < 0.02 and many.reps_used == 400
    x = df.select("id", F.when(F.col("id") % 3 > 0, F.col("s")).alias("s"))
    import statistics

    assert stats.medians(x, ["s"])["s"] == pytest.approx(statistics.median(r.s for r in x.collect() if r.s is not None))


def test_cli_with_a_reference(spark, tmp_path, capsys):
    text, ref = tmp_path / "t.txt", tmp_path / "r.txt"
    text.write_text("plain text about boats and the sea and a dog that was sick on the way home from the pier one day last year. " * 2)
    for i in range(4):
        (tmp_path / f"r{i}.txt").write_text(f"a dog and a boat near the sea {i} were there all day")
    refs = [str(tmp_path / f"r{i}.txt") for i in range(4)]
    assert main([str(text), "--json", "--ml", "--prob", "0.0", "--reference", *refs], spark) == 1
    assert "probability" in json.loads(capsys.readouterr().out)[0]
    assert main([str(text), "--ml", "--prob", "1.1", "--reference", *refs], spark) == 0


def test_train_and_evaluate(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, *(rng.gauss(y * 0.8, 1) for _ in range(2)), None if i % 9 == 0 else rng.gauss(0, 1), y) for i in range(300) for y in [rng.randint(0, 1)]]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, label int")
    m = train.train(df, names=["a", "b", "c"])
    # gradient of 1/2 |w|^2 + C * loss at the optimum
    import numpy as np

    x = np.array([[m["impute"][k] if r[k] is None else r[k] for k in "abc"] for r in df.collect()])
    z, y = np.clip((x - m["mean"]) / m["std"], -6, 6), np.array([r.label for r in df.collect()])
    p = 1 / (1 + np.exp(-(z @ m["coef"] + m["intercept"])))
    assert np.abs(m["coef"] + z.T @ (p - y)).max() < 1e-3 and abs((p - y).sum()) < 1e-3
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scored = score(docs).join(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), "doc_id").withColumns({"y": 1 - F.col("quality"), "question": F.col("lang"), "id": F.col("doc_id"), "domain": F.col("lang")})
    metrics = evaluate.evaluate(scored, scored, reps=50)
    evaluate.write_report(metrics, str(tmp_path), "some corpus", "test")
    report = (tmp_path / "report.md").read_text()
    assert "some corpus" in report and f"{metrics['parts']['train']['n_pos']} machine" in report
    if metrics["false_positives"]:
        assert "type_token_ratio" in (tmp_path / "misclassified.md").read_text()
    assert json.loads((tmp_path / "metrics.json").read_text())["auc"] == metrics["auc"]
    assert set(FEATURE_NAMES) <= set(metrics["feature_auc"]) and all(x in (tmp_path / "report.md").read_text() for x in ("operating threshold", "best F1", "both sides", "| 1 |"))
    rows = scored.withColumns({"era": F.lit("2022"), "model": F.lit("m")})
    table = evaluate.drift_report(rows, str(tmp_path / "drift.md"))
    assert "· human | " in table and "· m | " in table and (tmp_path / "drift.md").read_text() == table


def test_texts_without_a_label_are_not_parsed(spark):
    from quillspark.plans import queries

    plan = queries.labelled(spark, "/root/testdata/sf0.001").select("s", *FEATURE_NAMES)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner")
    assert "regexp_extract_all" in above and "regexp" not in below
