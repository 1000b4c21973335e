import math

import numpy as np

from quillspark.llm import langid

WORDS = {"en": "the and of with that this house water", "de": "und der die nicht über straße wasser haus", "es": "el la que niño agua casa está los"}


def documents(n=240, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        w = WORDS[lang].split()
        rows.append((i, " ".join(w[k] for k in rng.integers(0, len(w), int(rng.integers(1, 40)))), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, 0.5) for i, t, x in rows], "doc_id long, text string, lang string, score double")


def test_accuracy_and_edges(spark):
    train = frame(spark, documents() + [(900, None, "en"), (901, "text without a language", None), (902, "", "de")])
    model = langid.fit(train)
    assert model.languages == ["de", "en", "es"] and 0.05 <= model.temperature <= 20
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "en"), (1003, "the house " * 20_000, "en")]
    test = documents(90, 5)
    got = {r.doc_id: r for r in langid.predict(frame(spark, test + odd), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und"] * 3 + ["en"]
    again = langid.fit(train.repartition(5))
    assert (again.weights == model.weights).all() and again.temperature == model.temperature


def test_document_frequencies_cover_all(spark):
    rows = documents(50)
    df, n = langid.document_frequencies(frame(spark, rows).select("text").repartition(4), langid.DEFAULT)
    want = sum((np.bincount(langid.buckets(t, langid.DEFAULT), minlength=1 << 15) > 0).astype(int) for _, t, _ in rows)
    assert n == 50 and (df == want).all()


def test_l1_makes_zeros():
    rng = np.random.default_rng(1)
    rows = [(k % 2, np.array([k % 2, 5 + int(rng.integers(0, 500))]), np.array([0.9, 0.1])) for k in range(200)]
    weak, _ = langid.learn(rows, 2, langid.Settings(bits=10, l1=0.0))
    strong, _ = langid.learn(rows, 2, langid.Settings(bits=10, l1=0.5))
    assert (strong != 0).sum() < (weak != 0).sum() and strong[0, 0] > 0 > strong[0, 1]


def test_temperature():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert abs(langid.temperature(logits * 4, labels) - 4) < 0.5


def test_empty(spark):
    empty = frame(spark, [])
    model = langid.fit(empty)
    assert langid.predict(empty, model).count() == 0
    assert langid.predict(frame(spark, [(1, "words", None)]), model).first().lang_pred == "und"


def test_learning_and_prediction_against_plain_loops():
    """Every coordinate in plain Python: FTRL with elastic net, then the softmax at the temperature."""
    rng = np.random.default_rng(3)
    s = langid.Settings(bits=8, epochs=2)
    rows = [(int(k % 3), np.unique(rng.integers(0, 256, 6)), None) for k in range(40)]
    rows = [(k, at, rng.random(len(at)) + 0.1) for k, at, _ in rows]
    z, n = [[0.0] * 3 for _ in range(257)], [[0.0] * 3 for _ in range(257)]

    def weight(i, c):
        if abs(z[i][c]) <= s.l1:
            return 0.0
        return -(z[i][c] - math.copysign(s.l1, z[i][c])) / ((s.beta + math.sqrt(n[i][c])) / s.alpha + s.l2)

    for epoch in range(s.epochs):
        for k in np.argsort(langid.mix(np.arange(len(rows), dtype=np.uint64) + np.uint64(epoch << 32))):
            label, at, x = rows[k]
            pairs = [*zip(at.tolist(), x.tolist()), (256, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in pairs for c in range(3)}
            logits = [sum(v * w[i, c] for i, v in pairs) for c in range(3)]
            e = [math.exp(v - max(logits)) for v in logits]
            for i, v in pairs:
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == label))
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / s.alpha
                    z[i][c] += g - sigma * w[i, c]
                    n[i][c] += g * g
    weights, bias = langid.learn(rows, 3, s)
    assert np.allclose(weights, [[weight(i, c) for c in range(3)] for i in range(256)], atol=1e-6)
    assert np.allclose(bias, [weight(256, c) for c in range(3)])
    idf = rng.random(256) + 1
    model = langid.Model(s, ["x", "y", "z"], idf, weights, bias, 1.7)
    text = "Aé b"
    counts = {}
    padded = " aé b "
    for size in (1, 2, 3):
        for i in range(len(padded) - size + 1):
            h = ord(padded[i])
            for c in padded[i + 1 : i + size]:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            b = int(langid.mix(np.array([(h + (size << 56)) % 2**64], np.uint64))[0]) >> 56
            counts[b] = counts.get(b, 0) + 1
    x = {b: (1 + math.log(c)) * idf[b] for b, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    logits = [(sum(v / norm * float(weights[b, c]) for b, v in x.items()) + bias[c]) / 1.7 for c in range(3)]
    e = [math.exp(v - max(logits)) for v in logits]
    lang, score = model.predict(text)
    assert lang == "xyz"[int(np.argmax(logits))] and abs(score - max(e) / sum(e)) < 1e-6


def test_copies_count_once_and_every_language_is_learned(spark):
    rows = documents(90) + [(1000 + i, "the same text over and over", "en") for i in range(3000)] + [(5000 + i, f"zz{i} yy xx", f"l{i:03}") for i in range(230)]
    s = langid.Settings(sample_per_language=20, epochs=1)
    df = frame(spark, rows).repartition(4)
    text = langid.F.col("text")
    keyed = df.select("lang", langid.F.xxhash64(text, langid.F.lit(17)).alias("key"))
    got = langid.drawn(keyed, s).collect()
    want = {}
    for r in keyed.distinct().collect():
        want.setdefault(r.lang, []).append(r.key)
    assert sorted(map(tuple, got)) == sorted((k, x) for k, v in want.items() for x in sorted(v)[:20])
    model = langid.fit(df, s=s)
    assert len(model.languages) == 233
    again = langid.fit(df.unionByName(df.where("lang = 'en'")), s=langid.replace(s, bits=10))
    assert again.languages == model.languages


def test_accuracy_on_held_out_documents(spark):
    from quillspark.llm import queries_langid

    got = queries_langid.op10_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(truth, "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
