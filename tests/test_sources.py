"""CSV over many ranges against Spark's own reader, the cache's waves, the life of intermediate tables, and the small sources and sinks."""

import gc
import io
import os
import random
import sys
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import corpus, likelihood
from quillspark.sources import readers, split_csv, storage


def csv_field(rnd):
    kind = rnd.random()
    if kind < 0.2:
        return rnd.choice(["", '""'])
    inside = "".join(rnd.choice(["a", "b", '""', "\n", "\r\n", ",", " ", "é", "\n\n", '"",""']) for _ in range(rnd.randint(0, 30)))
    return f'"{inside}"' if kind < 0.9 else f"plain {rnd.randint(0, 99)}"


@pytest.fixture
def split_size(spark):
    def put(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def by_spark(spark, path, header=True):
    return spark.read.option("header", header).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("closed", [True, False])
def test_csv_over_any_ranges_is_what_spark_reads(spark, tmp_path, split_size, end, closed):
    rnd = random.Random(closed)
    for k in range(2):
        rows = [["id", "text", "more"], *([str(i), csv_field(rnd), csv_field(rnd)] for i in range(200))]
        (tmp_path / f"f{k}.csv").write_bytes((end.join(",".join(r) for r in rows) + end * closed).encode())
    path = str(tmp_path)
    want = rows_of(by_spark(spark, path))
    for size in ("37", "501", "1g"):
        split_size(size)
        got = split_csv.read_csv(spark, path)
        assert got.columns == ["id", "text", "more"] and rows_of(got) == want, size
    split_size("37")
    lines = spark.read.option("lineSep", "\n").text(path)
    assert lines.rdd.getNumPartitions() > 50  # so many tasks read it
    assert rows_of(split_csv.read_csv(spark, path, header=False)) == rows_of(by_spark(spark, path, False))


def test_a_field_over_many_ranges_and_blank_lines(spark, tmp_path, split_size):
    long = "x\n" * 500 + 'he said ""so""\n' + "y" * 1000
    (tmp_path / "a.csv").write_text(f'﻿id,text\n\n1,"{long}"\n\n\n2,two\n3,"{long}"')
    split_size("64")
    got = split_csv.read_csv(spark, str(tmp_path), schema="id int, text string").collect()
    plain = long.replace('""', '"')
    assert sorted((r.id, r.text) for r in got) == [(1, plain), (2, "two"), (3, plain)]
    (tmp_path / "b.csv").write_text("id,text\n")
    assert split_csv.read_csv(spark, str(tmp_path / "b.csv")).collect() == []


def test_generations_from_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text('id,model,generation\nr1,human,"a ""quoted""\nline, two"\n')
    row = readers.read_flat(spark, str(tmp_path)).first()
    assert row.asDict() == {"id": "r1", "source_id": None, "domain": None, "model": "human", "decoding": None, "title": None, "generation": 'a "quoted"\nline, two'}


class Failing:
    """A scorer that fails at a wave, and notes which keys it scored."""

    def __init__(self, fails_at=None):
        self.calls, self.scored, self.fails_at = 0, [], fails_at

    def score(self, df, text_col="text"):
        self.calls += 1
        if self.calls == self.fails_at:
            raise RuntimeError("no more")
        self.scored.append({r.id for r in df.select("id").collect()})
        return df.withColumns({c: F.length(text_col).cast("double") for c in likelihood.LL_SCHEMA})


class FailingLate(Failing):
    """One whose task fails, so that a wave's folder is begun and not ended."""

    def score(self, df, text_col="text"):
        out = super().score(df, text_col)
        return out.withColumn("ll_perplexity", F.when(F.lit(self.calls == 2), F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("ll_perplexity")))


@pytest.mark.parametrize("kind", [Failing, FailingLate])
def test_waves_outlive_a_failure(spark, tmp_path, kind):
    cache = str(tmp_path / "cache")
    rows = [(f"k{i}", "w" * i) for i in range(40)] + [("k3", "w"), (None, "no key"), (None, "no key")]
    df = spark.createDataFrame(rows, "id string, text string")
    first = kind(fails_at=3)
    with pytest.raises(Exception):
        likelihood.score_pending(df, first, cache, wave_rows=10)
    kept = len(likelihood.committed(spark, cache))
    assert kept == (2 if kind is Failing else 1)
    done = set().union(*first.scored[:kept])
    assert {r.id for r in likelihood.read_cache(spark, cache, "id string").collect()} == done and 0 < len(done) < 41
    second = Failing()
    out = likelihood.score_pending(df, second, cache, wave_rows=10).collect()
    assert set().union(*second.scored) == {r[0] for r in rows} - done and sum(map(len, second.scored)) == 41 - len(done)
    assert len(out) == 41 and {(r.id, r.ll_perplexity) for r in out if r.id in ("k0", "k3", "k39", None)} == {("k0", 0.0), ("k3", 1.0), ("k39", 39.0), (None, 6.0)}
    third = Failing()
    assert likelihood.score_pending(df, third, cache).count() == 41 and third.calls == 0
    more = df.union(spark.createDataFrame([("new", "abc")], "id string, text string"))
    assert likelihood.score_pending(more, third, cache).count() == 42 and third.scored == [{"new"}]


def test_an_empty_corpus_has_an_empty_cache(spark, tmp_path):
    df = spark.createDataFrame([], "id long, text string")
    assert likelihood.score_pending(df, Failing(), str(tmp_path / "none")).collect() == []
    assert likelihood.committed(spark, str(tmp_path / "none")) == []


def test_a_settled_table_goes_with_its_frame(spark):
    folder = storage.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    df = storage.settled(spark.range(100))
    half = df.where("id % 2 = 0")
    mine = set(os.listdir(folder)) - before
    del df
    assert mine and half.count() == 50  # a frame made of it still reads it
    del half
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if not mine & set(os.listdir(folder)):
            break
        time.sleep(0.5)
    assert not mine & set(os.listdir(folder))


def test_fresh_paths_are_in_the_shared_folder(spark):
    a, b = storage.fresh_path(spark, "x"), storage.fresh_path(spark, "x")
    assert a != b and a.startswith(storage.shared_folder(spark))


def test_texts_from_standard_input(spark, monkeypatch, capsys):
    from quillspark import cli

    monkeypatch.setattr(sys, "stdin", io.StringIO("It is important to note that we delve into a rich tapestry. " * 12))
    code = cli.main(["-"])
    assert "<stdin>" in capsys.readouterr().out and code in (0, 1)
    assert readers.literal_text(spark, "x").collect() == [("<stdin>", "x")]


def test_json_lines_there_and_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one\ntwo \"q\" é", "human"), ("b", None, "ai")], "id string, text string, label string")
    readers.write_json(rows, str(tmp_path / "out"))
    readers.write_json(rows.limit(1), str(tmp_path / "out"), mode="append")
    back = readers.read_corpus(spark, [str(tmp_path / "out"), str(tmp_path / "absent")], {"domain": "misc"})
    found = sorted(((r.id, r.text, r.label, r.domain) for r in back.collect()), key=str)
    a, b = ("a", 'one\ntwo "q" é', "human", "misc"), ("b", None, "ai", "misc")
    assert found in ([a, a, b], [a, b, b])


def test_union_of_corpora_fills_what_one_lacks(spark):
    a = spark.createDataFrame([("1", "x", "s")], "id string, text string, source string")
    b = spark.createDataFrame([("2", "y", "m")], "id string, text string, model string")
    out = corpus.union_corpora(a, b, a)
    assert sorted((r.id, r.source, r.model) for r in out.collect()) == sorted([("1", "s", None), ("2", None, "m"), ("1", "s", None)])


def test_flat_lint_is_score_without_its_structs(spark):
    from quillspark.operators import heuristic

    df = spark.createDataFrame([(1, "We delve into a rich tapestry — a testament to it. " * 20), (2, None)], "doc_id long, text string")
    flat = {r.doc_id: r for r in heuristic.lint_flat(df).collect()}
    scored = {r.doc_id: r for r in heuristic.score(df).collect()}
    for i in (1, 2):
        assert all(flat[i][c] == scored[i][c] for c in flat[i].asDict()) and "signals" not in flat[i].asDict()
    assert flat[1].score > 0 and flat[2].score == 0


def test_small_goes_by_bytes(spark):
    df = spark.createDataFrame([("x" * 100, 1), (None, 2)], "word string, n long")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(storage.small(df, 148)) and not hinted(storage.small(df, 147)) and hinted(storage.small(df.limit(0), 0))


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    """A file of one row group has many splits by its bytes, and all rows in one of them."""
    from quillspark.sources.readers import spread

    path = str(tmp_path / "t")
    spark.range(0, 20_000, 1, 1).selectExpr("id", "md5(cast(id AS STRING)) AS text").write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > 4
        rows = spread(df).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
        assert max(rows) < 20_000 / 4 and sum(rows) == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
