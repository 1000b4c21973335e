import duckdb
import pandas as pd
import pytest

from quillspark.llm import lines
from quillspark.llm.queries_lines import OP6_SQL
from pyspark.sql import functions as F


def documents():
    rows = []
    for i in range(40):
        own = "".join(chr(97 + int(d)) for d in str(i))
        body = [f"{own} {own}x sits near {own}y", "Share this page with friends now", f"Posted on 2024-0{i % 9} by user{i}", "", "  "]
        if i % 3 == 0:
            body.append(f"read more stories about {'abcdefghij'[i // 3 % 10]}x today and tomorrow please everyone")
        if i % 4 == 0:
            body.append("only\tfew   documents") if i < 12 else body.append(f"prose line number {i} that stands alone here")
        rows.append((i, "\n".join(body)))
    return rows + [(100, None), (101, ""), (102, "Share this page with friends now"), (103, "x" * 30_000), (104, "Share this page with friends now\nShare this page with friends now")]


def generalised():
    """Leaves whose lines differ in a token or two: some documents have several of them, some templates recur on their own."""
    words = "amber birch cedar delta ember fjord grove heath inlet jetty knoll".split()
    rows = [(i, f"the quiet road runs past {w} and then down to the sea again") for i, w in enumerate(words)]
    rows += [(20 + i, "\n".join(f"many variants of one page with {w} in the middle of it" for w in words[i : i + 4])) for i in range(3)]
    rows += [(30 + i, "\n".join(f"five pages together hold a line about {w} here" for w in words[i : i + 2])) for i in range(6)]
    rows += [(40 + i, f"short {w} line") for i, w in enumerate(words)] + [(60 + i, f"a frequent line with {words[i // 6]} at its end for all") for i in range(12)]
    rows += [(80 + i, f"x{i} y{i} the two of them share nothing but digits {w}") for i, w in enumerate(words[:6])]
    return rows + [(90, "a long passage that two documents share and no others have\nown"), (91, "other\na long passage that two documents share and no others have")]


@pytest.mark.parametrize("long_docs", [None, lines.LONG_DOCS])
@pytest.mark.parametrize("data", [documents(), generalised()], ids=["documents", "generalised"])
def test_against_sql(spark, data, long_docs):
    df = spark.createDataFrame([(i, t, "n") for i, t in data], "doc_id long, text string, n_lines string")
    got = lines.deduplicate(df, long_docs=long_docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text"]))
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(con.execute(OP6_SQL.replace("{long_docs}", str(long_docs or lines.MIN_DOCS))).fetchall())
    if data == generalised() and not long_docs:
        dropped = {r[0] for r in rows if r[2]}
        assert set(range(1, 11)) <= dropped and 0 not in dropped  # one generalised template, eleven documents
        assert not dropped & {20, 21, 22}  # three documents only, however many lines


def test_what_goes(spark):
    out = {r.doc_id: r for r in lines.deduplicate(spark.createDataFrame(documents(), "doc_id long, text string")).collect()}
    assert "Share this page" in out[0].text and "Posted on" in out[0].text
    assert "Share this page" not in out[7].text and "Posted on" not in out[7].text and "hx sits" in out[7].text
    assert "read more stories" in out[0].text and "read more stories" not in out[9].text  # generalised in one place
    assert "only\tfew   documents" in out[8].text and out[100].text is None and out[102].text == ""
    assert (out[104].n_lines, out[104].n_dropped) == (2, 2)


def test_keep(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in documents()], "doc_id long, text string, source string")
    kept = lines.keep(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in df.collect()} - {r.doc_id for r in kept.collect()} == {102, 104}
    assert lines.keep(df.limit(0)).count() == 0


def test_long_lines_of_two_documents(spark):
    passage = "a planted passage of nine words stands right here"
    rows = [(1, f"{passage}\nshort line of two\nseven words and 1 2 3 4 more"), (2, f"other\n{passage}\nshort line of two\nseven words and 5 6 7 8 more"), (3, "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(map(tuple, lines.keep(df).collect())) == {1: rows[0][1], 2: "other\nshort line of two\nseven words and 5 6 7 8 more", 3: "own"}
    assert dict(map(tuple, lines.deduplicate(df).select("doc_id", "text").collect())) == dict(rows)


def test_variants_of_one_document_count_once(spark):
    def rows(*words):
        return "\n".join(f"list row of these fine things called {w} for sale" for w in words)

    data = [(1, rows("ax", "bx", "cx")), (2, rows("dx", "ex", "fx")), (3, "other text"), (4, "\n".join(f"one page with many variants named {w} inside" for w in "abcdefg")), (5, "one page with many variants named z inside")]
    five = [(10 + i, f"five pages do share this long line with {w} there") for i, w in enumerate("abcde")]
    out = {r.doc_id: r for r in lines.deduplicate(spark.createDataFrame(data + five, "doc_id long, text string")).collect()}
    assert {i: out[i].text for i, _ in data} == dict(data)
    assert [out[i].n_dropped for i, _ in five] == [0, 1, 1, 1, 1]


def test_repeated_rows_are_one_document(spark):
    line = "this very line stands in all of these rows"
    once = spark.createDataFrame([(1, line)] * 5 + [(7, line)], "doc_id long, text string")
    assert {(r.doc_id, r.n_dropped) for r in lines.deduplicate(once).collect()} == {(1, 0), (7, 0)}
    own = spark.createDataFrame([(i, line) for i in range(6)] + [(3, line)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_dropped) for r in lines.deduplicate(own).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (3, 1), (3, 1), (4, 1), (5, 1)]


def test_own_counts_pass_through(spark):
    rows = [(i, t, 5, "d", 1) for i, t in documents()]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_dropped string, _id int")
    kept = lines.keep(df)
    assert kept.columns == df.columns and {(r.n_lines, r.n_dropped, r._id) for r in kept.collect()} == {(5, "d", 1)}
