import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import quality

WS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WS.findall(t)
    lines = [x for x in t.split("\n") if WS.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    repeat = len({j for i, g in enumerate(grams) if g in twice for j in (i, i + 1, i + 2)})
    n, chars, symbols, dup = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
    base = n < 50 or 100 * repeat > 50 * n
    bad = base or chars < 2 * n or chars > 16 * n or 4 * symbols > n or 5 * dup > 3 * len(lines)
    bad |= 10 * sum("0" <= c <= "9" for c in t) > 3 * chars or 2 * sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in t) < chars
    bad |= 10 * sum("A" <= c <= "Z" for c in t) > 7 * chars or 5 * sum(len(x) for x in w if len(x) >= 40) > chars
    bad |= 10 * sum(len(x[0]) for x in re.findall(r"(([.=~!?_-])\2{3,})", t)) > chars
    bad |= 2 * len(re.findall(r"(?:\.\.\.|…)[ \t]*(?:\n|\Z)", t)) > len(lines) or 10 * len(re.findall(r"(?:\A|\n)[ \t]*[-*•–][ \t]", t)) > 9 * len(lines)
    return (n, chars, symbols, dup, repeat, base, not bad)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
CASES = [None, "", " \n\t", "a", "a b", "a b c a b c", "a a a a a", "x\ny\nx\n\n \nx", "é ü 日本 🙂 " * 20, "one two three " * 40, "w%$ # " * 60, "\n".join(f"line {i % 4} of text here" for i in range(60)), " ".join(f"w{i}" for i in range(80)), "z" * 20_000 + " " + " ".join(f"k{i}" for i in range(60)), "a\x0bb\x0cc\rd\x1ce f"]
PLAIN = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)]
CASES += [
    " ".join(f"1234567{i}" for i in range(80)),
    " ".join(f"((){x[-2:]}" for x in PLAIN),
    " ".join(PLAIN).upper(),
    " ".join(PLAIN) + " " + "q" * 200,
    " ".join(PLAIN) + " " + ".... ===== ------ ??????? " * 4,
    "\n".join(" ".join(PLAIN[i : i + 8]) + "..." for i in range(0, 80, 8)),
    "\n".join("- " + " ".join(PLAIN[i : i + 8]) for i in range(0, 80, 8)),
]


def rows(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, kept string")
    return sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in quality.judge(df).collect())


def test_cases(spark):
    assert rows(spark, CASES) == [(i, *brute(t)) for i, t in enumerate(CASES)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab c\n#", max_size=60), max_size=12))
def test_random(spark, texts):
    assert rows(spark, texts) == [(i, *brute(t)) for i, t in enumerate(texts)]


def test_keep_and_order(spark):
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(CASES + CASES[-4:])], "doc_id int, text string, n_words int, _row_id int")
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(CASES + CASES[-4:]) if brute(t)[-1]]
    assert quality.keep(df.limit(0)).count() == 0
    for measured in (False, True):
        quality.estimate(df, measured=measured)
    cascade = quality.estimate(df)
    assert sorted(r.name for r in cascade.rules) == sorted(r.name for r in (quality.BASE, *quality.RULES))
    worth = [cascade.measured[r.name][1] / cascade.measured[r.name][0] for r in cascade.rules]
    assert worth == sorted(worth, reverse=True)


def test_rules_after_a_rejection_are_not_evaluated(spark):
    texts = [" ".join(PLAIN), " ".join(PLAIN[:10]), " ".join(PLAIN) + " 1", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    first = quality.Rule("first", ("n_words",), "n_words < 50")
    second = quality.Rule("second", (), f"CASE WHEN length({quality.TEXT}) < 400 THEN raise_error('evaluated') ELSE {quality.TEXT} LIKE '%1' END")
    third = quality.Rule("third", (), f"CASE WHEN {quality.TEXT} LIKE '%1' THEN raise_error('evaluated') ELSE false END")
    cascade = quality.Cascade((first, second, third))
    judged = quality.judge(df, cascade)
    assert [r.rejected_by for r in judged.orderBy("doc_id").collect()] == [None, "first", "second", "first"]
    assert cascade.evaluations(judged) == {"first": 4, "second": 2, "third": 1}


def test_every_rule_rejects_something(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id int, text string")
    for rule in quality.RULES:
        alone = quality.judge(df, quality.Cascade((rule,)))
        assert alone.where("rejected_by IS NOT NULL").count() > 0, rule.name
        assert alone.where("rejected_by IS NULL").count() > 0, rule.name


def test_columns_of_the_caller_pass(spark):
    own = ["_words", "_lines", "_grams", "_pairs", "_last", "_next", "_at", "_row", "_row_id", "_quality_text"]
    df = spark.createDataFrame([(1, "a word or two " * 30, *range(10), "x", True)], ["doc_id", "text", *own, "Kept", "n_words"])
    row = quality.judge(df).first()
    assert [row[c] for c in own] == list(range(10)) and row.n_words == 120 and row.kept in (True, False) and "Kept" not in row.asDict()
    assert row.text == "a word or two " * 30
    assert quality.keep(df).columns == df.columns
