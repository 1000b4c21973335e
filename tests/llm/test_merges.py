"""op13 against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import merges
from quillspark.llm.queries_merges import rank_file

PATH, PATTERN = rank_file()
OWN = merges.ranks(PATH, PATTERN)
LIB = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=OWN.ids, special_tokens={})
CASES = ["", " ", "\n\n", "x\n\nabc", "a  b\t\tc  ", "it's we'll I'D", "été naïve Straße", "<|endoftext|>", "日本語 テスト", "\x00\x1c\x1d\x85  x\x1c \x1c", "²Ⅷ½ 123abc", "🙂👍🏽 ok", "a" * 5000, "ab" * 3000, "aaab" * 999, "word " * 3000, " " * 777, "ingthe" * 400]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert OWN.encode(text) == LIB.encode_ordinary(text)
    assert OWN.decode(OWN.encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(alphabet="abthing e", max_size=200))
def test_random(text):
    assert OWN.encode(text) == LIB.encode_ordinary(text)


def test_every_code_point():
    for start in range(0, 0x110000, 4096):
        text = "".join(f"a{c}1{c}!{c} {c}  " for c in map(chr, range(start, start + 4096)) if not "\ud800" <= c < "")
        assert OWN.encode(text) == LIB.encode_ordinary(text), hex(start)


@pytest.mark.parametrize("at_once", [1, 24, 10**9])
def test_many_words_together_are_what_each_is_alone(monkeypatch, at_once):
    """Merges applied in numpy, one by one, and mixed; the words' own order of ranks holds in all of them."""
    monkeypatch.setattr(merges, "AT_ONCE", at_once)
    rnd = random.Random(1)
    words = ["".join(rnd.choice(["a", "b", "th", "e", "ing", "in", "er", "é", "z", "."]) for _ in range(rnd.randint(1, 40))).encode() for _ in range(2000)] + [b"", b"aaaaaaa", b"the"]
    for w, ids in zip(words, OWN.replay(words)):
        assert ids.tolist() == ([] if not w else [OWN.ids[w]] if w in OWN.ids else LIB._encode_single_piece(w))


def test_a_lower_rank_that_a_merge_gives_rise_to_goes_first(tmp_path, monkeypatch):
    """A rank file in which longer tokens have lower ranks than what they are made of."""
    rnd = random.Random(5)
    tokens = {bytes([b]) for b in range(256)}
    long = ["".join(rnd.choice("abc") for _ in range(n)).encode() for n in (2, 2, 2, 3, 3, 4, 4, 5, 6) for _ in range(4)]
    for _ in range(5):
        extra = sorted({t for t in long if t not in tokens})
        rnd.shuffle(extra)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(extra)}
        path = str(tmp_path / f"{rnd.random()}.tiktoken")
        with open(path, "wb") as f:
            f.write(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        own, lib = merges.Ranks(path, PATTERN), tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
        for at_once in (1, 10**9):
            monkeypatch.setattr(merges, "AT_ONCE", at_once)
            assert [x.tolist() for x in own.replay([w.encode() for w in words])] == [lib.encode_ordinary(w) for w in words]


def test_a_rank_file_without_all_bytes_is_refused(tmp_path):
    path = tmp_path / "short.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        merges.Ranks(str(path), PATTERN)


def expected(text):
    ids = np.array(LIB.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("size,chunk", [(merges.SLICE, merges.CHUNK), (1_000, 200), (1, 1)])
def test_frame(spark, monkeypatch, size, chunk):
    """Slices and chunks of any size; repeated ids and rows, nulls, a text longer than a slice and than a stretch of words."""
    monkeypatch.setattr(merges, "STRETCH", 500)
    texts = [None, "", "a b", "a b", *CASES, "long " * 20_000 + "end", "é " * 3_000]
    rows = [(i // 2, t, "x", {"k": i}) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, other map<string,int>").repartition(3)
    out = merges.round_trip(df, PATH, PATTERN, ids="token_ids", size=size, chunk=chunk)
    assert out.columns == ["doc_id", "other", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    found = {r.other["k"]: r for r in out.collect()}
    assert len(found) == len(rows)
    for i, t in enumerate(texts):
        assert tuple(found[i])[2:5] == expected(t) and found[i].token_ids == LIB.encode_ordinary(t or "") and found[i].doc_id == i // 2
    back = merges.decode(out, PATH, PATTERN, "token_ids").collect()
    assert {r.other["k"]: bytes(r.text) for r in back} == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_no_rows_and_no_other_columns(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    assert sorted(r.n_tokens for r in merges.round_trip(df, PATH, PATTERN).collect()) == [0, 2]
    assert merges.round_trip(df.limit(0), PATH, PATTERN).count() == 0


def test_the_query_over_all_documents(spark):
    from quillspark.llm.queries_merges import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_merge_replay"](spark, sf).collect()}
    assert out == {i: expected(t) for i, t in texts.items()}
