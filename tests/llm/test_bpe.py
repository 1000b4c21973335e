import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import bpe
from quillspark.llm.queries_tokens import tokenizer_path

CODEC = bpe.codec(tokenizer_path())
LIB = Tokenizer.from_file(tokenizer_path())
CASES = ["", " ", "\n\n", "x\n\nabc", "a  b\t\tc  ", "it's we'll I'D", "été naïve Straße", "<|endoftext|>", "a<|endoftext|> b<|endoftext|", "日本語 テスト", "\x00\x1c\x85  x", "²Ⅷ½ 123abc", "🙂👍🏽 ok", "_a__b ##--", "a" * 5000, "word " * 3000]


def check(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIB.decode(ids, skip_special_tokens=False)
    n, a, b = CODEC.digest(text)
    assert (n, a) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert b == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_random(text):
    check(text)


def test_every_code_point():
    """All of Unicode, unassigned and private characters among it, beside letters, digits, marks and space."""
    for start in range(0, 0x110000, 4096):
        some = [chr(c) for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}!{c} {c}  " for c in some)
        if text:
            codec = bpe.Codec(tokenizer_path()) if start == 0 else CODEC
            assert codec.encode(text) == LIB.encode(text, add_special_tokens=False).ids, hex(start)


def test_special_tokens_of_any_form(tmp_path):
    import json

    spec = json.load(open(tokenizer_path()))
    spec["added_tokens"].append({"id": LIB.get_vocab_size(), "content": "[PAD]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = str(tmp_path / "padded.json")
    json.dump(spec, open(path, "w"))
    text = "some [PAD][PAD] text [pad] <|endoftext|>"
    assert bpe.Codec(path).encode(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    spec["added_tokens"][-1]["lstrip"] = True
    json.dump(spec, open(path, "w"))
    with pytest.raises(ValueError):
        bpe.Codec(path)


def test_forced_cuts_never_split_a_token():
    for raw in CODEC.token_bytes.values():
        if raw.decode("latin-1") not in CODEC.special:
            assert CODEC.fragments(raw) == [raw] or raw == b"<|endoftext|>"
    assert len(CODEC.fragments(b"a\x80\xffb")) > 1


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a b", "y"), (2, "a b", "y"), (3, "", "z")], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in bpe.round_trip(df, tokenizer_path()).collect()}
    assert (rows[1].n_tokens, rows[2].n_tokens, rows[3].n_tokens) == (0, 2, 0)
    assert rows[1].ids_sha256 == hashlib.sha256(b"").hexdigest() == rows[1].decoded_sha256
    ids = {r.doc_id: r.ids for r in bpe.round_trip(df, tokenizer_path(), ids="ids").collect()}
    assert ids == {1: [], 2: LIB.encode("a b").ids, 3: []}
    back = bpe.decode(bpe.encode(df, tokenizer_path()).drop("text"), tokenizer_path()).collect()
    assert sorted(r.text for r in back) == ["", "", "a b", "a b"]
    assert bpe.round_trip(df.limit(0), tokenizer_path()).count() == 0
