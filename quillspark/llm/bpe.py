"""Byte-level BPE encoding and decoding with forced-boundary splitting.

The pre-tokenizer's pattern cuts a text into pieces that never merge with each other. Inside a piece, two
neighbouring bytes that never stand side by side within any vocabulary entry can't be joined by any merge
either, so the piece is certainly cut there. The fragments between certain cuts are encoded on their own and
their ids concatenated; each is encoded once per worker and looked up after that (the table is emptied at a
fixed size, so memory is bounded).

The pattern's classes of characters depend on a version of Unicode. Each character beyond ASCII is tried once per worker on both
the pattern and the tokenizers library; texts with one that they class differently are cut by the library's pre-tokenizer.

Defined results: a null text is encoded as the empty one (no ids); very long texts are encoded whole; an empty table gives no rows; special
tokens that stand literally in a text become their id, as the tokenizers library does by default; repeated
rows and other columns are of no concern, a column named like a result is replaced.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, ship, tidy

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE_LIMIT = 100_000
ROWS = 256  # texts that are encoded before their results leave the worker


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file (byte-level BPE in the tokenizers library's JSON)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = (spec["model"]["type"], spec["pre_tokenizer"]["type"], spec["decoder"]["type"], spec.get("normalizer"))
        if kinds != ("BPE", "ByteLevel", "ByteLevel", None) or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if spec["model"].get(k)]
        odd += [k for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word") if t.get(k)]
        if odd or spec["pre_tokenizer"].get("use_regex") is False:
            raise ValueError(f"options that this encoder doesn't have: {odd or 'use_regex'} in {path}")
        alphabet = byte_alphabet()
        self._chars = str.maketrans({chr(b): c for b, c in enumerate(alphabet)})
        self._back = back = {c: b for b, c in enumerate(alphabet)}
        whole = Tokenizer.from_file(path)
        self._model, self._pre = whole.model, whole.pre_tokenizer
        self._tried, self._odd = set(map(chr, range(128))), set()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: dict[int, bytes] = {}
        joined = [bytearray(256) for _ in range(256)]
        for token, i in spec["model"]["vocab"].items():
            if token in self.special:
                continue
            raw = bytes(back[c] for c in token)
            self.token_bytes[i] = raw
            for a, b in zip(raw, raw[1:]):
                joined[a][b] = 1
        self.token_bytes |= {i: content.encode() for content, i in self.special.items()}
        #: joined[a][b] is 0 where a byte a before a byte b forces a cut
        self.joined = joined
        self._find = regex.compile(PATTERN).findall
        self._special = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._table: dict[str, tuple[int, str, bytes, bytes]] = {}

    def fragments(self, piece: bytes) -> list[bytes]:
        """`piece` cut wherever the vocabulary never joins the two bytes."""
        joined, out, start = self.joined, [], 0
        for i in range(1, len(piece)):
            if not joined[piece[i - 1]][piece[i]]:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def _piece(self, piece: bytes) -> tuple[int, str, bytes, bytes]:
        ids = [t.id for f in self.fragments(piece) for t in self._model.tokenize(f.decode("latin-1").translate(self._chars))]
        return self._entry(ids)

    def _entry(self, ids: list[int]) -> tuple[int, str, bytes, bytes]:
        return len(ids), ",".join(map(str, ids)), b"".join(map(self.token_bytes.__getitem__, ids)), array("i", ids).tobytes()

    def _library_pieces(self, run: str) -> list[bytes]:
        return [bytes(map(self._back.__getitem__, p)) for p, _ in self._pre.pre_tokenize_str(run)]

    def _has_odd(self, text: str) -> bool:
        """Whether the text has a character that pattern and library class differently."""
        characters = set(text)
        for c in characters - self._tried:
            self._tried.add(c)
            if any([p.encode() for p in self._find(x)] != self._library_pieces(x) for x in (f"a{c}a", f"1{c}1", f"!{c}!", f"a {c}", f"a{c} a", f"!{c} {c}{c}")):
                self._odd.add(c)
        return bool(self._odd) and not self._odd.isdisjoint(characters)

    def _parts(self, text: str | None) -> list[tuple[int, str, bytes, bytes]]:
        """For each piece: how many ids, the ids in decimal with commas, the bytes that they decode to, the ids packed."""
        table, out = self._table, []
        if len(table) > TABLE_LIMIT:
            table.clear()
        text = text or ""
        odd = not text.isascii() and self._has_odd(text)
        for run in self._special.split(text) if any(s in text for s in self.special) else [text]:
            if not run:
                continue
            if run in self.special:
                out.append(self._entry([self.special[run]]))
                continue
            if odd:
                out += map(self._piece, self._library_pieces(run))
                continue
            for piece in self._find(run):
                got = table.get(piece)
                if got is None:
                    got = self._piece(piece.encode("utf-8"))
                    if len(piece) <= 64:
                        table[piece] = got
                out.append(got)
        return out

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(self._parts(text))).tolist()

    @staticmethod
    def packed(parts: list[tuple[int, str, bytes, bytes]]) -> bytes:
        return b"".join([p[3] for p in parts])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids; SHA-256 of the ids in decimal with commas; SHA-256 of the decoded text."""
        return self.digest_of(self._parts(text))

    @staticmethod
    def digest_of(parts: list[tuple[int, str, bytes, bytes]]) -> tuple[int, str, str]:
        ids = ",".join([p[1] for p in parts])
        decoded = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
        return sum([p[0] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path)


def _map(df: DataFrame, text_col: str, fields: list[T.StructField], fn) -> DataFrame:
    ship(df.sparkSession)
    names = [f.name for f in fields]
    kept = df.drop(*names)
    rest = list(kept.columns)
    schema = T.StructType([*kept.schema.fields, *fields])
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").alias(free_name(rest, "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # few rows at a time: ids take more room than text
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *fn(b.column(b.num_columns - 1).to_pylist())], names=[*rest, *names])

    return source.mapInArrow(tidy(run), schema)


IDS = T.ArrayType(T.IntegerType())


def _id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """`df` with an array of token ids."""
    return _map(df, text_col, [T.StructField(out, IDS)], lambda texts: [_id_lists([Codec.packed(codec(path)._parts(t)) for t in texts])])


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """`df` with the text that an array of token ids decodes to; a null array gives the empty text."""
    return _map(df, ids_col, [T.StructField(out, T.StringType())], lambda rows: [pa.array([codec(path).decode(r or []) for r in rows], pa.string())])


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids: str | None = None) -> DataFrame:
    """`df` with n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded text, and with the ids themselves
    in the column `ids` if it is named."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def fn(texts: list) -> list[pa.Array]:
        c, rows, packed = codec(path), [], []
        for t in texts:
            parts = c._parts(t)
            rows.append(c.digest_of(parts))
            if ids:
                packed.append(c.packed(parts))
        digests = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        return [*digests, *([_id_lists(packed)] if ids else [])]

    return _map(df, text_col, [*fields, *([T.StructField(ids, IDS)] if ids else [])], fn)
