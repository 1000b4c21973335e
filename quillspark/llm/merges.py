"""Byte-level BPE by replaying merges over the words of a whole corpus.

A pattern cuts texts into words that never merge with each other, so a word has the same ids wherever it stands, and
each different word of the corpus needs to be encoded once.

1. Tasks cut their texts into slices of a fixed number of characters. A slice ranks its words by how often it has them; its
   documents become rows of ranks, and its different words go to as many rows as there are buckets, each word by its checksum,
   but for those that are tokens as they are. All is written.
2. The slices' words meet by bucket. There, all words of a chunk lie one after the other, and an index says for each
   pair of neighbouring tokens that can merge at which positions it stands. Merges are applied in the order of their ranks,
   each at all its positions; only the pairs that a merge's neighbours form are entered anew. Should such a pair have a lower
   rank than the merge at work, it goes first, so that each word sees its merges in its own order of ranks, leftmost first.
3. The ids go back to the slices that asked for them, which lie in a table bucketed by slice and don't move; documents are put together
   from their words' ids.

A word of a third of all texts is in one row a slice, as any other. Rows of a bucket need not stand in one chunk: a chunk's limit only
means that a word may be encoded twice. No document leaves its slice, and a slice's words are bounded by its texts.

Which characters are letters, digits or spaces depends on a version of Unicode. Each character is tried once a worker on
the library's own classes; texts with one that this pattern engine classes differently are cut as if it were another of its class.

Defined results: a null text is encoded as the empty one (no ids); there are no special tokens; a word that is itself a token is
that token; very long texts are encoded whole (a document and its words have to fit in a worker); repeated rows each have their own row;
an empty table gives no rows; other columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, give_back, ship, tidy, written_in_buckets

SLICE = 32_000_000  # characters whose words are numbered together
CHUNK = 2_000_000  # bytes of different words whose merges are replayed together
AT_ONCE = 24  # positions from which a merge is applied in numpy
STRETCH = 1_000_000  # words of a document that are worked on at a time
FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
IDS = T.ArrayType(T.LongType())
#: A character of each class that no alternative of the pattern names.
STAND_INS = {"L": "é", "N": "7", "S": " ", "": "!"}


class Ranks:
    """The merges of a rank file, and a pattern that cuts texts as the library's engine does."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        if len(self.bytes_of) < len(self.ids) or any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError(f"not a rank file with all bytes and a rank of its own for each token: {path}")
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        #: pairs[a << 32 | b] is the rank of the token that a and b make
        self.pairs: dict[int, int] = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self._keys = np.array(sorted(self.pairs), np.int64)
        self._made = np.array([self.pairs[k] for k in self._keys.tolist()], np.int64)
        self.of_two = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.of_two[a, b] = self.pairs.get(int(self.of_byte[a]) << 32 | int(self.of_byte[b]), -1)
        self._regex = regex.compile(pattern)
        bytes_alone = {bytes([b]): b for b in range(256)}
        self._classes = [(k, tiktoken.Encoding(k, pat_str=p, mergeable_ranks=bytes_alone, special_tokens={}), regex.compile(p)) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))]
        self._tried: set[str] = set()
        self._odd: dict[str, str] = {}

    def _stand_ins(self, text: str) -> dict[str, str]:
        """The characters of `text` that the two engines class differently, with one of the class that the library has."""
        characters = set(text)
        for c in characters - self._tried:
            self._tried.add(c)
            theirs = "".join(k for k, library, _ in self._classes if library.encode_ordinary(c))
            if theirs != "".join(k for k, _, own in self._classes if own.match(c)):
                self._odd[c] = STAND_INS[theirs]
        return {c: self._odd[c] for c in characters & self._odd.keys()}

    def words(self, text: str) -> Iterator[list[str]]:
        """The text's words, a list a stretch."""
        odd = self._stand_ins(text)
        seen = text.translate(str.maketrans(odd)) if odd else text
        if not odd and len(text) <= 4 * STRETCH:
            yield self._regex.findall(text)
            return
        found = self._regex.finditer(seen)
        while part := [text[m.start() : m.end()] for m in islice(found, STRETCH)]:
            yield part

    def _ranks_of(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """The rank of the merge of each pair, -1 if there is none."""
        keys = np.int64(left) << 32 | right if isinstance(left, int) else left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._made[at], -1)

    def _at_once(self, rank: int, at: np.ndarray, token: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Apply a merge at all of the rising positions `at` that still have its pair; the ranks and positions of the pairs that its
        neighbours form. None, and nothing done, if pairs overlap or a pair of a lower rank would arise: then order matters."""
        at = at[token[at] >= 0]
        at = at[after[at] >= 0]
        at = at[self._ranks_of(token[at], token[after[at]]) == rank]
        nothing = np.zeros(0, np.int64)
        if not len(at):
            return nothing, nothing
        gone = after[at]
        next_one = np.minimum(np.searchsorted(at, gone), len(at) - 1)
        right, up = after[gone], before[at]
        beside, above = right >= 0, up >= 0
        arising = np.concatenate((self._ranks_of(rank, token[right[beside]]), self._ranks_of(token[up[above]], rank), self._ranks_of(rank, np.array([rank]))))
        if (at[next_one] == gone).any() or ((arising >= 0) & (arising < rank)).any():
            return None
        token[at], token[gone], after[at] = rank, -1, right
        before[right[beside]] = at[beside]
        up = before[at]
        above = up >= 0
        ranks = np.concatenate((self._ranks_of(rank, token[right[beside]]), self._ranks_of(token[up[above]], rank)))
        places = np.concatenate((at[beside], up[above]))
        return ranks[ranks >= 0], places[ranks >= 0]

    def replay(self, words: list[bytes]) -> list[array]:
        """The ids of each word; all words are worked on together, a merge after the other."""
        out = [array("I", [i]) if (i := self.ids.get(w)) is not None else array("I") for w in words]
        rest = [k for k, w in enumerate(words) if w and not out[k]]
        if not rest:
            return out
        lengths = np.array([len(words[k]) for k in rest], np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join([words[k] for k in rest]), np.uint8)
        # each position is the first byte of a token or, with -1, within one; the lists lead to the tokens beside it in the word
        token, after, before = (array("i", bytes(4 * len(data))) for _ in range(3))
        tokens, afters, befores = (np.frombuffer(x, np.int32) for x in (token, after, before))
        tokens[:] = self.of_byte[data]
        afters[:], befores[:] = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        afters[ends - 1], befores[ends - lengths] = -1, -1
        ranks = self.of_two[data[:-1], data[1:]]
        ranks[ends[:-1] - 1] = -1
        #: for each rank the positions of the left parts of its pairs: some arrays, and single ones
        index: dict[int, list[np.ndarray]] = {}
        entered: dict[int, list[int]] = {}
        queue: list[int] = []

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order].astype(np.int32)
            starts = np.flatnonzero(np.diff(ranks, prepend=-1))
            for r, i, j in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ranks)]):
                if r not in index and r not in entered:
                    heapq.heappush(queue, r)
                index.setdefault(r, []).append(places[i:j])

        enter(ranks[ranks >= 0], np.flatnonzero(ranks >= 0))
        pairs = self.pairs
        while queue:
            rank = heapq.heappop(queue)
            parts, single = index.pop(rank, []), entered.pop(rank, [])
            if sum(map(len, parts)) + len(single) >= AT_ONCE:
                at = np.unique(np.concatenate([*parts, np.array(single, np.int32)]))
                got = self._at_once(rank, at, tokens, afters, befores)
                if got is not None:
                    enter(*got)
                    continue
            else:
                at = sorted({p for part in parts for p in part.tolist()}.union(single))
            for where, p in enumerate(at):
                p = int(p)
                left, q = token[p], after[p]
                if left < 0 or q < 0 or pairs.get(left << 32 | token[q]) != rank:
                    continue  # another merge has taken a part of it
                right, up = after[q], before[p]
                token[p], token[q], after[p] = rank, -1, right
                lower = False
                if right >= 0:
                    before[right] = p
                for place, key in ((p, rank << 32 | token[right] if right >= 0 else -1), (up, token[up] << 32 | rank if up >= 0 else -1)):
                    new = pairs.get(key)
                    if new is not None:
                        if new not in entered and new not in index:
                            heapq.heappush(queue, new)
                        entered.setdefault(new, []).append(place)
                        lower = lower or new < rank
                if lower and where + 1 < len(at):
                    if rank not in entered and rank not in index:
                        heapq.heappush(queue, rank)
                    index.setdefault(rank, []).append(np.array(at[where + 1 :], np.int32))
                    break
        alive = np.flatnonzero(tokens >= 0)
        ids, cuts = tokens[alive].tobytes(), np.searchsorted(alive, ends)
        for k, i, j in zip(rest, [0, *cuts[:-1].tolist()], cuts.tolist()):
            out[k].frombytes(ids[4 * i : 4 * j])
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.words(text or "") for ids in self.replay([w.encode() for w in part]) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def ranks(path: str, pattern: str) -> Ranks:
    """One table of merges per worker process and file."""
    return Ranks(path, pattern)


# ------------------------------------------------------------------- steps

def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: most are small, so most planes are all but empty."""
    raw = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _numbers(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = pa.decompress(packed[8:], 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _whole(squeezed: bytes) -> bytes:
    return pa.decompress(squeezed[8:], int.from_bytes(squeezed[:8], "little"), "zstd", asbytes=True)


def _cut(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of these sizes begin and end."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return ends - sizes, ends


def _coded(ranks: np.ndarray) -> bytes:
    """Ranks of words, compressed: the low bytes of the 256 commonest words apart from all others."""
    high, low = ranks >> 8, (ranks & 255).astype(np.uint8)
    parts = [_planes(high), _squeezed(low[high == 0].tobytes()), _squeezed(low[high > 0].tobytes())]
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _ranks(coded: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(coded):
        size = int.from_bytes(coded[at : at + 8], "little")
        parts.append(coded[at + 8 : at + 8 + size])
        at += 8 + size
    high = _numbers(parts[0])
    low = np.zeros(len(high), np.uint8)
    low[high == 0] = np.frombuffer(_whole(parts[1]), np.uint8)
    low[high > 0] = np.frombuffer(_whole(parts[2]), np.uint8)
    return high << 8 | low


#: What a slice consists of. Documents: some documents' words by rank, and how many each has. Places: the ranks of the words that are in buckets, bucket
#: after bucket. Tokens: the words that are tokens as they are, with their ranks. From FIRST_BUCKET on: a bucket's words, or their ids.
DOCUMENTS, PLACES, TOKENS, FIRST_BUCKET = range(4)
ROW = [T.StructField("slice", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("sizes", T.BinaryType()), T.StructField("data", T.BinaryType())]
NAMES = [f.name for f in ROW]


def _rows(rows: list[tuple[int, int, bytes | None, bytes]]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))]


class _Slice:
    """The documents of a slice, and the words that they have."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.book: defaultdict[str, int] = defaultdict(count().__next__)
        self.documents: list[np.ndarray] = []
        self.kept: list[pa.Array] = []

    def add(self, text: str, words: Iterator[list[str]], kept: pa.Array) -> None:
        found = [np.array(array("I", map(self.book.__getitem__, part)), np.uint32) for part in words]
        self.documents.append(np.concatenate(found) if found else np.zeros(0, np.uint32))
        self.kept.append(kept)
        self.size += len(text)

    def rows(self, buckets: int, ids: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        kind = self.kept[0].type
        # words by falling frequency
        times = np.zeros(len(self.book), np.int64)
        for d in self.documents:
            np.add.at(times, d, 1)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        begin = 0
        while begin < len(self.documents):
            end, n = begin + 1, len(self.documents[begin])
            while end < len(self.documents) and n + len(self.documents[end]) <= STRETCH:
                n += len(self.documents[end])
                end += 1
            some = self.documents[begin:end]
            made = _rows([(self.number, DOCUMENTS, _planes(np.array(list(map(len, some)))), _coded(rank[np.concatenate(some)]))])
            yield pa.RecordBatch.from_arrays([*made, pa.ListArray.from_arrays(pa.array([0, end - begin], pa.int32()), pa.concat_arrays(self.kept[begin:end]))], names=[*NAMES, "rows"])
            begin = end
        words = list(self.book)
        words = [words[k].encode() for k in order.tolist()]
        own = np.fromiter((ids.get(w, -1) for w in words), np.int64, len(words))
        bucket = np.fromiter((crc32(w) % buckets for w in words), np.int64, len(words))
        bucket[own >= 0] = -1
        at = np.argsort(bucket, kind="stable")
        cuts = np.split(at, np.flatnonzero(np.diff(bucket[at])) + 1)
        out = []
        for part in cuts:
            if len(part) and bucket[part[0]] < 0:
                out.append((self.number, TOKENS, _planes(np.diff(part, prepend=0)), _planes(own[part])))
            elif len(part):
                some = [words[k] for k in part.tolist()]
                out.append((self.number, FIRST_BUCKET + int(bucket[part[0]]), _planes(np.array(list(map(len, some)))), _squeezed(b"".join(some))))
        places = [part for part in cuts if len(part) and bucket[part[0]] >= 0]
        out.append((self.number, PLACES, _planes(np.array(list(map(len, places)), np.int64)), _planes(np.concatenate([np.diff(x, prepend=0) for x in places] or [np.zeros(0, np.int64)]))))
        yield pa.RecordBatch.from_arrays([*_rows(out), pa.nulls(len(out), pa.list_(kind))], names=[*NAMES, "rows"])


def sliced(docs: DataFrame, text: str, kept: list[str], path: str, pattern: str, buckets: int, size: int = SLICE) -> DataFrame:
    """The rows of all slices; those of documents with an array `rows` of structs of the columns `kept`."""
    row = T.StructType([docs.schema[c] for c in kept])
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path, pattern)
        now = _Slice(TaskContext.get().partitionId() << 32)
        for whole in batches:
            for k in range(whole.num_rows):
                t = whole.column(1)[k].as_py() or ""
                if now.size and now.size + len(t) > size:
                    yield from now.rows(buckets, r.ids)
                    now = _Slice(now.number + 1)
                now.add(t, r.words(t), whole.column(0).slice(k, 1))
        if now.documents:
            yield from now.rows(buckets, r.ids)

    return source.mapInArrow(tidy(run), T.StructType([*ROW, T.StructField("rows", T.ArrayType(row))]))


def word_ids(words: DataFrame, path: str, pattern: str, chunk: int = CHUNK) -> DataFrame:
    """The buckets of words with their words' ids instead of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, book, size, held = ranks(path, pattern), {}, 0, []

        def emit() -> Iterator[pa.RecordBatch]:
            ids = r.replay(list(book))
            for number, kind, of in held:
                sizes = np.fromiter((len(ids[k]) for k in of), np.int64, len(of))
                flat = np.frombuffer(b"".join([ids[k].tobytes() for k in of]), "<u4")
                yield pa.RecordBatch.from_arrays(_rows([(number, kind, _planes(sizes), _planes(flat))]), names=NAMES)

        for b in batches:
            for number, kind, sizes, data in zip(*[c.to_pylist() for c in b.columns]):
                starts, ends = _cut(_numbers(sizes))
                raw, of = _whole(data), []
                for i, j in zip(starts.tolist(), ends.tolist()):
                    w = raw[i:j]
                    at = book.get(w)
                    if at is None:
                        at = book[w] = len(book)
                        size += len(w)
                    of.append(at)
                held.append((number, kind, of))
                if size > chunk:
                    yield from emit()
                    book, size, held = {}, 0, []
        if held:
            yield from emit()

    return words.repartition("kind").mapInArrow(tidy(run), T.StructType(ROW))


def assembled(slices: DataFrame, buckets: DataFrame, path: str, pattern: str, ids: bool) -> DataFrame:
    """The documents of `slices`, with their ids and digests, by the ids in `buckets`."""
    schema = T.StructType([T.StructField("row", slices.schema["rows"].dataType.elementType), *FIELDS, *([T.StructField("ids", IDS)] if ids else [])])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        of = ranks(path, pattern).bytes_of
        rest = {k: (_numbers(sizes).astype(np.int64), data) for k, sizes, data in zip(*[left.column(c).to_pylist() for c in ("kind", "sizes", "data")]) if k != DOCUMENTS}
        came = sorted(zip(*[right.column(c).to_pylist() for c in ("kind", "sizes", "data")]), key=lambda x: x[0])
        runs, steps = rest[PLACES]
        own, tokens = rest.get(TOKENS, (np.zeros(0, np.int64), _planes(np.zeros(0))))
        # the words' ids lie as the buckets came; starts and lengths are by the words' ranks
        at = np.concatenate([np.cumsum(own), *(np.cumsum(x, dtype=np.int64) for x in np.split(_numbers(steps), np.cumsum(runs)[:-1]))])
        each = np.concatenate([np.ones(len(own), np.int64), *(_numbers(sizes).astype(np.int64) for _, sizes, _ in came)])
        flat = np.concatenate([_numbers(tokens), *(_numbers(data) for _, _, data in came)])
        lengths, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        lengths[at], starts[at] = each, _cut(each)[0]
        tokens = list(map(of.__getitem__, flat.tolist()))
        plain = [b"".join(tokens[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist())]
        del tokens, came, rest
        out = []
        for k in np.flatnonzero(left.column("kind").to_numpy() == DOCUMENTS).tolist():
            kept = left.column("rows").slice(k, 1).combine_chunks().flatten()
            words = _ranks(left.column("data")[k].as_py())
            cuts = zip(*(x.tolist() for x in _cut(_numbers(left.column("sizes")[k].as_py()))))
            made = [_document(words[i:j], flat, starts, lengths, plain, ids) for i, j in cuts]
            columns = [pa.array([x[c] for x in made], kind) for c, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            if ids:
                ends = np.concatenate(([0], np.cumsum([len(x[3]) for x in made]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[3] for x in made]))))
            out.append(pa.RecordBatch.from_arrays([kept, *columns], names=schema.names))
        give_back()
        return pa.Table.from_batches(out)

    return slices.groupBy("slice").cogroup(buckets.groupBy("slice")).applyInArrow(finish, schema)


def _document(words: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, plain: list[bytes], whole: bool) -> tuple:
    n, of_ids, of_text, kept = 0, hashlib.sha256(), hashlib.sha256(), []
    for at in range(0, len(words), STRETCH):
        some = words[at : at + STRETCH]
        begin, ends = _cut(lengths[some])
        ids = flat[np.repeat(starts[some] - begin, ends - begin) + np.arange(ends[-1])]
        n += len(ids)
        of_ids.update(ids.astype("<u4").tobytes())
        of_text.update(b"".join(map(plain.__getitem__, some.tolist())))
        if whole:
            kept.append(ids.astype(np.int64))
    return n, of_ids.hexdigest(), of_text.hexdigest(), np.concatenate(kept) if kept else np.zeros(0, np.int64)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids: str | None = None, size: int = SLICE, chunk: int = CHUNK) -> DataFrame:
    """`docs` without the text but with n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit numbers) and decoded_sha256 (the decoded bytes),
    and the ids themselves in the column `ids` if it is named."""
    spark = docs.sparkSession
    ship(spark)
    new = [f.name for f in FIELDS] + ([ids] if ids else [])
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in (text_col, *new)}]
    own = docs if kept else docs.withColumn(free_name(docs.columns, "none"), F.lit(0))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = sliced(own, text_col, kept or own.columns[-1:], path, pattern, 4 * parts, size)
    rows = written_in_buckets(made, "slices", parts, "slice")
    found = word_ids(rows.where(F.col("kind") >= FIRST_BUCKET).select(*NAMES), path, pattern, chunk)
    out = assembled(rows.where(F.col("kind") < FIRST_BUCKET), found, path, pattern, bool(ids))
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *[f.name for f in FIELDS], *([F.col("ids").alias(ids)] if ids else []))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """`df` with the bytes that an array of ids decodes to; a null array gives none."""
    ship(df.sparkSession)
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())])
    source = kept.select("*", F.col(f"`{ids_col}`").alias(free_name(kept.columns, "ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([ranks(path, pattern).decode(x or []) for x in b.column(b.num_columns - 1).to_pylist()], pa.binary())], names=schema.names)

    return source.mapInArrow(tidy(run), schema)
