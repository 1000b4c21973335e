"""Repeated windows of symbols (bytes or words) across a corpus, by minimizers and compacted runs.

Every window of `k` symbols has a minimizer, the m-gram in it with the smallest hash. Consecutive windows with
the same minimizer form a run, which a corpus of n symbols has about 2n / (k - m) of. Equal windows have equal
minimizers at equal offsets, so runs that share no minimizer share no window. This module finds runs, combines
equal ones within a task, ships them in packed form by minimizer, and keeps fixed-size bit maps of minimizers.

Shipping: a row of a shuffle is not a run but a bucket of runs in numpy's bytes, so the JVM moves few large
rows, and the sorting is numpy's. Buckets go by the minimizer's hash. A task sends one row for equal runs,
however often they occur in it, so a passage that a third of all documents share reaches its bucket once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_groups, mix, prefix_hashes, span_hashes, tidy, word_codes, written

#: Symbols that are hashed at once; bounds the memory of a task's arrays.
PIECE_BYTES = 1_500_000
PIECE_DOCUMENTS = 4_096
STRETCH = 1_000_000  # symbols of a longer text whose windows are looked at together
POSITION_BITS = np.uint64(32)
LAST_ID = np.iinfo(np.int64).max  # null ids come last


class Piece:
    """Some documents' symbols in a row: `starts` and `ends` of each document, and the symbols, bytes or two codes a word."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, seed: int = 0, other: np.ndarray | None = None):
        self.codes, self.starts, self.ends, self.first, self.seed = codes, starts, ends, first, seed
        self.other = codes if other is None else other
        self._prefix: dict[int, np.ndarray] = {}

    def hashes(self, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
        """One of two independent hashes of the symbols from start to end."""
        if lane not in self._prefix:
            self._prefix[lane] = prefix_hashes(self.other if lane else self.codes, lane, self.seed)
        return span_hashes(self._prefix[lane], start, end, lane, self.seed)


class Runs:
    """For each run: its document (index in the batch), first window, number of windows, and hash columns."""

    def __init__(self, doc, at, n, mz, span, check):
        self.doc, self.at, self.n, self.mz, self.span, self.check = doc, at, n, mz, span, check


def word_pieces(texts: list, seed: int = 0) -> Iterator[Piece]:
    """Pieces with two codes a word."""
    k = 0
    while k < len(texts):
        first, parts, size = k, [], 0
        while k < len(texts) and (not parts or size < PIECE_BYTES and len(parts) < PIECE_DOCUMENTS):
            parts.append((texts[k] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            k += 1
        codes, other, begin = word_codes(b"\n".join([b"", *parts, b""]))
        # how many words there are up to each document's end
        ends = np.searchsorted(begin, np.cumsum([len(p) + 1 for p in parts]))
        yield Piece(codes, np.concatenate(([0], ends[:-1])), ends, first, seed, other)


def byte_pieces(texts: list, seed: int = 0) -> Iterator[Piece]:
    """Pieces with the bytes themselves."""
    k = 0
    while k < len(texts):
        first, parts, size = k, [], 0
        while k < len(texts) and (not parts or size < PIECE_BYTES and len(parts) < PIECE_DOCUMENTS):
            parts.append((texts[k] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1])
            k += 1
        ends = np.cumsum([len(p) for p in parts])
        yield Piece(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], ends[:-1])), ends, first, seed)


def runs_of(p: Piece, k: int, m: int) -> Runs:
    """The runs of all windows of `k` symbols, in document order; `at` counts from the document's start.

    A long text is looked at in stretches, so memory doesn't follow its length. A stretch yields the runs that begin in it: it starts a window early,
    to see which run is an older one, and goes on for longer than a run can be."""
    n = len(p.codes)
    if n <= 2 * STRETCH:
        return _runs_of(p, k, m)
    parts = []
    for low in range(0, n, STRETCH):
        begin, end = max(0, low - 1), min(n, low + STRETCH + 2 * k)
        cut = [np.clip(x - begin, 0, end - begin) for x in (p.starts, p.ends)]
        r = _runs_of(Piece(p.codes[begin:end], *cut, p.first, p.seed, p.other[begin:end]), k, m)
        at = r.at + cut[0][r.doc - p.first] + begin
        own = (at >= low) & (at < low + STRETCH)
        parts.append((r.doc[own], (at - p.starts[r.doc - p.first])[own], r.n[own], r.mz[own], r.span[own], r.check[own]))
    return Runs(*(np.concatenate(x) for x in zip(*parts)))


def _runs_of(p: Piece, k: int, m: int) -> Runs:
    n = len(p.codes)
    empty = np.zeros(0, np.int64)
    if n < k:
        return Runs(empty, empty, empty, *(np.zeros(0, np.uint64) for _ in range(3)))
    at = np.arange(n - m + 1)
    grams = p.hashes(at, at + m)
    # smallest gram of each window, the leftmost of equal ones: the position fills the low bits
    low = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
    least = (grams & ~low) | at.astype(np.uint64)
    width, have = k - m + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    doc = np.repeat(np.arange(len(p.starts)), p.ends - p.starts)
    start = np.arange(n - k + 1)
    inside = doc[start] == doc[start + k - 1]
    start, least = start[inside], least[inside]
    if not len(start):
        return Runs(empty, empty, empty, *(np.zeros(0, np.uint64) for _ in range(3)))
    place = (least & low).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[start[1:]] != doc[start[:-1]])
    first = np.flatnonzero(new)
    begin = start[first]
    count = np.diff(np.append(first, len(start)))
    end = begin + count - 1 + k
    anchor = place[first]
    # where the minimizer stands in the run belongs to what makes runs equal
    span, check = (mix(p.hashes(begin, end, lane) + (anchor - begin).astype(np.uint64)) for lane in (0, 1))
    return Runs(doc[begin] + p.first, begin - p.starts[doc[begin]], count, mix(grams[anchor]), span, check)


# ---------------------------------------------------------------- shipping

SLICE_BYTES = 12_000_000


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE_BYTES in a text column at most (a longer text stands alone), which bounds a task's arrays."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        done = 0
        while done < b.num_rows:
            upto = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + SLICE_BYTES, side="right")))
            yield b.slice(done, upto - done)
            done = upto


def pack(bucket: np.ndarray, n_buckets: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row a bucket that has entries, with each column's bytes."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    full = np.flatnonzero(np.diff(edges))
    sorted_columns = {c: v[order] for c, v in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([v[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()) for v in sorted_columns.values())], names=["bucket", *columns])


def shipped(kinds: dict[str, str]) -> str:
    """The schema of packed rows."""
    return "bucket int, " + ", ".join(f"{c} binary" for c in kinds)


def by_bucket(packed: DataFrame, kinds: dict[str, str], fn: Callable[[dict[str, np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring each bucket together and give `fn` its columns."""

    def run(table: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in zip(offsets[:-1], offsets[1:]):
            part = table.slice(a, b - a)
            yield from fn({c: np.frombuffer(b"".join(part.column(c).to_pylist()), kind) for c, kind in kinds.items()})

    return map_groups(packed, ["bucket"], [], run, schema, min_rows=1)


def bucket_count(df: DataFrame, bucket_bytes: int = 32 << 20) -> int:
    """Four buckets a shuffle partition, so that hashing them to partitions comes out even, and more where the input
    is large: a bucket is held whole, so its size must not grow with the corpus."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 60:  # unknown, such as that of rows from Python
        size = 0
    return max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))


# ---------------------------------------------------------------- bit maps

#: Sixteen bits a key, between these powers of two: 128 KB to 128 MB. What no longer fits makes the map fuller.
LEAST_BITS, MOST_BITS, CHUNKS = 20, 30, 64


class BitMap:
    """A set that may hold more 64-bit keys than it was given, never fewer."""

    def __init__(self, bits: int, data: bytes):
        self.bits, self.data = bits, data


def bit_map(keys: DataFrame, column: str) -> BitMap:
    """A bit map of a column of 64-bit keys, sized by their number. Keys meet by chunk of the map, so a task holds
    a few chunks; a full map costs its users time and changes no result."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(16 * keys.count()).bit_length()))
    low = bits - CHUNKS.bit_length() + 1
    size = (1 << low) // 8

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.unique(bit_of(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
                packed = pack(at >> low, CHUNKS, {"at": (at & ((1 << low) - 1)).astype("u4")})
                yield pa.RecordBatch.from_arrays(packed.columns, names=["chunk", "at"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if chunk not in held:
                    held[chunk] = np.zeros(size, np.uint8)
                at = np.frombuffer(raw, "u4")
                np.bitwise_or.at(held[chunk], at >> 3, np.right_shift(np.uint8(128), (at & 7).astype(np.uint8)))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["chunk", "bits"])

    placed = keys.select(F.col(column)).mapInArrow(tidy(place), "chunk int, at binary")
    out = bytearray((1 << bits) // 8)
    for r in placed.repartition("chunk").mapInArrow(tidy(union), "chunk int, bits binary").collect():
        out[r.chunk * size : (r.chunk + 1) * size] = r.bits
    return BitMap(bits, bytes(out))


def bit_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5BD1E995)) >> np.uint64(64 - bits)).astype(np.int64)


def in_map(m: BitMap, keys: np.ndarray) -> np.ndarray:
    at = bit_of(keys, m.bits)
    return (np.frombuffer(m.data, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


# ------------------------------------------------------------ flagged spans

def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n symbols lie in any of the spans: a byte or two a symbol, as a long text has many."""
    edge = np.zeros(n + 1, np.int8)
    if len(starts):
        order = np.argsort(starts, kind="stable")
        starts, upto = starts[order], np.maximum.accumulate(ends[order])
        first = np.flatnonzero(np.append(True, starts[1:] > upto[:-1]))
        edge[starts[first]] = 1
        edge[upto[np.append(first[1:] - 1, len(upto) - 1)]] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def document_keys(ids: pa.Array, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """A document's id (null: the largest) and a number from its text: rows that agree in both count as one."""
    import zlib

    return ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False), np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, id, tie, text): a document's id, key and text. Rows that agree in id (null: the largest) and text are one document."""
    text = F.col(f"`{text_col}`")
    doc_id = F.col(f"`{id_col}`").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST_ID)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), text.alias("text"))


def with_spans(docs: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """(doc_id, text, id, tie, spans) for every row of `docs`: the rows of `found` (id, tie, ...) of its document, once each.

    The lists are a written table, so that a hot document's rows can be dealt to several tasks."""
    rest = [c for c in found.columns if c not in ("id", "tie")]
    lists = written(found.groupBy("id", "tie").agg(F.collect_set(F.struct(*rest)).alias("spans")), "spans")
    return keyed(docs, id_col, text_col).join(lists, ["id", "tie"], "left").select("doc_id", "text", "id", "tie", "spans")
