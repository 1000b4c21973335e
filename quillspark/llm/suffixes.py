"""Suffix-array deduplication of bytes: every byte that a repeated 200-byte string covers.

Documents are cut into runs of windows that share a minimizer (see spans.py). Runs that occur twice and more
are found by two hashes of 64 bits; then each occurrence's bytes are read at its place in the document and a BLAKE2b
digest is taken of them, and if occurrences of a run disagree, all is done again with other hashes. What is left are
minimizers with different runs, where repeats begin and end: their bytes are gathered, distinct ones once, and a
suffix array over them finds each string of 200 bytes that two of them share. The array is built in two stages: suffixes smaller than their successors are sorted directly, all others
are induced from them by scanning the buckets of first bytes once; then the common prefixes of neighbours show
the repeats.

Minimizers with very many different runs (`hot` and more) are dealt to blocks by document, and so never meet in one
task: each block has its suffix array, and its distinct strings are compared with those of the other blocks by hash
and digest, as runs are.

Defined results: a null text is empty; a document shorter than the window keeps all; strings never cross documents; a very long text is
looked at in stretches, and is held whole only as its bytes; an empty table gives no rows;
rows that repeat are documents of their own, so equal rows of 200 bytes and more lose everything (if they repeat in id
too, they count as one document to the suffix arrays, but each is an occurrence to the hashes); null ids come last;
other columns are not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import prefix_hashes, ship, span_hashes, tidy, written

WINDOW, GRAM = 200, 24
CHUNK_BYTES = 1_000_000  # of text under one suffix array, unless one minimizer has more
HOT = 8_000  # different runs of one minimizer, from which it is dealt to blocks
KINDS = {"mz": "u8", "span": "u8", "check": "u8", "id": "i8", "tie": "i8", "at": "u4", "n": "u2", "many": "u1"}
KNOWN = {"kspan": "u8", "kcheck": "u8", "kid": "i8", "ktie": "i8", "kat": "u4", "kn": "u2"}
SEGMENTS = {"mz": "u8", "block": "u4", "id": "i8", "tie": "i8", "at": "u4", "len": "u4"}
#: (span, check) name what digests have to confirm: null for spans whose bytes the suffix array compared. Rows without an
#: id are minimizers of different runs, in `span`, with their number in `check`.
FOUND = "id long, tie long, start long, stop long, span long, check long"


# ------------------------------------------------------------ suffix array

def _eights(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number (zeros after the end)."""
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    out = np.zeros(len(t), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(t)]
    return out


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one after them; the last counts as such."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int16) - t[:-1]) if n > 1 else np.zeros(0, np.int16)
    step = np.append(step, 1)
    # in a stretch of equal bytes the first difference after it decides
    nonzero = np.flatnonzero(step)
    return step[nonzero[np.searchsorted(nonzero, np.arange(n))]] > 0


def _sorted_directly(at: np.ndarray, eights: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the `depth` bytes from each on: 8 bytes a round, only ties go on."""
    n = len(eights)
    order = np.argsort(eights[at], kind="stable")
    out, key = at[order], eights[at][order]
    group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    where = np.arange(len(out))
    for o in range(8, depth, 8):
        # only places in groups of two and more
        same = np.zeros(len(where), bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:].copy()
        where, group = where[same], group[same]
        if not len(where):
            break
        pos = out[where]
        key = np.where(pos + o < n, eights[np.minimum(pos + o, n - 1)], np.uint64(0))
        order = np.lexsort((key, group))
        out[where] = pos[order]
        key = key[order]
        new = np.concatenate(([False], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        group = np.cumsum(new)
    return out


def suffix_array(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions of `t` in the order of their suffixes' first `depth` bytes, and each position's 8 bytes."""
    n = len(t)
    eights = _eights(t)
    if not n:
        return np.zeros(0, np.int64), eights
    small = smaller_than_next(t)
    direct = _sorted_directly(np.flatnonzero(small), eights, depth)
    edges = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        # the suffixes larger than their successors come first, induced by smaller buckets and by themselves
        rounds = [np.concatenate(waiting[c])] if waiting[c] else []
        while rounds and len(rounds[-1]):
            before = rounds[-1][rounds[-1] > 0] - 1
            rounds.append(before[(t[before] == c) & ~small[before]])
        bucket = np.concatenate([*rounds, direct[edges[c] : edges[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before]]
        first = t[before]
        before, first = before[first > c], first[first > c]
        if len(before):
            order = np.argsort(first, kind="stable")
            cut = np.flatnonzero(np.diff(first[order])) + 1
            for part in np.split(before[order], cut):
                waiting[t[part[0]]].append(part)
    return np.concatenate(out).astype(np.int64), eights


def common_prefixes(order: np.ndarray, eights: np.ndarray, depth: int) -> np.ndarray:
    """Of each position and the one before it in `order`: how many of the first `depth` bytes agree, in eights
    (depth if all do); 0 for the first."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for o in range(0, depth, 8):
        a, b = order[live] + o, order[live - 1] + o
        differ = eights[a] ^ eights[b]
        if o + 8 > depth:
            differ >>= np.uint64(8 * (o + 8 - depth))
        live = live[differ == 0]
        out[live] = min(o + 8, depth)
        if not len(live):
            break
    return out


class Windows:
    """The strings of `window` bytes in some segments, sorted: `start` in the joined text, and whether the string
    equals that of the place before (`same`)."""

    def __init__(self, segments: list[bytes], window: int, seed: int = 0):
        self.window, self.seed = window, seed
        self.offsets = np.concatenate(([0], np.cumsum([len(s) + 1 for s in segments])))
        # bytes go one up, so that zero ends a segment; UTF-8 has no byte 255
        self.text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)
        order, eights = suffix_array(self.text, window)
        ends = self.offsets[1:] - 1
        at = np.arange(len(self.text))
        room = ends[np.searchsorted(ends, at)] - at >= window
        self.start = order[room[order]]
        self.same = common_prefixes(self.start, eights, window) == window
        self.repeated = self.same.copy()
        self.repeated[:-1] |= self.same[1:]

    def segment(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, start, side="right") - 1

    def hashes(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the strings at `start`."""
        return tuple(span_hashes(prefix_hashes(self.text, lane, self.seed), start, start + self.window, lane, self.seed) for lane in (0, 1))


# ------------------------------------------------------------------ corpus

def _order(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by (mz, span, check), which open a group of equal runs, and how many rows a group has."""
    order = np.lexsort((x["check"], x["span"], x["mz"]))
    s = [x[c][order] for c in ("mz", "span", "check")]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in s])
    return order, new, np.diff(np.append(np.flatnonzero(new), len(order)))


def _ship(x: dict, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for equal runs of a batch by minimizer; all runs that occur twice here are known repeats."""
    order, new, count = _order(x)
    x = x | {"many": np.zeros(len(order), np.uint8)}
    x["many"][order[new]] = count > 1
    names = [*KINDS, *KNOWN]

    def filled(b):
        blank = pa.array([b""] * b.num_rows, pa.binary())
        return pa.RecordBatch.from_arrays([b.column("bucket"), *(b.column(c) if c in b.schema.names else blank for c in names)], names=["bucket", *names])

    first = order[new]
    yield filled(spans.pack((x["mz"][first] % np.uint64(n_buckets)).astype(np.int64), n_buckets, {c: x[c][first].astype(k) for c, k in KINDS.items()}))
    again = order[np.repeat(count > 1, count)]
    if len(again):
        bucket = (spans.mix(x["id"][again].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        yield filled(spans.pack(bucket, n_buckets, {c: x[c[1:]][again].astype(k) for c, k in KNOWN.items()}))


def _found(ids, ties, start, stop, span=None, check=None) -> Iterator[pa.RecordBatch]:
    if len(ids):
        names = [pa.nulls(len(ids), pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (span, check)]
        yield pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int64)) for x in (ids, ties, start, stop)), *names], names=["id", "tie", "start", "stop", "span", "check"])


def _repeats(x: dict, window: int) -> Iterator[pa.RecordBatch]:
    """A bucket's repeats as spans, and its minimizers that have different runs with their number."""
    start = x["kat"].astype(np.int64)
    yield from _found(x["kid"], x["ktie"], start, start + x["kn"].astype(np.int64) - 1 + window, x["kspan"], x["kcheck"])
    if not len(x["mz"]):
        return
    by_mz = np.argsort(x["mz"], kind="stable")
    mz = x["mz"][by_mz]
    twin = np.zeros(len(mz), bool)
    twin[1:] = mz[1:] == mz[:-1]
    twin[:-1] |= twin[1:].copy()
    y = {c: x[c][by_mz[twin]] for c in KINDS}
    order, new, count = _order(y)
    again = order[np.repeat(count > 1, count)]
    again = again[y["many"][again] == 0]
    start = y["at"][again].astype(np.int64)
    yield from _found(y["id"][again], y["tie"][again], start, start + y["n"][again].astype(np.int64) - 1 + window, y["span"][again], y["check"][again])
    keys, different = np.unique(y["mz"][order[new]], return_counts=True)
    mixed = different > 1
    # a window may also repeat within its own run: only if the run has a minimizer twice, which is two runs
    if mixed.any():
        none = pa.nulls(int(mixed.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(keys[mixed].view(np.int64)), pa.array(different[mixed].astype(np.int64))], names=["id", "tie", "start", "stop", "span", "check"])


def _pack_segments(x: dict, data: list[bytes], n_buckets: int) -> pa.RecordBatch:
    bucket = (spans.mix(x["mz"] + x["block"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    fixed = spans.pack(bucket, n_buckets, {c: x[c].astype(k) for c, k in SEGMENTS.items()})
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    texts = [b"".join(data[i] for i in order[edges[b] : edges[b + 1]]) for b in fixed.column("bucket").to_pylist()]
    return pa.RecordBatch.from_arrays([*fixed.columns, pa.array(texts, pa.binary())], names=[*fixed.schema.names, "data"])


def _search(x: dict, window: int, chunk: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The repeats among a bucket's segments by suffix arrays. Of blocks, also each different string once, with
    its hashes and its place, and -1 for `stop`."""
    data = x["data"].tobytes()
    offsets = np.concatenate(([0], np.cumsum(x["len"].astype(np.int64))))
    order = np.lexsort((x["block"], x["mz"]))
    mz, block = x["mz"][order], x["block"][order]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (mz[1:] != mz[:-1]) | (block[1:] != block[:-1])
    groups = np.append(np.flatnonzero(new), len(order))
    held: dict[bytes, int] = {}
    size = 0

    def flush():
        w = Windows(list(held), window, seed)
        rows = np.array(list(held.values()), np.int64)

        def places(start):
            k = w.segment(start)
            return x["id"][rows[k]], x["tie"][rows[k]], x["at"][rows[k]].astype(np.int64) + start - w.offsets[k]

        # neighbouring starts of a document become one span
        ids, ties, at = places(w.start[w.repeated])
        o = np.lexsort((at, ties, ids))
        ids, ties, at = ids[o], ties[o], at[o]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]) | (at[1:] > at[:-1] + 1)
        yield from _found(ids[fresh], ties[fresh], at[fresh], at[np.append(fresh[1:], True)[: len(at)]] + window)
        one = ~w.same & (x["block"][rows[w.segment(w.start)]] > 0)
        if one.any():
            start = w.start[one]
            h, c = w.hashes(start)
            ids, ties, at = places(start)
            yield from _found(ids, ties, at, np.full(len(at), -1), h, c)

    for a, b in zip(groups[:-1], groups[1:]):
        for i in order[a:b]:
            held.setdefault(data[offsets[i] : offsets[i + 1]], i)
            size += int(x["len"][i])
        if size >= chunk:
            yield from flush()
            held, size = {}, 0
    if held:
        yield from flush()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, chunk: int = CHUNK_BYTES, hot: int = HOT, seed: int = 0, name_bits: int = 64) -> DataFrame:
    """(id, tie, start, stop, span, check): bytes that strings of `window` bytes cover which start elsewhere too. Where
    (span, check) isn't null, all places of that name are still to be compared.

    `name_bits` shortens names, so that tests can let them collide."""
    ship(docs.sparkSession)
    texts = spans.keyed(docs, id_col, text_col).select("id", "tie", "text")
    n_buckets = spans.bucket_count(docs)

    def read(batch):
        return batch.column(2).to_pylist(), *(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))

    def runs_of(p: spans.Piece) -> spans.Runs:
        r = spans.runs_of(p, window, gram)
        r.span, r.check = (x >> np.uint64(64 - name_bits) for x in (r.span, r.check))
        return r

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slices(batches, 2):
            text, ids, ties = read(b)
            runs = [runs_of(p) for p in spans.byte_pieces(text, seed)]
            doc = np.concatenate([r.doc for r in runs])
            x = {c: np.concatenate([getattr(r, c) for r in runs]) for c in ("mz", "span", "check", "at", "n")}
            yield from _ship(x | {"id": ids[doc], "tie": ties[doc]}, n_buckets)

    kinds = KINDS | KNOWN
    found = written(spans.by_bucket(texts.mapInArrow(tidy(compact), spans.shipped(kinds)), kinds, lambda x: _repeats(x, window), FOUND), "runs")
    context = docs.sparkSession.sparkContext
    keys = found.where("id IS NULL")
    mixed = context.broadcast(spans.bit_map(keys, "span"))
    most = keys.agg(F.max("check")).first()[0] or 0
    blocks = -(-most // hot)
    crowded = context.broadcast(spans.bit_map(keys.where(F.col("check") > hot), "span")) if blocks > 1 else None

    def dealt(mz, ids, ties):
        """0, or a block from 1 on for runs of crowded minimizers."""
        if blocks < 2:
            return np.zeros(len(mz), np.int64)
        block = spans.mix(ids.astype(np.uint64) * np.uint64(31) + ties.view(np.uint64)) % np.uint64(blocks)
        return np.where(spans.in_map(crowded.value, mz), block.astype(np.int64) + 1, 0)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slices(batches, 2):
            text, ids, ties = read(b)
            columns, data, seen = [], [], set()
            for p in spans.byte_pieces(text, seed):
                r = runs_of(p)
                hit = np.flatnonzero(spans.in_map(mixed.value, r.mz))
                hit = np.array([i for i in hit.tolist() if (key := (r.mz[i], r.span[i], r.check[i])) not in seen and not seen.add(key)], np.int64)
                begin = r.at[hit] + p.starts[r.doc[hit] - p.first]
                raw = p.codes.tobytes()
                length = r.n[hit] - 1 + window
                data += [raw[a : a + n] for a, n in zip(begin.tolist(), length.tolist())]
                columns.append({"mz": r.mz[hit], "block": dealt(r.mz[hit], ids[r.doc[hit]], ties[r.doc[hit]]), "id": ids[r.doc[hit]], "tie": ties[r.doc[hit]], "at": r.at[hit], "len": length})
            if data:
                yield _pack_segments({c: np.concatenate([y[c] for y in columns]) for c in SEGMENTS}, data, n_buckets)

    gathered = texts.mapInArrow(tidy(gather), spans.shipped(SEGMENTS | {"data": "u1"}))
    shared = spans.by_bucket(gathered, SEGMENTS | {"data": "u1"}, lambda x: _search(x, window, chunk, seed), FOUND)
    out = found.where("id IS NOT NULL")
    if blocks < 2:
        return out.union(shared)
    # a string comes at most once from each block, so these lists are short
    shared = written(shared, "shared")
    across = shared.where("stop < 0").groupBy("span", "check").agg(F.collect_list(F.struct("id", "tie", "start")).alias("places")).where(F.size("places") > 1)
    across = across.select("span", "check", F.explode("places").alias("p")).select("p.*", (F.col("p.start") + window).alias("stop"), "span", "check")
    return out.union(shared.where("stop >= 0")).union(across)


def _removed(joined: DataFrame, text: bool) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, names) of (doc_id, text, id, tie, spans); `names` is what verification compares."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, names array<struct<span:bigint,check:bigint,digest:bigint>>"
    name = pa.list_(pa.struct([(c, pa.int64()) for c in ("span", "check", "digest")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, names, lengths = [], [[], [], []], []
            for t, found in zip(b.column(1).to_pylist(), b.column(4)):
                raw = kept = (t or "").encode("utf-8", "surrogatepass")
                n, gone, n_spans = len(kept), 0, 0
                lengths.append(0)
                if found.is_valid:
                    start, stop, span = (found.values.field(c) for c in ("start", "stop", "span"))
                    mask = spans.covered(start.to_numpy(), stop.to_numpy(), n)
                    gone, n_spans = int(mask.sum()), int(np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1))
                    kept = np.frombuffer(kept, np.uint8)[~mask].tobytes()
                    named = found.values.filter(span.is_valid())
                    names[0] += named.field("span").to_pylist()
                    names[1] += named.field("check").to_pylist()
                    names[2] += [hashlib.blake2b(raw[i:j], digest_size=8).digest() for i, j in zip(named.field("start").to_pylist(), named.field("stop").to_pylist())]
                    lengths[-1] = len(named)
                rows.append((n, gone, n_spans, hashlib.sha256(kept).hexdigest(), kept if text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            digests = pa.array(np.frombuffer(b"".join(names[2]), np.int64))
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.StructArray.from_arrays([pa.array(names[0], pa.int64()), pa.array(names[1], pa.int64()), digests], names=["span", "check", "digest"])).cast(name)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)), listed], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "names"])

    return joined.mapInArrow(tidy(run), schema)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, text: bool = True, name_bits: int = 64, **how) -> DataFrame:
    """For each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `text`, the bytes that are kept."""
    for seed in count():
        found = repeated_spans(docs, id_col, text_col, window, seed=seed, name_bits=64 if seed else name_bits, **how)
        out = written(_removed(spans.with_spans(docs, id_col, text_col, found), text), "removed")
        named = out.select(F.explode("names").alias("n")).groupBy("n.span", "n.check")
        if named.agg((F.min("n.digest") != F.max("n.digest")).alias("differ")).where("differ").isEmpty():
            return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if text else []))
