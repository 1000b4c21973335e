"""Substring deduplication of words: long repeated spans through a compacted de Bruijn graph.

Windows of k words are the graph's edges. Most occur once and need no row of their own: consecutive windows that
share a minimizer form a run, and runs meet by minimizer. A minimizer with a single run that occurs again gives one
edge as long as the run; one with different runs, which is where the graph branches, is taken apart into its single
windows in a second pass. So there is a row an occurrence of every repeated edge, and one an edge, with how often it
occurs, which edge stands before it wherever it occurs (none if that differs), and where it occurs first.

Compaction: an edge goes on from the one before it if both occur equally often, since then each is always followed
and preceded by the other. Joins of the edges with themselves find these links and double them, round by round, until
each points to the head of its nonbranching path. A path has the occurrences of its head, so only these go on.

Verification: every occurrence of a path reads its words at its source coordinates and takes their BLAKE2b digest. If
the occurrences of a path disagree, names have collided, and all is done again without compaction: each edge's occurrences
are grouped by their digests, so a name decides nothing any more.

A word goes if a window of k words that covers it also starts earlier: in a document of smaller id, or in the same
one before. Defined results: a null text has no words; null ids come last; documents shorter than a window keep all;
very long texts are windowed whole, in stretches; an empty table gives no rows;
rows with equal id and text count as one document and get equal results; rows with equal id and other text come in
the order of hashes of their texts; other columns are not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import drop_written, ship, tidy, written

WINDOW, GRAM = 20, 4
#: A run or window: its minimizer, name and second hash, the name of the one before it (0: none), its place, windows, occurrences.
KINDS = {"mz": "u8", "unit": "u8", "check": "u8", "left": "u8", "id": "i8", "tie": "i8", "at": "u4", "n": "u2", "many": "u4"}
#: Further occurrences within a batch; they go to any bucket and only pass through.
KNOWN = {"kunit": "u8", "kid": "i8", "ktie": "i8", "kat": "u4", "kn": "u2"}
OCCURRENCE, EDGE, BRANCHING = 0, 1, 2
FOUND = "role int, unit long, tail long, left long, many long, id long, tie long, at long, n int"
NAMES = ["role", "unit", "tail", "left", "many", "id", "tie", "at", "n"]


def _ship(x: dict[str, np.ndarray], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch of documents: the earliest of equal runs that follow the same run, by minimizer, and the others."""
    order = np.lexsort((x["at"], x["tie"], x["id"], x["left"], x["check"], x["unit"], x["mz"]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([(y := x[c][order])[1:] != y[:-1] for c in ("mz", "unit", "check", "left")])
    first, again = order[new], order[~new]
    x = x | {"many": np.zeros(len(order), "u4")}
    x["many"][first] = np.diff(np.append(np.flatnonzero(new), len(order)))
    names = [*KINDS, *KNOWN]

    def filled(b: pa.RecordBatch) -> pa.RecordBatch:
        blank = pa.array([b""] * b.num_rows, pa.binary())
        return pa.RecordBatch.from_arrays([b.column("bucket"), *(b.column(c) if c in b.schema.names else blank for c in names)], names=["bucket", *names])

    yield filled(spans.pack((x["mz"][first] % np.uint64(n_buckets)).astype(np.int64), n_buckets, {c: x[c][first].astype(k) for c, k in KINDS.items()}))
    if len(again):
        bucket = (spans.mix(x["id"][again].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        yield filled(spans.pack(bucket, n_buckets, {c: x[c[1:]][again].astype(k) for c, k in KNOWN.items()}))


def _rows(role: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    size = len(columns["unit"])
    if size:
        types = [pa.int32(), *[pa.int64()] * 7, pa.int32()]
        given = {"role": np.full(size, role), **columns}
        yield pa.RecordBatch.from_arrays([pa.nulls(size, t) if c not in given else pa.array(given[c].view(np.int64) if given[c].dtype == np.uint64 else given[c], t) for c, t in zip(NAMES, types)], names=NAMES)


def _compacted(unit: np.ndarray, left: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The place of the head of each edge's nonbranching path, of the paths within a bucket."""
    order = np.argsort(unit, kind="stable")
    at = np.searchsorted(unit[order], left)
    before = order[np.minimum(at, len(order) - 1)] if len(order) else at
    linked = (unit[before] == left) & (many[before] == many) & (left != 0)
    once = np.ones(len(unit), bool)
    same = np.flatnonzero(unit[order][1:] == unit[order][:-1])
    once[order[same]] = once[order[same + 1]] = False  # a name that two edges share by accident is no part of a link
    to = np.where(linked & once & once[before], before, np.arange(len(unit)))
    while (to[to] != to).any():
        to = to[to]
    return to


def _meet(x: dict[str, np.ndarray], windows: bool, compact: bool) -> Iterator[pa.RecordBatch]:
    """A bucket's repeated edges with their occurrences: runs whose minimizer has no other, and the minimizers that have
    different ones; or windows, compacted as far as the bucket goes."""
    yield from _rows(OCCURRENCE, unit=x["kunit"], id=x["kid"], tie=x["ktie"], at=x["kat"].astype(np.int64), n=x["kn"].astype(np.int32))
    if not len(x["mz"]):
        return
    order = np.lexsort((x["at"], x["tie"], x["id"], x["check"], x["unit"], x["mz"]))
    x = {c: x[c][order] for c in KINDS}
    mz = np.ones(len(order), bool)
    mz[1:] = x["mz"][1:] != x["mz"][:-1]
    unit = mz.copy()
    unit[1:] |= (x["unit"][1:] != x["unit"][:-1]) | (x["check"][1:] != x["check"][:-1])
    heads = np.flatnonzero(unit)
    many = np.add.reduceat(x["many"].astype(np.int64), heads)
    left = np.where(np.maximum.reduceat(x["left"], heads) == np.minimum.reduceat(x["left"], heads), x["left"][heads], np.uint64(0))
    edge = many > 1
    if not windows:
        runs = np.bincount(np.cumsum(mz)[heads] - 1)  # different runs of each minimizer
        edge &= np.repeat(runs == 1, runs)
        yield from _rows(BRANCHING, unit=x["mz"][mz][runs > 1])
    at, left, many = heads[edge], left[edge], many[edge]
    name, n = x["unit"][at], x["n"][at].astype(np.int32)
    tail = name
    head = np.ones(len(at), bool)
    if windows and compact and len(at):
        to = _compacted(name, left, many)
        head = to == np.arange(len(to))
        n = np.bincount(to, minlength=len(to)).astype(np.int32)
        # the last window of a path is the one that no other of it goes on from
        goes_on = np.isin(name, left[~head])
        tail = name.copy()
        tail[to[~goes_on]] = name[~goes_on]
    start = x["at"][at].astype(np.int64)
    yield from _rows(EDGE, unit=name[head], tail=tail[head], left=left[head], many=many[head], id=x["id"][at][head], tie=x["tie"][at][head], at=start[head], n=n[head])
    whole = np.zeros(len(heads), np.int32)
    whole[np.flatnonzero(edge)[head]] = n[head]
    whole = whole[np.cumsum(unit) - 1]
    at = np.flatnonzero(whole)
    yield from _rows(OCCURRENCE, unit=x["unit"][at], id=x["id"][at], tie=x["tie"][at], at=x["at"][at].astype(np.int64), n=whole[at])


def _windows(p: spans.Piece, r: spans.Runs, k: int) -> tuple[np.ndarray, ...]:
    """(minimizer, doc, at, name, check, name of the window before) of the single windows of some runs."""
    total = int(r.n.sum())
    step = np.arange(total) - np.repeat(np.cumsum(r.n) - r.n, r.n)
    doc, at = np.repeat(r.doc, r.n), np.repeat(r.at, r.n) + step
    begin = at + p.starts[doc - p.first]
    before = np.maximum(begin - 1, 0)
    return np.repeat(r.mz, r.n), doc, at, p.hashes(begin, begin + k), p.hashes(begin, begin + k, 1), np.where(at > 0, p.hashes(before, before + k), np.uint64(0))


def repeated_edges(docs: DataFrame, id_col: str, text_col: str, k: int, m: int, name_bits: int, compact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two tables of the same columns: edges from runs, and from the windows of branching minimizers."""
    ship(docs.sparkSession)
    texts = spans.keyed(docs, id_col, text_col).select("id", "tie", "text")
    n_buckets = spans.bucket_count(docs)
    kinds, short = KINDS | KNOWN, np.uint64(64 - name_bits)

    def read(batch: pa.RecordBatch):
        return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slices(batches, 2):
            ids, ties, text = read(b)
            found = [spans.runs_of(p, k, m) for p in spans.word_pieces(text)]
            x = {c: np.concatenate([getattr(r, a) for r in found]) for c, a in (("mz", "mz"), ("unit", "span"), ("check", "check"), ("doc", "doc"), ("at", "at"), ("n", "n"))}
            unit = x["unit"] >> short
            left = np.concatenate((np.zeros(1, np.uint64), unit))[: len(unit)]
            yield from _ship(x | {"unit": unit, "left": np.where(x["at"] > 0, left, np.uint64(0)), "id": ids[x["doc"]], "tie": ties[x["doc"]]}, n_buckets)

    first = written(spans.by_bucket(texts.mapInArrow(tidy(runs), spans.shipped(kinds)), kinds, lambda x: _meet(x, False, compact), FOUND), "runs")
    branching = docs.sparkSession.sparkContext.broadcast(spans.bit_map(first.where(F.col("role") == BRANCHING), "unit"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slices(batches, 2):
            ids, ties, text = read(b)
            out = []
            for p in spans.word_pieces(text):
                r = spans.runs_of(p, k, m)
                hit = spans.in_map(branching.value, r.mz)
                out.append(_windows(p, spans.Runs(r.doc[hit], r.at[hit], r.n[hit], r.mz[hit], None, None), k))
            mz, doc, at, name, check, left = (np.concatenate(c) for c in zip(*out))
            yield from _ship({"mz": mz, "unit": name >> short, "check": check, "left": left >> short, "id": ids[doc], "tie": ties[doc], "at": at, "n": np.ones(len(at), np.int64)}, n_buckets)

    second = written(spans.by_bucket(texts.mapInArrow(tidy(windows), spans.shipped(kinds)), kinds, lambda x: _meet(x, True, compact), FOUND), "windows")
    return first, second


def paths(edges: DataFrame) -> DataFrame:
    """(unit, n, first_id, first_tie, first_at): the heads of the nonbranching paths among `edges` (unit, tail, left, many, n, id,
    tie, at), the windows of each path, and where it occurs first."""
    named = written(edges.groupBy("unit").agg(F.count(F.lit(1)).alias("same"), F.min("tail").alias("tail"), F.min("left").alias("left"), F.min("many").alias("many"), F.min("n").alias("n"), F.min(F.struct("id", "tie", "at")).alias("place")), "edges", narrow=True)
    sure = named.where("same = 1")  # a name that two edges share by accident is no part of a link
    before = sure.select(F.col("tail").alias("left"), "many", F.col("unit").alias("to"))
    links = written(sure.select("unit", "left", "many", "n").join(before, ["left", "many"]).select("unit", "to", "n"), "links", narrow=True)
    # doubling: a link that points to a head is done, the others move on to where their target points
    known = links.select(F.col("unit").alias("to"), F.lit(True).alias("open"))
    marked = written(links.join(known, "to", "left").select("unit", "to", "n", F.coalesce("open", F.lit(False)).alias("open")), "links", narrow=True)
    drop_written(links)
    done = marked.where("NOT open")
    open_ = marked.where("open")
    while not open_.isEmpty():
        further = done.union(open_).select(F.col("unit").alias("to"), F.col("to").alias("next"), "open")
        moved = written(open_.drop("open").join(further, "to").select("unit", F.col("next").alias("to"), "n", "open"), "links", narrow=True)
        done, open_ = done.union(moved.where("NOT open")), moved.where("open")
    links = done
    tails = links.groupBy("to").agg(F.sum("n").alias("extra")).withColumnRenamed("to", "unit")
    heads = named.join(links.select("unit"), "unit", "left_anti").join(tails, "unit", "left")
    return heads.select("unit", (F.col("n") + F.coalesce("extra", F.lit(0))).cast("int").alias("n"), F.col("place.id").alias("first_id"), F.col("place.tie").alias("first_tie"), F.col("place.at").alias("first_at"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = GRAM, name_bits: int = 64, compact: bool = True) -> DataFrame:
    """(id, tie, unit, start, stop, again): the words of each occurrence of a repeated path, and whether it is not the first.

    Without `compact` there is a row for each edge, and `again` is left to verification. `name_bits` shortens the edges' names,
    so that tests can let them collide."""
    tables = repeated_edges(docs, id_col, text_col, k, m, name_bits, compact)
    whole = tables[0].unionByName(tables[1])
    if not compact:
        return whole.where(F.col("role") == OCCURRENCE).select("id", "tie", "unit", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + k).alias("stop"), F.lit(False).alias("again"))
    heads = written(paths(whole.where(F.col("role") == EDGE).drop("role")), "heads", narrow=True)
    occurrences = whole.where(F.col("role") == OCCURRENCE).select("unit", "id", "tie", "at").join(heads, "unit")
    again = (F.col("id") != F.col("first_id")) | (F.col("tie") != F.col("first_tie")) | (F.col("at") != F.col("first_at"))
    return occurrences.select("id", "tie", "unit", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + k).alias("stop"), again.alias("again"))


def _removed(joined: DataFrame, text: bool, verify: bool) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, id, tie, kept, paths) of (doc_id, text, id, tie, spans); `paths` is what verification compares."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, id long, tie long, kept string, paths array<struct<unit:bigint,start:bigint,stop:bigint,digest:binary>>"
    path = pa.list_(pa.struct([("unit", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("digest", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, found in zip(b.column(1).to_pylist(), b.column(4)):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                gone, kept, seen = 0, words, []
                if found.is_valid:
                    # a colliding name may reach past the end
                    unit, start, stop, again = (found.values.field(c).to_numpy(zero_copy_only=False) for c in ("unit", "start", "stop", "again"))
                    stop = np.minimum(stop, len(words))
                    mask = spans.covered(start[again], stop[again], len(words))
                    gone = int(mask.sum())
                    kept = list(compress(words, (~mask).tolist()))
                    if verify:
                        seen = [{"unit": u, "start": i, "stop": j, "digest": hashlib.blake2b(b" ".join(words[i:j]), digest_size=16).digest()} for u, i, j in zip(unit.tolist(), start.tolist(), stop.tolist())]
                kept = b" ".join(kept)
                rows.append((len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if text else None, seen))
            n, gone, digest, kept, seen = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), b.column(2), b.column(3), pa.array(kept, pa.string()), pa.array(seen, path)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "id", "tie", "kept", "paths"])

    return joined.mapInArrow(tidy(run), schema)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, text: bool = True, name_bits: int = 64) -> DataFrame:
    """For each row of `docs`: doc_id, n_words, n_removed, kept_sha256 and, with `text`, what is kept."""
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if text else [])]

    def read(found: DataFrame, verify: bool) -> DataFrame:
        return _removed(spans.with_spans(docs, id_col, text_col, found), text, verify)

    def seen(out: DataFrame) -> DataFrame:
        return out.select("id", "tie", F.explode("paths").alias("p")).select("id", "tie", "p.*")

    out = written(read(repeated_spans(docs, id_col, text_col, k, name_bits=name_bits), True), "removed")
    if seen(out).groupBy("unit").agg((F.min("digest") != F.max("digest")).alias("differ")).where("differ").isEmpty():
        return out.select(*columns)
    edges = written(seen(read(repeated_spans(docs, id_col, text_col, k, name_bits=name_bits, compact=False), True)), "seen")
    firsts = edges.groupBy("unit", "digest").agg(F.min(F.struct("id", "tie", "start")).alias("first"))
    told = edges.join(firsts, ["unit", "digest"]).select("id", "tie", "unit", "start", "stop", (F.struct("id", "tie", "start") != F.col("first")).alias("again"))
    return read(told, False).select(*columns)
