"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; no target exceeds
`max_repeats` times its source's size, and what is above is shared again by weight (water filling).

Draws: each source's documents fall by a keyed hash into `n` blocks, which a keyed permutation puts in order;
epoch after epoch they form a line of block instances, of which the mix takes the first `quota`. So up to
the cut every document is taken as often as another, give or take one. From there on the line goes document by
document to its end: what still fits is taken, what doesn't is passed over, so in the end no document fits that could
be taken once more. This leaves a few steps a source, each a place in the line from which only documents up to a size
are taken; what they add is one more instance of the source.

Shards: a binary tree halves the mix; at each node the block instances of every source that go left are drawn from the
multivariate hypergeometric distribution, with a generator seeded by the node. Instances stand in the order of
the keyed permutation, so a leaf's quota of a source is a stretch of its line: leaves hold exact, disjoint quotas. A
document is taken as often as leaves hold an instance of its block, and its rows go to these leaves, which are shuffled
locally.

Numbers a source travel as a small joined table and the leaves as one array a source, both functions of the plan. Defined
results: a null text has size 0 and is never taken; sources of size 0 have target 0; repeated rows are each a document
of their own and, having equal keys, are taken alike; very long texts are taken whole or not at all; documents tie by the hash of id and text only; an
empty table gives an empty mix; other columns pass untouched. The driver holds a few numbers a source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_groups, ship, word_count, written

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
AHEAD = 8  # times the words still to take, looked through in one round
SPAN = 1 << 40  # hashes of documents within a block
MOST_SHARDS = 1 << 16  # a larger mix has larger shards
MOST_INSTANCES = 900_000_000  # of all sources in one tree; with very many sources, blocks are fewer and larger
BROADCAST_SOURCES = 100_000  # up to so many rows the table of sources is broadcast


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    weight: int
    target: float = 0.0
    blocks: int = 1  # how many blocks its documents fall into
    step: int = 1  # of the permutation
    shift: int = 0
    quota: int = 0  # block instances taken whole
    steps: tuple[tuple[int, int], ...] = ()  # places in the line, and the largest document taken from there on
    more: int = 0  # words taken beyond the quota


@dataclass(frozen=True)
class Plan:
    sources: tuple[Source, ...]
    seed: int
    shards: int = 1


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> list[Source]:
    """The sources in order with their targets."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    sources = [Source(name, size, weights[k % len(weights)]) for k, (name, size) in enumerate(order)]
    total = sum(s.size for s in sources)
    capped: set[int] = set()
    while True:
        rest = total - max_repeats * sum(sources[k].size for k in capped)
        free = sum(s.weight for k, s in enumerate(sources) if k not in capped)
        over = {k for k, s in enumerate(sources) if k not in capped and rest * s.weight > max_repeats * s.size * free}
        if not over:
            break
        capped |= over
    return [replace(s, target=float(max_repeats * s.size) if k in capped else (rest * s.weight / free if free else 0.0)) for k, s in enumerate(sources)]


def sized(docs: DataFrame, seed: int = 13) -> DataFrame:
    """`docs` with source, doc_id, size and the keyed hash of each document: by its id, and by its text so that equal ids differ."""
    df = docs.withColumn("source", F.col("source").cast("string")).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("size", word_count(F.col("text").cast("string")))
    return df.withColumn("_key", F.xxhash64("doc_id", F.xxhash64(F.col("text").cast("string")), F.lit(seed)))


def _joined(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """`df` with numbers of each row's source: `rows` starts with the source's name."""
    numbers = df.sparkSession.createDataFrame(rows, "_name string, " + schema)
    if len(rows) <= BROADCAST_SOURCES:
        numbers = F.broadcast(numbers)
    return df.join(numbers, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")


def _located(df: DataFrame, plan: Plan) -> DataFrame:
    """Add the source's number, the place of each document's block in its source's order, and its hash within the block."""
    df = _joined(df, [(s.name, k, s.blocks, s.step, s.shift) for k, s in enumerate(plan.sources)], "_k int, _blocks long, _step long, _shift long")
    df = df.withColumn("_place", F.pmod(F.pmod("_key", "_blocks") * F.col("_step") + F.col("_shift"), F.col("_blocks"))).drop("_step", "_shift")
    return df.withColumn("_within", F.pmod(F.xxhash64("_key", F.lit(plan.seed + 1)), F.lit(SPAN)))


def plan_mix(docs: DataFrame, seed: int = 13, **how) -> Plan:
    """Targets, block quotas, cuts and shards from all documents (doc_id, text, source)."""
    return plan_of(written(sized(docs.select("doc_id", "source", "text"), seed).select("source", "size", "_key"), "sizes"), seed, **how)


def plan_of(sizes: DataFrame, seed: int = 13, block_words: int = 2_000, max_blocks: int = 4_096, shard_words: int = 4_000_000) -> Plan:
    """The same from a written table (source, size, _key)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    max_blocks = max(1, min(max_blocks, MOST_INSTANCES // (MAX_REPEATS + 1) // max(1, len(totals))))
    sources = []
    for k, s in enumerate(targets([(r.source, r["size"]) for r in totals])):
        n = max(1, min(max_blocks, math.ceil(s.size / block_words)))
        rng = np.random.default_rng([seed, k])
        step = next(x for x in map(int, rng.integers(1, n + 1, 1000)) if math.gcd(x, n) == 1) if n > 1 else 1
        sources.append(replace(s, blocks=n, step=step, shift=int(rng.integers(0, n))))
    plan = Plan(tuple(sources), seed)
    located = _located(sizes, plan)

    # the words of each block, at most max_blocks numbers a source, are cut at the quota where they meet
    by_block = located.groupBy("source", "_k", "_place").agg(F.sum("size").alias("words"))
    by_block = _joined(by_block, [(s.name, s.blocks, s.target) for s in sources], "blocks long, target double")
    rest = [0] * len(sources)
    for r in map_groups(by_block.select("_k", "_place", "words", "blocks", "target"), ["_k"], ["_place"], _quotas, "k int, quota long, rest long").collect():
        sources[r.k], rest[r.k] = replace(sources[r.k], quota=r.quota), r.rest
    plan = Plan(tuple(sources), seed)

    # from there on whole documents while they fit, in rounds that look through a stretch of each source's line
    ends, start, left = [MAX_REPEATS * s.blocks for s in sources], [s.quota for s in sources], list(rest)
    steps: list[list[tuple[int, int]]] = [[] for _ in sources]
    while True:
        for k, at in enumerate(start):
            if at < ends[k] and (not steps[k] or steps[k][-1][1] != left[k]):
                steps[k].append((at * SPAN, left[k]))
        going = [k for k, at in enumerate(start) if left[k] and at < ends[k]]
        if not going:
            break
        fitting = _joined(located, [(sources[k].name, start[k], left[k]) for k in going], "start long, left long").where((F.col("size") > 0) & (F.col("size") <= F.col("left")))
        small = fitting.groupBy("_k", "_place", "_blocks", "start", "left").agg(F.sum("size").alias("words"))
        stop = {r.k: r.stop for r in map_groups(small, ["_k"], ["_place"], _stretches, "k int, stop long").collect()}
        if not stop:
            break
        instance = F.col("_epoch") * F.col("_blocks") + F.col("_place")
        ahead = _joined(fitting, [(sources[k].name, stop[k]) for k in stop], "stop long")
        ahead = ahead.withColumn("_epoch", F.explode(F.array(*[F.lit(e) for e in range(MAX_REPEATS)]))).withColumn("_at", (instance * F.lit(SPAN) + F.col("_within")).cast("long"))
        ahead = ahead.where((instance >= F.col("start")) & (instance < F.col("stop")))
        ahead = ahead.groupBy(F.col("_k").alias("k"), "_at").agg(F.sum("size").alias("total"), F.min("size").alias("least"), F.max("size").alias("most"), F.first("left").alias("left"))
        for r in map_groups(ahead, ["k"], ["_at"], _fitted, "k int, left long, starts array<long>, limits array<long>").collect():
            left[r.k] = r.left
            steps[r.k] += zip(r.starts, r.limits)
        for k, at in stop.items():
            start[k] = at
    total = sum(s.size for s in sources)
    shards = min(MOST_SHARDS, 1 << max(0, math.ceil(math.log2(max(1, total / shard_words)))))
    return Plan(tuple(replace(s, steps=tuple(steps[k]), more=rest[k] - left[k]) for k, s in enumerate(sources)), seed, shards)


def _quotas(table: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each source, how many block instances fit its target, and the words then left."""
    out = []
    for i, j in zip(offsets[:-1], offsets[1:]):
        x = {c: table.column(c).slice(i, j - i).to_numpy() for c in table.schema.names}
        words = np.zeros(x["blocks"][0], np.int64)
        words[x["_place"]] = x["words"]
        line = np.cumsum(np.tile(words, MAX_REPEATS))
        target = x["target"][0]
        quota = int(np.searchsorted(line, target + 1e-9, side="right"))
        out.append((int(x["_k"][0]), quota, int(target - (line[quota - 1] if quota else 0))))
    k, quota, rest = zip(*out)
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(quota, pa.int64()), pa.array(rest, pa.int64())], names=["k", "quota", "rest"])


def _stretches(table: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each source with a document that fits, up to which instance to look."""
    out = []
    for i, j in zip(offsets[:-1], offsets[1:]):
        x = {c: table.column(c).slice(i, j - i).to_numpy() for c in table.schema.names}
        blocks, start, left = (int(x[c][0]) for c in ("_blocks", "start", "left"))
        words = np.zeros(blocks, np.int64)
        words[x["_place"]] = x["words"]
        line = np.cumsum(np.tile(words, MAX_REPEATS)[start:])
        if len(line) and line[-1]:
            out.append((int(x["_k"][0]), min(MAX_REPEATS * blocks, start + int(np.searchsorted(line, AHEAD * left, side="right")) + 1)))
    if out:
        k, stop = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(stop, pa.int64())], names=["k", "stop"])


def _fitted(table: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each source, what is left when its documents were taken in order while they fit, and the steps of it.

    Equal documents, and others of the same place, are taken together or not at all."""
    out = []
    for i, j in zip(offsets[:-1], offsets[1:]):
        x = {c: table.column(c).slice(i, j - i).to_pylist() for c in table.schema.names}
        left = limit = x["left"][0]
        starts, limits = [], []
        for at, total, least, most in zip(x["_at"], x["total"], x["least"], x["most"]):
            takes = total <= left
            if takes and most > limit or not takes and least <= limit:
                limit = left if takes or left < least else 0
                starts.append(at)
                limits.append(limit)
            left -= total if takes else 0
        out.append((x["k"][0], left, starts, limits))
    k, left, starts, limits = zip(*out)
    longs = pa.list_(pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(left, pa.int64()), pa.array(starts, longs), pa.array(limits, longs)], names=["k", "left", "starts", "limits"])


# ------------------------------------------------------------------ shards

def quotas(plan: Plan) -> np.ndarray:
    """Block instances of each source; what the steps add is one more."""
    return np.array([s.quota + (1 if s.more else 0) for s in plan.sources], np.int64)


def leaves(plan: Plan) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each source, the shards that hold instances of it, in order, and up to which instance each holds."""
    found: list[tuple[list, list]] = [([], []) for _ in plan.sources]
    total = quotas(plan)
    open_ = [(1, np.flatnonzero(total), total[total > 0])]
    while open_:
        node, at, counts = open_.pop()
        if node >= plan.shards:
            for k, n in zip(at.tolist(), counts.tolist()):
                found[k][0].append(node - plan.shards)
                found[k][1].append(n)
            continue
        rng = np.random.default_rng([plan.seed, node])
        whole = int(counts.sum())
        half = whole // 2 + (whole % 2 and int(rng.integers(0, 2)))
        left = rng.multivariate_hypergeometric(counts, half, method="marginals") if whole else counts
        for child, part in ((2 * node + 1, counts - left), (2 * node, left)):  # the left one is next from the stack
            open_.append((child, at[part > 0], part[part > 0]))
    return [(np.array(shard, np.int32), np.cumsum(np.array(n, np.int64))) for shard, n in found]


RESULTS = ("size", "source_size", "target", "taken", "shards")


def mixed(docs: DataFrame, plan: Plan) -> DataFrame:
    """`docs` with size, source_size, target, taken, and the shard of each time the document is taken. Columns named like these are
    replaced, all others pass untouched."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS])
    return dealt(sized(docs.select(row.alias("_row"), "doc_id", "text", "source"), plan.seed), plan).select("_row.*", *RESULTS)


def dealt(df: DataFrame, plan: Plan) -> DataFrame:
    """The same for rows that have source, size and _key already."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(leaves(plan))

    @F.pandas_udf("array<int>")
    def shards(k: pd.Series, instances: pd.Series) -> pd.Series:
        k, lengths = k.to_numpy(), instances.map(len).to_numpy()
        flat = np.concatenate([*instances, np.zeros(0, np.int64)]).astype(np.int64)
        owner, out = np.repeat(k, lengths), np.zeros(len(flat), np.int32)
        for source in np.unique(owner):
            leaf, upto = held.value[source]
            at = owner == source
            out[at] = leaf[np.searchsorted(upto, flat[at], side="right")]
        return pd.Series(np.split(out, np.cumsum(lengths)[:-1])) if len(k) else pd.Series([], dtype=object)

    rows = [(s.name, s.size, s.target, s.quota, [a for a, _ in s.steps], [b for _, b in s.steps]) for s in plan.sources]
    df = _joined(_located(df, plan), rows, "source_size long, target double, _quota long, _starts array<long>, _limits array<long>")
    taken = []
    for epoch in range(MAX_REPEATS):
        instance = F.col("_blocks") * epoch + F.col("_place")
        at = instance * F.lit(SPAN) + F.col("_within")
        passed = F.size(F.filter("_starts", lambda x: x <= at))
        # beyond the quota, what the steps let pass goes along with the source's last instance
        beyond = (passed > 0) & (F.col("size") <= F.get("_limits", passed - 1))
        taken.append(F.when(instance < F.col("_quota"), instance).when(beyond, F.col("_quota")))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_instances", F.when(F.col("size") > 0, F.array_compact(F.array(*taken))).otherwise(none))
    df = df.withColumn("shards", F.when(F.size("_instances") > 0, shards("_k", "_instances")).otherwise(F.array().cast("array<int>")))
    return df.withColumn("taken", F.col("size") * F.size("shards")).drop("_starts", "_limits", "_quota")


def write_order(docs: DataFrame, plan: Plan) -> DataFrame:
    """The mix itself: the columns of `docs` for each time a document is taken, with its shard and epoch; a partition a shard,
    shuffled within."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = dealt(sized(docs.select(row.alias("_row"), "doc_id", "text", "source"), plan.seed), plan).drop("text")
    rows = rows.select("_row", "_key", F.posexplode("shards").alias("_epoch", "_shard")).withColumn("_order", F.xxhash64("_key", "_epoch", F.lit(plan.seed + 2)))
    rows = rows.repartitionById(plan.shards, F.col("_shard")).sortWithinPartitions("_order")
    extra = [F.col(f"_{c}").alias(c) for c in ("shard", "epoch") if c not in docs.columns]
    return rows.select("_row.*", *extra)


def taken_rows(docs: DataFrame, plan: Plan) -> DataFrame:
    """The mix with the columns of `docs` alone, in the order of its shards."""
    return write_order(docs, plan).select(*[F.col(f"`{c}`") for c in docs.columns])
