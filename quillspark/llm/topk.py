"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

The index holds blocks of vectors (integers, floor(scale * x)), each with one list a dimension that sorts the
block's vectors by that component. A query walks the lists of its nonzero dimensions together, from the end
that raises its score; whatever a list shows for the first time is scored in full; and it stops when no unseen
vector can reach the k-th best score so far, because the sum of the lists' current contributions is below it.
The walk deepens by a growing number of entries, so that each step is one matrix product. It has no other end than the
bound and the lists' own.

Similar vectors share a block: cells around centroids of a bounded sample, large cells dealt to several blocks. A query
first searches the block that it lies in; the k-th score there is a floor for all other blocks, of which those whose
bound is below it before the first step are not walked at all. The sample changes the work, never the result.

Queries come in chunks of fixed size, each broadcast to the blocks; a task keeps one running top-k a query over
its blocks and emits k rows a query. So memory is bounded by a chunk and a block, and blocks never move. Each
chunk's ranks are appended to one table.

Defined results: vectors that are null or hold null, NaN or infinite components take no part; a shorter vector
counts as followed by zeros; ties go to the smaller vec_id (null last); repeated rows are each a candidate, and
each a query with a list of its own; fewer candidates than k give all of them; an empty table gives no rows; only the id and the
vector are read, so other columns may have any names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import new_path, ship, tidy, written

BLOCK = 8_192
CHUNK = 4_096
FIRST_DEPTH, DEEPER = 8, 2
SAMPLE, MOST_CELLS, ROUNDS = 8_192, 256, 5  # vectors that centroids are fitted on, and how
NO_ID = np.iinfo(np.int64).max  # null ids sort last
INDEX = "n int, d int, rows binary, ids binary, values binary, lists binary"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, vec_id, q): a number for each row, its id, and its components as integers."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.when(F.col(vector_col).isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long"))).alias("q"))
    return fine.where("q IS NOT NULL")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


def _pack(rows: np.ndarray, ids: np.ndarray, values: np.ndarray) -> dict:
    lists = np.argsort(-values, axis=0, kind="stable").T.astype(np.int32)  # one list a dimension, largest first
    return {"n": len(ids), "d": values.shape[1], "rows": rows.tobytes(), "ids": ids.tobytes(), "values": values.tobytes(), "lists": np.ascontiguousarray(lists).tobytes()}


def centroids(sample: np.ndarray, n_cells: int) -> np.ndarray:
    """Directions around which the sample gathers: some rounds of spherical k-means."""
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    c = x[np.random.default_rng(7).permutation(len(x))[:n_cells]]
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
    return c


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, block: int = BLOCK) -> DataFrame:
    """All vectors in blocks with their sorted lists, as a written table."""
    spark = vectors.sparkSession
    ship(spark)
    schema = pa.schema([("n", pa.int32()), ("d", pa.int32()), *((c, pa.binary()) for c in ("rows", "ids", "values", "lists"))])
    whole = written(quantized(vectors, id_col, vector_col, scale), "quantized")
    n = whole.count()
    sampled = [r.q for r in whole.select("q", F.xxhash64("row").alias("h")).where(F.pmod("h", F.lit(max(1, n // SAMPLE))) == 0).limit(SAMPLE).collect()]
    width = max(map(len, sampled), default=0)
    sample = np.array([q + [0] * (width - len(q)) for q in sampled], np.float64).reshape(len(sampled), width)
    n_cells = max(1, min(MOST_CELLS, n // block, len(sampled)))
    shared = spark.sparkContext.broadcast(centroids(sample, n_cells) if n_cells > 1 else None)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.zeros(b.num_rows, np.int32)
            if shared.value is not None:
                x = _matrix(b.column(2))[:, :width].astype(np.float64)
                cell = np.argmax(x @ shared.value[:, : x.shape[1]].T, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=["row", "vec_id", "q", "cell"])

    placed = written(whole.mapInArrow(tidy(near), "row long, vec_id long, q array<bigint>, cell int"), "cells")
    # one row a cell; a large cell is dealt to as many blocks as it needs
    dealt = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    placed = placed.join(F.broadcast(dealt), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def flush():
            t = pa.concat_tables(held).combine_chunks()
            for at in range(0, t.num_rows, 2 * block):
                p = t.slice(at, 2 * block)
                column = lambda c: p.column(c).combine_chunks()  # noqa: E731,B023
                ids = column("vec_id").fill_null(NO_ID).to_numpy()
                yield pa.RecordBatch.from_pylist([_pack(column("row").to_numpy(), ids, _matrix(column("q")))], schema)

        for b in batches:
            keys = list(zip(b.column(3).to_pylist(), b.column(4).to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if held and keys[i] != key:
                    yield from flush()
                    held = []
                if j > i:
                    held.append(pa.Table.from_batches([b.slice(i, j - i)]))
                    key = keys[i]
        if held:
            yield from flush()

    dealt_out = placed.select("row", "vec_id", "q", "cell", "part").repartition("cell", "part").sortWithinPartitions("cell", "part", "row")
    return written(dealt_out.mapInArrow(tidy(run), INDEX), "index")


class Block:
    def __init__(self, r: dict):
        n, d = r["n"], r["d"]
        self.rows, self.ids = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
        exact = np.frombuffer(r["values"], np.int64).reshape(n, d)
        self.lists = np.frombuffer(r["lists"], np.int32).reshape(d, n)
        self.exact = exact
        self.size = int(np.abs(exact).max(initial=0))
        self.values = exact.astype(np.float64)
        self.high, self.low = (exact.max(axis=0), exact.min(axis=0)) if n else (np.zeros(d), np.zeros(d))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no score of the block with a query exceeds: the lists' contributions before the first step (a little
        above where doubles round)."""
        q = queries.astype(np.float64)
        bound = np.maximum(q, 0) @ self.high.astype(np.float64) + np.minimum(q, 0) @ self.low.astype(np.float64)
        return bound + np.abs(bound) * 1e-9 + 1

    def exact_in_double(self, q: np.ndarray) -> bool:
        """Whether every partial sum of an inner product with `q` is below 2**53."""
        return self.size * int(np.abs(q).max(initial=0)) * max(1, len(q)) < 1 << 53

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products as integers."""
        if self.exact_in_double(q):
            return (self.values[at] @ q.astype(np.float64)).astype(np.int64)
        return self.exact[at] @ q


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:  # whatever ties with the k-th stays in
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= kth
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _aligned(q: np.ndarray, d: int) -> np.ndarray:
    return q if len(q) == d else np.concatenate((q[:d], np.zeros(max(0, d - len(q)), np.int64)))


def threshold_search(block: Block, q: np.ndarray, own: int, k: int, scores: np.ndarray, ids: np.ndarray, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, str, int]:
    """The top k of what (scores, ids) hold already and of the block, the row `own` left out; vectors that score below
    `floor` may be missing. Also tells what ended the walk, "bound" or "lists", and how many vectors it saw."""
    n = len(block.ids)
    q = _aligned(q, block.values.shape[1])
    dims = np.flatnonzero(q)
    seen = block.rows == own
    if not len(dims):  # no list to walk: all scores are 0
        at = np.flatnonzero(~seen)
        return *best(np.concatenate((scores, np.zeros(len(at), np.int64))), np.concatenate((ids, block.ids[at])), k), "lists", len(at)
    weight, up = q[dims], q[dims] > 0
    unseen = n - int(seen.sum())
    depth, step, shown = 0, FIRST_DEPTH, 0
    while True:
        least = scores[-1] if len(scores) == k else None
        if floor is not None:
            least = floor if least is None else max(least, floor)
        if least is not None:
            # dimensions with a negative weight are read from the other end
            edge = np.where(up, block.lists[dims, depth], block.lists[dims, n - 1 - depth])
            # whole numbers below 2**53 in doubles, or Python's own
            if block.exact_in_double(q):
                bound = float(weight.astype(np.float64) @ block.values[edge, dims])
            else:
                bound = sum(int(a) * int(b) for a, b in zip(weight, block.exact[edge, dims]))
            if bound < least:  # at equality an unseen vector with a smaller id could tie
                return scores, ids, "bound", shown
        reach = min(n, depth + step)
        fresh = np.zeros(n, bool)
        fresh[block.lists[dims[up], depth:reach].ravel()] = True
        fresh[block.lists[dims[~up], n - reach : n - depth].ravel()] = True
        at = np.flatnonzero(fresh & ~seen)
        seen[at] = True
        shown += len(at)
        if len(at):
            scores, ids = best(np.concatenate((scores, block.scores(at, q))), np.concatenate((ids, block.ids[at])), k)
        depth, step = reach, step * DEEPER
        if shown == unseen:  # the lists have nothing new to show
            return scores, ids, "lists", shown


def search(index: DataFrame, query: str, k: int = 20, chunk: int = CHUNK) -> DataFrame:
    """For each indexed vector for which the SQL condition `query` on vec_id holds: its k best others."""
    spark = index.sparkSession
    ship(spark)
    schema = "query_row long, query_id long, vec_id long, score long"

    # each chunk of queries is one row; the driver holds one at a time
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                values = np.frombuffer(r["values"], np.int64).reshape(r["n"], r["d"])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["rows"], np.int64)), pa.array([None if i == NO_ID else i for i in np.frombuffer(r["ids"], np.int64).tolist()], pa.int64()), pa.array(list(values), pa.list_(pa.int64()))], names=["row", "vec_id", "q"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, vectors = [], [], []
        for b in batches:
            for row, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                rows.append(row)
                ids.append(i)
                vectors.append(np.array(v, np.int64))
                if len(rows) == chunk:
                    yield pa.RecordBatch.from_pydict({"chunk": [pickle.dumps((rows, ids, vectors))]})
                    rows, ids, vectors = [], [], []
        if rows:
            yield pa.RecordBatch.from_pydict({"chunk": [pickle.dumps((rows, ids, vectors))]})

    wanted = index.mapInArrow(tidy(unpack), "row long, vec_id long, q array<bigint>").where(query)
    n_queries = wanted.count()
    chunks = wanted.repartition(max(1, -(-n_queries // chunk))).mapInArrow(tidy(pack), "chunk binary")

    def job(shared, home: bool):
        """Queries against blocks: each against its own block only (`home`), or against all with the floors found so."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (rows, ids, vectors), floors = pickle.loads(shared.value)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in rows]
            for b in batches:
                for r in b.to_pylist():
                    block = Block(r)
                    if home:
                        walked = np.flatnonzero(np.isin(np.array(rows, np.int64), block.rows))
                    else:
                        bounds = block.bounds(np.array([_aligned(q, block.values.shape[1]) for q in vectors]))
                        walked = [i for i, f in enumerate(floors) if f is None or bounds[i] >= f]
                    for i in walked:
                        found[i] = threshold_search(block, vectors[i], rows[i], k, *found[i], floors[i])[:2]
            lengths = [len(s) for s, _ in found]
            if sum(lengths):
                back = lambda x: pa.array([None if i == NO_ID else i for i in x.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(rows, np.int64), lengths)), pa.array([i for i, n in zip(ids, lengths) for _ in range(n)], pa.int64()), back(np.concatenate([i for _, i in found])), pa.array(np.concatenate([s for s, _ in found]))], names=["query_row", "query_id", "vec_id", "score"])

        return run

    path, best_of = new_path(spark, "ranked"), Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    some = False
    for r in chunks.toLocalIterator():
        queries = pickle.loads(r.chunk)
        first = spark.sparkContext.broadcast(pickle.dumps((queries, [None] * len(queries[0]))))
        at_home = index.mapInArrow(tidy(job(first, True)), schema).groupBy("query_row").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
        floors = {x.query_row: x.floor for x in at_home.where(F.col("n") == k).collect()}  # a row a query of the chunk
        shared = spark.sparkContext.broadcast(pickle.dumps((queries, [floors.get(i) for i in queries[0]])))
        ranked = index.mapInArrow(tidy(job(shared, False)), schema).withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") <= k)
        ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(path)
        some = True
    result = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(result).parquet(path) if some else spark.createDataFrame([], result)
