"""Whitening of embeddings by a covariance that is added up in tiles.

Vectors become whole numbers x. Their sums give a whole number near each dimension's mean, which is taken off before
anything is multiplied. Each task cuts its vectors into row blocks, and these into column blocks; the column blocks of a row
block meet by shuffle, every pair of them is multiplied, and the products are added up by tile, that is by the pair
of column blocks. As all of it is whole numbers, the sums are exact, whatever the order; the driver takes off the
rest of the means (as exactly), assembles the tiles, and gets the eigenvectors of a matrix of dimensions times dimensions.
The vectors are then projected where they lie.

A row block has a fixed number of rows, so no shuffled group grows with the input; what reaches the driver grows with the
square of the dimensions alone.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part and have no row; a shorter
vector counts as followed by zeros; components beyond 2**40 (after scaling) on either side count as 2**40; repeated rows each
count and have rows of their own; null ids stay null. Components with an eigenvalue of zero (within the precision of doubles)
have no direction to scale: their `whitened` is null, and they are left out of `identity_error`, which is null if there is no other. `explained` is
null if no vector differs from another; `deviation` is null where it doesn't fit a long. Fewer dimensions than components give fewer components; an empty
table gives no rows. Equal eigenvalues leave the choice of their vectors to the solver; the sign is that which makes the largest entry
positive. Other columns are of no concern.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_groups, tidy, written
from .vectors import pack, packed, product, sums_by, unpack

LIMIT = 1 << 40
TILE, ROWS = 32, 1_024  # columns of a tile, rows of a row block
HALF = 62  # sums are sent as two parts, of which the lower has so many bits
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def moments(kept: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(dims, object)
        for b in batches:
            n, s = n + b.num_rows, s + unpack(b.column(1).to_pylist(), dims).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(s.tolist(), pa.int64())], names=["dim", "n", "s"])

    found = {r.dim: r for r in sums_by(kept.mapInArrow(tidy(run), "dim int, n long, s long"), ["dim"], ["n", "s"])}
    return (int(found[0].n), [int(found[d].s) for d in range(dims)]) if found else (0, [0] * dims)


def column_blocks(kept: DataFrame, near: list[int], tile: int, rows: int) -> DataFrame:
    """(row_block, col_block, n, z): the vectors less `near`, cut into blocks."""
    dims = len(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, rows):
                z = unpack(b.column(1).slice(at, rows).to_pylist(), dims) - np.array(near, np.int64)
                made = [{"row_block": block, "col_block": k, "n": len(z), "z": pack(z[:, a : a + tile].reshape(1, -1))[0]} for k, a in enumerate(range(0, dims, tile))]
                yield pa.RecordBatch.from_pylist(made, pa.schema([("row_block", pa.int64()), ("col_block", pa.int32()), ("n", pa.int32()), ("z", pa.binary())]))
                block += 1

    return kept.mapInArrow(tidy(run), "row_block long, col_block int, n int, z binary")


def tile_sums(blocks: DataFrame, dims: int, tile: int) -> DataFrame:
    """(a, b, pos, low, high): sums of products for each entry of the tile of column blocks a <= b; the sum is high * 2**HALF + low."""

    def multiply(table: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        cols, sizes, raw = (table.column(c).combine_chunks() for c in ("col_block", "n", "z"))
        for i, j in zip(offsets, offsets[1:]):
            blocks = [(int(cols[k].as_py()), unpack([raw[k].as_py()], sizes[k].as_py() * min(tile, dims - tile * cols[k].as_py())).reshape(sizes[k].as_py(), -1)) for k in range(i, j)]
            for k, (a, x) in enumerate(blocks):
                for b, y in blocks[k:]:
                    p = product(x.T, y).ravel()
                    have = sums.get((a, b))
                    if have is None:
                        sums[a, b] = p
                    else:
                        safe = have.dtype != object and p.dtype != object and max(np.abs(have).max(), np.abs(p).max()) < 1 << 61
                        sums[a, b] = have + p if safe else have.astype(object) + p.astype(object)
        for (a, b), s in sums.items():
            s = s.astype(object) if s.dtype == object else s
            yield pa.RecordBatch.from_arrays(
                [pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([(s & ((1 << HALF) - 1)).tolist()], pa.list_(pa.int64())), pa.array([(s >> HALF).tolist()], pa.list_(pa.int64()))],
                names=["a", "b", "low", "high"],
            )

    products = map_groups(blocks, ["row_block"], ["col_block"], multiply, "a int, b int, low array<long>, high array<long>", min_rows=64)
    entries = products.select("a", "b", F.posexplode(F.arrays_zip("low", "high")).alias("pos", "e")).select("a", "b", "pos", "e.low", "e.high")
    return entries.groupBy("a", "b", "pos").agg(*[F.sum(F.col(c).cast(T.DecimalType(38, 0))).alias(c) for c in ("low", "high")])


def assembled(sums: DataFrame, n: int, s: list[int], near: list[int], tile: int) -> np.ndarray:
    """The covariance matrix, each entry the double nearest to the exact value."""
    dims = len(s)
    v = np.zeros((dims, dims))
    rest = [a - n * b for a, b in zip(s, near)]
    for batch in sums.toArrow().to_batches():
        for a, b, pos, low, high in zip(*[c.to_pylist() for c in batch.columns]):
            wide = min(tile, dims - b * tile)
            i, j = a * tile + pos // wide, b * tile + pos % wide
            v[i, j] = v[j, i] = float(Fraction(n * ((int(high) << HALF) + int(low)) - rest[i] * rest[j], n * n))
    return v


def directions(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns. A value that is zero within precision is 0."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    values = np.where(values > len(v) * np.finfo(float).eps * max(values.max(initial=0), 0), values, 0.0)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values, vectors


class Whitener:
    """Projects packed vectors on the components; the same in every task."""

    def __init__(self, n: int, s: list[int], values: np.ndarray, vectors: np.ndarray):
        self.n, self.s, self.dims = n, s, len(s)
        self.used = values > 0
        self.scaled = vectors[:, self.used] / np.sqrt(values[self.used])

    def apart(self, rows: list[bytes]) -> np.ndarray:
        """n * x - S, exactly."""
        x = unpack(rows, self.dims)
        if self.n * (1 + int(np.abs(x).max(initial=0))) + max(map(abs, self.s), default=0) < 1 << 62:
            return self.n * x - np.array(self.s, np.int64)
        return self.n * x.astype(object) - np.array(self.s, object)

    def project(self, apart: np.ndarray) -> np.ndarray:
        return (apart / self.n).astype(np.float64) @ self.scaled

    @staticmethod
    def deviation(apart: np.ndarray) -> list[int | None]:
        top = int(np.abs(apart).max(initial=0))
        if apart.shape[1] * top * top < 1 << 63:
            return np.einsum("ij,ij->i", apart.astype(np.int64), apart.astype(np.int64)).tolist()
        return [x if x < 1 << 63 else None for x in (apart.astype(object) ** 2).sum(axis=1).tolist()]


def identity_error(kept: DataFrame, shared) -> float | None:
    """The largest entry of the whitened vectors' covariance less the identity, from the vectors themselves."""
    k = int(shared.value.used.sum())
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, sums = shared.value, np.zeros((k + 1, k))
        for b in batches:
            p = w.project(w.apart(b.column(1).to_pylist()))
            sums[:k] += p.T @ p
            sums[k] += p.sum(axis=0)
        i, j = np.divmod(np.arange((k + 1) * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums.ravel())], names=["i", "j", "v"])

    total = np.zeros((k + 1, k))
    for r in kept.mapInArrow(tidy(run), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v / shared.value.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    x is floor(scale * component). A constant added to all of it would change neither deviations nor covariances."""
    spark = vectors.sparkSession
    kept = written(packed(vectors, id_col, vector_col, scale, LIMIT), "packed")
    dims = kept.agg(F.max((F.octet_length("q") - 1) / F.conv(F.hex(F.substring("q", 1, 1)), 16, 10).cast("int"))).first()[0]
    if not dims:
        return spark.createDataFrame([], OUT)
    n, s = moments(kept, int(dims))
    near = [a // n for a in s]
    v = assembled(tile_sums(column_blocks(kept, near, tile, rows), len(s), tile), n, s, near, tile)
    values, vectors_ = directions(v, components)
    shared = spark.sparkContext.broadcast(Whitener(n, s, values, vectors_))
    error, trace = identity_error(kept, shared), float(np.trace(v))
    explained = [float(e / trace) if trace > 0 else None for e in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m = shared.value, len(values)
        for b in batches:
            apart = w.apart(b.column(1).to_pylist())
            found = np.full((b.num_rows, m), np.nan)
            found[:, w.used] = w.project(apart)
            times = np.repeat(np.arange(b.num_rows), m)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, m + 1), b.num_rows), pa.int32()), pa.array([n] * len(times), pa.int64()),
                 pa.array(w.deviation(apart), pa.int64()).take(pa.array(times)), pa.array(found.ravel(), pa.float64(), from_pandas=True),
                 pa.array(explained * b.num_rows, pa.float64()), pa.array([error] * len(times), pa.float64())],
                names=[f.split()[0] for f in OUT.split(", ")],
            )

    return kept.mapInArrow(tidy(run), OUT)
