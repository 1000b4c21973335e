"""Lloyd's clustering on distinct quantised vectors.

Vectors become whole numbers, and equal ones are grouped to one row with its multiplicity: from there on the rounds
read distinct vectors only. A round gives each of them its nearest centroid and adds up, a task at a time, the
weighted components by centroid; Spark adds up the tasks' sums, and the new centroids are their exact quotients,
rounded down. All is done in whole numbers, so neither order nor partitions nor reruns change anything. At last the
distinct vectors' assignments are joined back to the rows they stand for.

A vector that very many rows have is one row in the rounds. In the join back such vectors (at most a thousand, those
with a thousandth of all rows at least) are broadcast, and the others meet by shuffle. What reaches the driver are
the centroids and their sums: clusters times components, both parameters.

Defined results: vectors that are null, hold a null, NaN or infinite component or have another number of components
than `length` take no part and have no row; components beyond 2**27 on either side count as 2**27 (so that every distance
fits a long); repeated rows each have a row and weigh in the sums; ties go to the smaller number of a centroid. Seeds are
the rows with the smallest digests of their ids, a null id after all others, equal digests in the order of the packed vectors;
fewer rows than clusters make fewer clusters; an empty table gives no rows. Other columns are of no concern.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy, written
from .vectors import packed, product, sums_by, unpack

LIMIT = 1 << 27
HOT_SHARE, HOT_ROWS = 1_000, 1_000  # a vector is hot with a thousandth of all rows, and with so many at least


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of `centres` to each row of `x`, the smaller number on ties, and the squared distance."""
    apart = np.einsum("ij,ij->i", x, x)[:, None] - 2 * product(x, centres.T) + np.einsum("ij,ij->i", centres, centres)[None, :]
    best = np.argmin(apart, axis=1)
    return best, apart[np.arange(len(x)), best]


def seeds(kept: DataFrame, k: int, seed: int) -> list[bytes]:
    """The packed vectors of the k rows whose ids have the smallest digests."""
    named = kept.select("q", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("digest"))
    return [bytes(r.q) for r in named.orderBy(F.col("digest").asc_nulls_last(), "q").limit(k).collect()]


def _assigned(distinct: DataFrame, shared, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, apart = nearest(unpack(b.column(0).to_pylist(), length), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.int32()), pa.array(apart, pa.int64())], names=["q", "weight", "cluster", "distance"])

    return distinct.mapInArrow(tidy(run), "q binary, weight long, cluster int, distance long")


def step(distinct: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after one round over distinct vectors (q, weight)."""
    shared, (k, length) = distinct.sparkSession.sparkContext.broadcast(centres), centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sums = np.zeros(k, np.int64), np.zeros((k, length), np.int64)
        for b in batches:
            x, w = unpack(b.column(0).to_pylist(), length), b.column(1).to_numpy()
            best, _ = nearest(x, shared.value)
            np.add.at(weights, best, w)
            for c in np.unique(best).tolist():
                sums[c] += w[best == c] @ x[best == c]
        c, d = np.divmod(np.arange(k * length), max(1, length))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(weights[c], pa.int64()), pa.array(sums.ravel(), pa.int64())], names=["cluster", "dim", "n", "s"])

    after = centres.copy()
    for r in sums_by(distinct.mapInArrow(tidy(run), "cluster int, dim int, n long, s long").where("n > 0"), ["cluster", "dim"], ["n", "s"]):
        after[r.cluster, r.dim] = int(r.s) // int(r.n)
    return after


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, length: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and weight (how many rows have the same vector)."""
    spark: SparkSession = vectors.sparkSession
    kept = written(packed(vectors, id_col, vector_col, scale, LIMIT, length), "kept")
    distinct = written(kept.groupBy("q").agg(F.count(F.lit(1)).alias("weight")), "distinct")
    centres = unpack(seeds(kept, k, seed), length)
    if not len(centres):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, weight long")
    for _ in range(rounds):
        centres = step(distinct, centres)
    found = written(_assigned(distinct, spark.sparkContext.broadcast(centres), length), "assigned")
    inertia = {r.cluster: (int(r.n), int(r.spread)) for r in sums_by(found.select("cluster", F.col("weight").alias("n"), (F.col("weight").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).alias("spread")), ["cluster"], ["n", "spread"])}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    whole = sum(s for _, s in inertia.values())
    fits = lambda x: x if x < 1 << 63 else None
    facts = spark.createDataFrame([(c, fits(s), fits(whole), digests[c]) for c, (_, s) in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    hot = F.col("weight") >= max(HOT_ROWS, -(-sum(n for n, _ in inertia.values()) // HOT_SHARE))
    often = kept.join(F.broadcast(found.where(hot)), "q")
    rest = kept.join(F.broadcast(found.where(hot).select("q")), "q", "left_anti").join(found.where(~hot), "q")
    return often.unionByName(rest).join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "weight")
