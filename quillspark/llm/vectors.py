"""Integer vectors for the operators on embeddings: which rows take part, how they are packed, exact products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, tidy

EXACT = 1 << 53  # whole numbers below this are exact as doubles
WIDTHS = {1: np.dtype("<i1"), 2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<i8")}


def width_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The fewest bytes that hold whole numbers from `low` to `high`, a row each."""
    out = np.full(len(low), 8, np.int64)
    for w in (4, 2, 1):
        bound = 1 << (8 * w - 1)
        out[(low >= -bound) & (high < bound)] = w
    return out


def pack(x: np.ndarray) -> list[bytes]:
    """A row's numbers as bytes, led by their width, the smallest that does: equal rows give equal bytes, and only they."""
    if not len(x):
        return []
    widths = width_of(x.min(axis=1, initial=0), x.max(axis=1, initial=0))
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        raw, step, head = np.ascontiguousarray(x[at].astype(WIDTHS[w])).tobytes(), w * x.shape[1], bytes([w])
        for k, i in enumerate(at.tolist()):
            out[i] = head + raw[k * step : (k + 1) * step]
    return out


def unpack(rows: list[bytes], width: int) -> np.ndarray:
    """`pack`'s rows as a matrix of `width` columns; what a shorter row lacks is 0."""
    out = np.zeros((len(rows), width), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, r in enumerate(rows):
        kinds.setdefault((r[0], len(r)), []).append(i)
    for (w, size), at in kinds.items():
        raw = b"".join([rows[i][1:] for i in at] if len(kinds) > 1 else [r[1:] for r in rows])
        out[at, : (size - 1) // w] = np.frombuffer(raw, WIDTHS[w]).reshape(len(at), -1)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers, exactly: as doubles where every sum is below 2**53, as longs where they hold it, else as Python's numbers."""
    top = max(1, a.shape[1]) * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b if top < 1 << 63 else a.astype(object) @ b.astype(object)


def packed(vectors: DataFrame, id_col: str, vector_col: str, scale: int, limit: int, length: int | None = None) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component x as a double, packed; rows with a null vector, a null, NaN or
    infinite component or another number of components than `length` (if given) aren't there. What is beyond `limit`
    on either side is `limit`."""
    ship(vectors.sparkSession)
    source = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("v IS NOT NULL")
    if length is not None:
        source = source.where(F.size("v") == length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(b.column(1)).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            fine = bad[ends] == bad[ends - lengths]
            with np.errstate(invalid="ignore", over="ignore"):
                q = np.clip(np.floor(scale * flat), -limit, limit)
            q = np.where(np.isfinite(flat), q, 0).astype(np.int64)
            out: list[bytes | None] = [None] * b.num_rows
            for n in np.unique(lengths[fine]).tolist():
                at = np.flatnonzero(fine & (lengths == n))
                for i, r in zip(at.tolist(), pack(q[(ends - lengths)[at][:, None] + np.arange(n)])):
                    out[i] = r
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "q"]).filter(pa.array(fine))

    return source.mapInArrow(tidy(run), "vec_id long, q binary")


def sums_by(df: DataFrame, keys: list[str], values: list[str]) -> list:
    """The sums of whole numbers by keys of a bounded number, on the driver, in as many digits as they need."""
    return df.groupBy(*keys).agg(*[F.sum(F.col(v).cast(T.DecimalType(38, 0))).alias(v) for v in values]).collect()
