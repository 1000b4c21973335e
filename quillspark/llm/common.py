"""What the training-data operators share: words, shared storage, grouped streaming, components."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.executors import ship

#: ASCII white space as the operators' contracts define it.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\f\r"

_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


# ------------------------------------------------------------------ words

def words(text: Column) -> Column:
    """Array of maximal runs of other characters than ASCII white space; null gives an empty array."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def free_name(columns: list[str], name: str) -> str:
    """A column name that none of `columns` has, whatever the case."""
    return "_" * (1 + max((len(c) for c in columns), default=0)) + name


# ---------------------------------------------------------- shared storage

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only if unset on a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("quillspark.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("quillspark.shared.dir", found)
        _written.append((spark, found))
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for spark, table in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the session may be gone at exit
            break
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone at exit
            return


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path.rsplit("/", 1)[0]))
    return path


def release(spark: SparkSession, path: str) -> None:
    """Remove a table that no result reads any more."""
    _remove(spark, path.rsplit("/", 1)[0])


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage, and outlives the executors that made it.

    `narrow` is for tables of a few numbers a row that only native operations made: an eighth of the shuffle's tasks
    write them, as each file costs more than its rows do."""
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    if not narrow:
        spark.sparkContext._jvm.System.gc()  # shuffle files go once the driver's objects for them do
    return out


def written_in_buckets(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """`df` as a table in the shared folder, bucketed by a column: what is joined to it by that column comes to it, and it stays where it is.
    Buckets need a name in the session's catalogue, which is dropped with the table when the driver's process ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = "quillspark_" + path.rsplit("/", 2)[1].rsplit("-", 1)[1]
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    _tables.append((spark, table))
    return spark.table(table)


def drop_written(df: DataFrame) -> None:
    release(df.sparkSession, df._quillspark_path)


def written_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` gives as a written table, without the tables that were written on the way."""
    before = len(_written)
    out = written(make(), name)
    for spark, path in _written[before:]:
        if path != out._quillspark_path.rsplit("/", 1)[0] and path != spark.conf.get("quillspark.shared.dir", None):
            _remove(spark, path)
    return out


# ------------------------------------------------------- grouped streaming

def give_back() -> None:
    """Return freed memory of this process to the system: workers outlive their tasks, and stand beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run` for mapInArrow, which gives memory back when a task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def map_groups(df: DataFrame, keys: list[str], sort: list[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch | pa.Table]], schema: str | T.StructType, min_rows: int = 20_000) -> DataFrame:
    """Shuffle by `keys`, sort by keys and `sort`, and give `fn` tables of whole groups with the groups' offsets.

    One Python call serves many small groups, which applyInPandas doesn't. A group has to fit in memory:
    callers split large ones first.
    """
    ship(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def emit(table: pa.Table, last: bool):
            new = np.zeros(table.num_rows, bool)
            if table.num_rows:
                new[0] = True
            for k in keys:
                col = table.column(k).combine_chunks()
                a, b = col.slice(1), col.slice(0, len(col) - 1)
                differ = pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False)
                new[1:] |= differ
            starts = np.flatnonzero(new)
            if last:
                return table, np.append(starts, table.num_rows), None
            cut = int(starts[-1])
            return table.slice(0, cut), np.append(starts[:-1], cut), table.slice(cut)

        def out(result):
            for x in result:
                yield from (x.to_batches() if isinstance(x, pa.Table) else [x])

        need = min_rows
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= need:
                whole, offsets, rest = emit(pa.concat_tables(held), False)
                if whole.num_rows:
                    yield from out(fn(whole, offsets))
                held, rows = [rest], rest.num_rows
                need = max(min_rows, 2 * rows)  # a long group is not looked through again at each batch
        if held:
            whole, offsets, _ = emit(pa.concat_tables(held), True)
            if whole.num_rows:
                yield from out(fn(whole, offsets))

    return df.repartition(*keys).sortWithinPartitions(*keys, *sort).select(*names).mapInArrow(tidy(run), schema)


# ------------------------------------------------------------ hashing

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Two lanes, so that a sequence has 128 bits of hash: bases and tables of bytes of their own.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _base(lane: int, seed: int) -> int:
    return (BASES[lane] + 2 * int(mix(np.array([seed], np.uint64))[0]) * seed) % (1 << 64) | 1


def _bytes_mixed(lane: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) + np.uint64((lane * 0x51ED270B + seed * 0x2545F491) % (1 << 32) << 9))


def powers(n: int, lane: int = 0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers modulo 2**64 up to n at least."""
    have = _powers.get((lane, seed))
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        base = _base(lane, seed)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        have = _powers[lane, seed] = tuple(out)
    return have


def prefix_hashes(data: np.ndarray, lane: int = 0, seed: int = 0) -> np.ndarray:
    """P with P[j] - P[i] the polynomial hash of data[i:j], shifted by the base's i-th power."""
    up, _ = powers(len(data) + 1, lane, seed)
    out = np.zeros(len(data) + 1, np.uint64)
    mixed = _bytes_mixed(lane, seed)[data] if data.dtype == np.uint8 else mix(data + np.uint64(1))
    np.cumsum(mixed * up[: len(data)], out=out[1:], dtype=np.uint64)
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal contents wherever they stand."""
    _, down = powers(len(prefix), lane, seed)
    return mix((prefix[end] - prefix[start]) * down[start])


SHORT = 16  # bytes of a word that fit the two halves of its code as they are
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACE_CHARS.encode(), np.uint8))


def _stir(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bijection on pairs of numbers."""
    b = b ^ mix(a)
    return a ^ mix(b + np.uint64(BASES[1])), b


def word_codes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit codes of each word of a text, and where the words begin. `raw` starts and ends with white space.

    Words of up to SHORT bytes are stirred by a bijection, so those of one length never get equal pairs; the pair of a longer
    word is its BLAKE2b digest. So words that differ have different codes, whatever their patterns."""
    data = np.frombuffer(raw + bytes(16), np.uint8)
    space = IS_SPACE[data[: len(raw)]]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = turns[::2], turns[1::2]
    size = end - begin
    eights = np.ndarray(len(raw) + 9, "<u8", buffer=data, strides=(1,))
    a = eights[begin] & _LOW_BYTES[np.minimum(size, 8)]
    a, b = _stir(a, size.astype(np.uint64))
    more = np.flatnonzero(size > 8)
    a[more] += eights[begin[more] + 8] & _LOW_BYTES[np.minimum(size[more] - 8, 8)]
    a[more], b[more] = _stir(a[more], b[more])
    long = np.flatnonzero(size > SHORT)
    if len(long):
        digests = b"".join([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(begin[long].tolist(), end[long].tolist())])
        a[long], b[long] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    return a, b, begin


# ------------------------------------------------------------ components

def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node that is connected to it, for each node of `edges` (longs).

    Alternates the large-star and small-star steps. Each round is one written table, so a lost executor costs a
    round at most, and nothing goes to the driver but two yes or no answers."""
    e = written(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(), "edges", narrow=True)
    while True:
        # large star: what is larger than a node goes to the node's smallest neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: what is smaller than a node goes to the smallest of it
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "stars", narrow=True)
        drop_written(e)
        e = after
        # a forest of stars: no node has two centres, and no centre is another's leaf
        if e.groupBy("u").count().where("count > 1").isEmpty() and e.select("v").distinct().join(e.select("u"), F.col("v") == F.col("u"), "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
