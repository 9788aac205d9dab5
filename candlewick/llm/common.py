"""Helpers shared by the training-data operators: shared tables, Arrow text access, hashing, components."""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64

# ---------------------------------------------------------------- shared tables

#: Tables that ``scratch`` deletes at its end; None outside of one.
_TABLES: ContextVar[list[str] | None] = ContextVar("candlewick_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``; a local one only where that is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'candlewick-shared')}"


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def written(df: DataFrame, name: str, keep: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder, in folders for each value of ``by``, and read it again.

    The files survive the loss of an executor, unlike blocks that executors hold. They go at the end of the
    surrounding ``scratch``, unless ``keep``, and at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    files, target = _target(spark, path)
    files.deleteOnExit(target)
    tables = _TABLES.get()
    if tables is not None and not keep:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    files, target = _target(spark, path)
    files.delete(target, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        deleted(df.sparkSession, path)


#: Rows of a derived table that a file holds before it gets more files than the cluster has cores.
FILE_ROWS = 4096


def in_files(df: DataFrame, most: int) -> DataFrame:
    """``df``, which has ``most`` rows at most, in as few parts as its rows ask for: every part is a file when it is ``written``."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(most / FILE_ROWS)))


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are ``written`` inside are deleted at the end; what goes on must be ``written`` with ``keep`` before."""
    token = _TABLES.set([])
    try:
        yield
    finally:
        for path in _TABLES.get():
            deleted(spark, path)
        _TABLES.reset(token)


# ---------------------------------------------------------------- memory of workers

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def give_back() -> None:
    """Memory that is free in this process goes back to the machine, as far as the C library can do that."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(work):
    """``work`` on the batches of a task; at its end the worker, which waits for other tasks, gives back what it doesn't use."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


# ---------------------------------------------------------------- Arrow text

#: White space that separates words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    off = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def text_pieces(batch: pa.RecordBatch, column: str, most: int):
    """Slices of the batch with at most ``most`` bytes of text each, or one row."""
    if not batch.num_rows:
        return
    _, off = text_buffer(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``counts`` of them, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): nearby keys give unrelated values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values that are the same everywhere."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


#: Powers that a worker keeps for each seed; longer tables are made anew for the few texts that need them.
KEPT_POWERS = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base mod 2**64 and of its inverse."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = n if n > KEPT_POWERS else min(KEPT_POWERS, max(1 << 16, n + n // 8))
        base = int(seeded(1, seed)[0]) | 1
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[:1] = 1
            tables.append(np.multiply.accumulate(p, out=p))
        have = (tables[0], tables[1])
        if size <= KEPT_POWERS:
            _POWERS[seed] = have
    return have[0][:n], have[1][:n]


class Rolling:
    """Hashes of any runs of a sequence, from prefix sums of a polynomial mod 2**64."""

    def __init__(self, values: np.ndarray, seed: int):
        up, self.down = powers(len(values) + 1, seed)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def windows(self, length: int) -> np.ndarray:
        """The hash of each run of ``length``, not finalized."""
        return (self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length]


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and how many words each text has."""
    n = len(buf)
    solid = np.zeros(n + 2, bool)
    np.logical_not(SPACE[buf], out=solid[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    start = np.flatnonzero(solid[1:] & (~solid[:-1] | cut))
    end = np.flatnonzero(solid[:-1] & (~solid[1:] | cut))
    counts = np.diff(np.searchsorted(start, off))
    return start, end, counts


#: Bytes of a word that are read eight at a time; longer words are few for their bytes and are looked at one by one.
EIGHTS = 64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def eights(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The first EIGHTS bytes of each word, eight at a time as one number: (which words, their numbers), at first of all words."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[:-8] = buf
    at = np.ndarray((len(buf) + 1,), U64, padded, strides=(1,))
    size = end - start
    rows, k = np.arange(len(start)), 0
    while len(rows) and k < EIGHTS:
        yield rows, at[start[rows] + k] & _LOW[np.minimum(size[rows] - k, 8)]
        k += 8
        rows = rows[size[rows] > k]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of each word's bytes."""
    first, length = seeded(2, seed)
    out = (end - start).astype(U64) * (length | U64(1)) + first
    for rows, x in eights(buf, start, end):
        if len(rows) == len(out):
            out = mix(out ^ x)
        else:
            out[rows] = mix(out[rows] * U64(3) ^ x)
    for k in np.flatnonzero(end - start > EIGHTS).tolist():
        out[k] = xxhash.xxh3_64_intdigest(buf[start[k] : end[k]].tobytes(), seed)
    return out


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts in a sorted array."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


# ---------------------------------------------------------------- connected components


#: Parts of a node's edges in the joins of ``components``.
SALTS = 8


#: Edges that a task contracts at once.
PIECE_EDGES = 1_000_000


def _contracted(batches):
    """Edges (u, v) as those from each node to the least node of its component, piece by piece."""
    held, rows = [], 0

    def stars():
        nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        at = at.reshape(2, -1)
        union = Union(len(nodes))
        for x, y in zip(*at.tolist()):
            union.join(x, y)
        roots = union.roots()
        own = np.flatnonzero(roots != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[roots[own]])], names=["u", "v"])

    for batch in batches:
        for start in range(0, batch.num_rows, PIECE_EDGES):
            part = batch.slice(start, PIECE_EDGES)
            held.append(np.stack([part.column("u").to_numpy(), part.column("v").to_numpy()]))
            rows += part.num_rows
            if rows >= PIECE_EDGES:
                yield stars()
                held, rows = [], 0
    if rows:
        yield stars()


def _only_stars(e: DataFrame) -> tuple[bool, int]:
    """Whether every node has one edge at most to a smaller node, and that node none; then it is the least of its component. And how many edges there are."""
    one = lambda c, up: e.select(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("root"))
    nodes = one("u", 1).unionByName(one("v", 0)).groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    more, edges = nodes.agg(F.count_if(F.col("up") + F.col("root") > 1), F.sum("up")).first()
    return more == 0, edges or 0


def components(edges: DataFrame, src: str = "a", dst: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node of ``edges``.

    Each task first replaces its edges by those to the least node it can reach with them. Then alternating large-star and
    small-star rounds follow until only stars are left; each ends in a table in the shared folder. Aggregates
    combine before their shuffle, and joins spread the edges of a hot node over a few salts; they are merge joins at
    every size, since what they join grows with the input, and Spark splits what is still skewed.
    """
    salt = F.pmod(F.xxhash64("v", F.lit(17)), F.lit(SALTS).cast("long"))
    salted = lambda table: table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    e = edges.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).filter("u <> v")
    e = written(e.mapInArrow(lean(_contracted), "u long, v long"), "edges")
    for done in range(most_rounds + 1):
        settled, n = _only_stars(e)
        if settled:
            break
        if done == most_rounds:
            raise RuntimeError("components did not settle")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        big = both.withColumn("salt", salt).join(salted(least).hint("merge"), ["u", "salt"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.withColumn("salt", salt).join(salted(least).hint("merge"), ["u", "salt"]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # a round makes at most one edge of each direction of an old one
        after = written(in_files(small.filter("u <> v").distinct(), 2 * n), "edges")
        dropped(e)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select("v", F.col("v").alias("component")).distinct().toDF("node", "component"))


class Union:
    """Union-find over 0 .. n - 1, for the links inside one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(x) for x in range(len(self.up))), np.int64, len(self.up))


def whole_groups(batches, keys: list[str]):
    """Tables that hold whole groups of a stream sorted by ``keys``, with the row where each group starts.

    A group that goes on in the next batch is carried over to it; each batch is looked at once.
    """
    held: list[pa.RecordBatch] = []
    at: list[int] = []  # where groups start among the held rows
    rows, last = 0, None

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        ends = []
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
            ends.append((c[0], c[-1]))
        new[0] = last is None or any(x != y for (x, _), y in zip(ends, last))
        last = [y for _, y in ends]
        starts = np.flatnonzero(new)
        if len(starts) and rows + starts[-1] > 0:  # all groups but the last one are whole
            cut = int(starts[-1])
            table = pa.Table.from_batches([*held, batch.slice(0, cut)])
            yield table, np.array([*at, *(starts[:-1] + rows).tolist()], np.int64)
            held, at, rows = [batch.slice(cut)], [0], batch.num_rows - cut
        else:
            held.append(batch)
            at += (starts + rows).tolist()
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held), np.array(at, np.int64)
