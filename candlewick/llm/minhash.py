"""MinHash near-duplicate detection on sets of 5-word shingles, by fast similarity sketching.

Each set fills ``COORDINATES`` bins in rounds: in an early round an element falls in a hashed bin, in a late
round all elements fall in one given bin, so every bin is filled and rarely more than a few rounds are run.
Bands of coordinates find candidates, and full sets confirm every link.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, Rolling, Union, blobs, components, in_files, lean, mix, runs, seeded, text_buffer, text_pieces, whole_groups, word_bounds, word_hashes, written

#: Chance that the bands miss a pair at the least similarity, and that its equal coordinates are too few for a candidate.
MISS = 4e-7
#: Bands that a plan may have before it takes fewer coordinates a band.
MOST_BANDS = 40
SHINGLE = 5


@functools.cache
def plan(percent: int) -> tuple[int, int, int]:
    """Bands, coordinates a band, and the least number of equal coordinates of a candidate: each misses a pair with
    a similarity of ``percent`` / 100 with a chance of at most MISS."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent is {percent}, not 1 to 100")
    s = percent / 100
    needed = lambda rows: 1 if percent == 100 else math.ceil(math.log(MISS) / math.log1p(-(s**rows)))
    rows = next((r for r in (4, 3, 2) if needed(r) <= MOST_BANDS), 1)
    bands = needed(rows)
    n, below, least = bands * rows, 0.0, 0
    while least < n and (below := below + math.comb(n, least) * s**least * (1 - s) ** (n - least)) <= MISS:
        least += 1
    return bands, rows, least


#: The plan of the query, 20 bands of 4 coordinates.
BANDS, ROWS, _ = plan(85)
COORDINATES = BANDS * ROWS
#: Members of a bucket or cluster that meet in one task; larger ones are joined block by block.
BLOCK = 2048
PIECE = 1 << 20
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (64-bit hashes) of each text in ascending order, and how many each has."""
    n = len(off) - 1
    buf = LOWER[buf]
    start, end, counts = word_bounds(buf, off)
    rolling = Rolling(word_hashes(buf, start, end), 3)
    first = np.cumsum(counts) - counts
    per = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    at = np.repeat(first - (np.cumsum(per) - per), per) + np.arange(per.sum())
    owner = np.repeat(np.arange(n), per)
    values = rolling.of(at, at + np.minimum(counts, SHINGLE)[owner])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=n)


def sketches(values: np.ndarray, counts: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """``coordinates`` 64-bit coordinates of each set: the round in the high half, a hash in the low half."""
    n, t = len(counts), coordinates
    out = np.full(n * t, _EMPTY, U64)
    owner = np.repeat(np.arange(n), counts)
    seeds = seeded(2 * t, 7)
    for i in range(2 * t):
        h = mix(values ^ seeds[i])
        place = ((h & U64(0xFFFFFFFF)) * U64(t) >> U64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + place, (U64(i) << U64(32)) | (h >> U64(32)))
        open_ = (out.reshape(n, t) == _EMPTY).any(axis=1) & (counts > 0)
        if not open_.any():
            break
        more = open_[owner]
        values, owner = values[more], owner[more]
    return out.reshape(n, t)


def _band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.zeros((len(sketch), bands), U64)
    for b in range(bands):
        key = np.full(len(sketch), b + 1, U64)
        for c in range(rows):
            key = mix(key * U64(31) + sketch[:, b * rows + c])
        keys[:, b] = key
    return keys


def sketched(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch, bands): set_key is a 128-bit hash of the whole set, null if empty."""
    n_bands, rows, _ = plan(percent)

    def run(batches):
        for batch in batches:
            for piece in text_pieces(batch, "text", PIECE):
                values, counts = shingle_sets(*text_buffer(piece.column("text")))
                sketch = sketches(values, counts, n_bands * rows)
                ends = np.cumsum(counts)
                keys = [xxhash.xxh3_128_digest(values[e - c : e].tobytes()) if c else None for e, c in zip(ends, counts)]
                low = np.ascontiguousarray(sketch & U64(0xFFFF)).astype(np.uint16)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * n_bands), pa.array(_band_keys(sketch, n_bands, rows).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts, pa.int64()), blobs(keys), blobs([x.tobytes() for x in low]), bands], names=["doc_id", "n_shingles", "set_key", "sketch", "bands"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, set_key binary, sketch binary, bands array<long>")


def in_blocks(members: DataFrame, key: str, size: str, block: int = BLOCK) -> DataFrame:
    """One row of each member for each pair (i, j) of blocks that it takes part in; ``size`` is its group's size.

    Groups of up to ``block`` members have the one pair (0, 0). Larger ones are dealt to ceil(size / block)
    blocks by a hash, so a hot group becomes many tasks of bounded size.
    """
    parts = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(5)), parts).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", size)


def _together(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _alike(percent: int):
    n_bands, rows_each, least = plan(percent)
    coordinates = n_bands * rows_each

    def run(batches):
        """Edges of a spanning forest of the pairs with enough equal coordinates, for each bucket and pair of blocks."""
        for table, starts in whole_groups(batches, ["key", "i", "j"]):
            rep, own, i, j = (table.column(c).to_numpy() for c in ("rep", "own", "i", "j"))
            flat = np.frombuffer(text_buffer(table.column("sketch"))[0], np.uint16).reshape(-1, coordinates)
            left, right = [], []
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                m, r = flat[s:e], rep[s:e]
                joined = Union(len(m))
                cross = i[s] != j[s]
                mine, theirs = (np.flatnonzero(own[s:e] == i[s]), np.flatnonzero(own[s:e] == j[s])) if cross else (np.arange(len(m)),) * 2
                step = max(1, 4_000_000 // (coordinates * max(1, len(theirs))))
                for a in range(0, len(mine), step):
                    rows = mine[a : a + step]
                    same = (m[rows, None, :] == m[None, theirs, :]).sum(axis=2) >= least
                    if not cross:
                        same &= rows[:, None] < theirs[None, :]
                    for x, y in zip(*np.nonzero(same)):
                        if joined.join(int(rows[x]), int(theirs[y])):
                            left.append(r[rows[x]])
                            right.append(r[theirs[y]])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _with_sets(batches):
    for batch in batches:
        for piece in text_pieces(batch, "text", PIECE):
            values, counts = shingle_sets(*text_buffer(piece.column("text")))
            ends = np.cumsum(counts)
            sets = [values[e - c : e].tobytes() for e, c in zip(ends, counts)]
            keep = ["rep", "key", "size"]
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], blobs(sets)], names=[*keep, "set"])


def _linked(percent: int):
    def run(batches):
        """Edges of a spanning forest of the pairs whose full sets are similar enough, for each cluster and pair of blocks."""
        for table, starts in whole_groups(batches, ["key", "i", "j"]):
            rep, own, i, j = (table.column(c).to_numpy() for c in ("rep", "own", "i", "j"))
            buf, off = text_buffer(table.column("set"))
            values, off = np.frombuffer(buf, U64), off // 8
            left, right = [], []
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                _, ids = np.unique(values[off[s] : off[e]], return_inverse=True)
                at = off[s : e + 1] - off[s]
                size = np.diff(at)
                marked = np.zeros(len(ids) and int(ids.max()) + 1, bool)
                joined = Union(e - s)
                for x in range(e - s - 1):
                    marked[ids[at[x] : at[x + 1]]] = True
                    common = np.add.reduceat(marked[ids[at[x + 1] :]], at[x + 1 : -1] - at[x + 1], dtype=np.int64)
                    marked[ids[at[x] : at[x + 1]]] = False
                    close = 100 * common >= percent * (size[x] + size[x + 1 :] - common)
                    if i[s] != j[s]:
                        close &= own[s + x + 1 : e] != own[s + x]
                    for y in np.flatnonzero(close):
                        if joined.join(x, x + 1 + int(y)):
                            left.append(rep[s + x])
                            right.append(rep[s + x + 1 + y])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z; a text's set has its
    distinct 5-word shingles, or all its words as one when there are fewer. Texts without words are linked with
    nothing. Two texts are linked if 100 * intersection >= percent * union of their full sets; component_id
    is the smallest doc_id reachable by links, and kept says that it is the row's own. Equal sets form one
    class, which is compared once; buckets with the same members are compared once. A row without doc_id takes
    the component of its class, or none, and is kept only if it has none.
    """
    found = written(sketched(docs, percent), "sketches")
    classes = found.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes = written(in_files(classes.filter("rep is not null"), found.count()), "classes")
    placed = classes.select("rep", F.explode("bands").alias("key"))
    buckets = placed.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.min("rep").alias("least")).filter("size > 1")
    buckets = buckets.groupBy("size", "who", "least").agg(F.min("key").alias("key")).select("key", "size")
    members = in_blocks(placed.join(buckets, "key"), "key", "size").join(classes.select("rep", "sketch"), "rep")
    alike = _together(members.select("key", "i", "j", "own", "rep", "sketch"), "key").mapInArrow(lean(_alike(percent)), "a long, b long")
    clusters = components(alike).toDF("rep", "key")
    # the merge join is what large inputs need: clusters grow with the input, so no size of theirs may choose the plan
    sizes = clusters.groupBy("key").agg(F.count("*").alias("size"))
    clusters = clusters.join(sizes, "key")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(clusters.hint("merge"), "rep").mapInArrow(lean(_with_sets), "rep long, key long, size long, set binary")
    links = _together(in_blocks(texts, "key", "size"), "key").mapInArrow(lean(_linked(percent)), "a long, b long")
    groups = components(links).toDF("rep", "component")
    known = classes.select("set_key", "rep").join(groups, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = found.select("doc_id", "n_shingles", "set_key").join(known, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
