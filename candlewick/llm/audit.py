"""Filter interaction audit: what five text filters remove in every order they can be applied in.

Texts are scanned as Arrow buffers: byte classes and prefix sums count words, capitals and symbols of all texts of a
piece at once, and each text's words are sorted by hash and compared, so that equal hashes never pass for equal words.
A document leaves the scan as a mask of the filters it fails, and everything after counts masks.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import EIGHTS, eights, text_buffer, text_pieces, word_bounds, word_hashes

FILTERS = "ABCDE"
#: Fixed thresholds of the filters: fewer words than LEAST_WORDS; a share of distinct words under DISTINCT percent; a
#: share of capitals over CAPITALS percent; any of SYMBOLS.
LEAST_WORDS, DISTINCT, CAPITALS, SYMBOLS = 100, 80, 10, "#$%&*|"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
#: Bytes of text that are looked at together; a longer text is looked at alone and takes some 100 bytes for each byte.
PIECE = 1 << 20
E_BIT = 1 << FILTERS.index("E")


def _equal_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words ``a`` have the bytes of the words ``b``, pair by pair."""
    same = end[a] - start[a] == end[b] - start[b]
    left, right = eights(buf, start[a], end[a]), eights(buf, start[b], end[b])
    for (rows, x), (other, y) in zip(left, right):
        if len(rows) == len(other):
            same[rows] &= x == y
        else:  # pairs of different lengths are unequal already
            both, i, j = np.intersect1d(rows, other, assume_unique=True, return_indices=True)
            same[both] &= x[i] == y[j]
    for k in np.flatnonzero(same & (end[a] - start[a] > EIGHTS)).tolist():
        same[k] = buf[start[a[k]] : end[a[k]]].tobytes() == buf[start[b[k]] : end[b[k]]].tobytes()
    return same


def distinct_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray, hashes=word_hashes) -> np.ndarray:
    """How many distinct words each text has: words sorted by hash in each text, neighbours with one hash compared by bytes."""
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(start):
        return np.zeros(len(counts), np.int64)
    h = hashes(buf, start, end)
    order = np.lexsort((h, doc))
    again = np.flatnonzero((h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1]))
    same = _equal_words(buf, start, end, order[again], order[again + 1])
    new = np.ones(len(order), bool)
    new[again + 1] = False
    out = np.bincount(doc[order[new]], minlength=len(counts))
    for d in np.unique(doc[order[again[~same]]]).tolist():  # two words of this text share a hash
        own = np.flatnonzero(doc == d)
        out[d] = len({buf[start[k] : end[k]].tobytes() for k in own.tolist()})
    return out


def failed_filters(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The mask of filters A to D that each text fails."""
    start, end, words = word_bounds(buf, off)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[off])

    capitals = per_text((buf >= 65) & (buf <= 90))
    points = per_text((buf & 0xC0) != 0x80)
    distinct = distinct_words(buf, start, end, words)
    fails = (words < LEAST_WORDS, 100 * distinct < DISTINCT * words, 100 * capitals > CAPITALS * points, per_text(_SYMBOL[buf]) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of every whole text: the filters A to D it fails, and the SHA-256 that stands for it."""

    def run(batches):
        for batch in batches:
            for piece in text_pieces(batch, "text", PIECE):
                buf, off = text_buffer(piece.column("text"))
                digests = [hashlib.sha256(buf[a:b]).digest() for a, b in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("part"), pa.array(digests, pa.binary()), pa.array(failed_filters(buf, off), pa.int32())], names=["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def counted_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail on their own, E included.

    All texts of one digest fail the same filters but E, which spares the rows with the smallest doc_id. Rows are
    added up before every shuffle, so a text that a third of all rows have is a few rows.
    """
    flag = lambda c: F.max(F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = scanned(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    none = F.lit(False)
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))  # rows without doc_id meet no label and need no common task
    both = rows.withColumn("spread", spread).join(marks.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left").select(*rows.columns, F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    # doc_id, part and digest make a row unique, so the row at the smallest doc_id has all its copies in ``n``
    texts = both.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(order.alias("at"), "n")).alias("first"))
    least = F.min("first.at").over(Window.partitionBy("digest"))  # one row for each part and label
    texts = texts.withColumn("spared", F.when(F.col("first.at") == least, F.col("first.n")).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("mask").alias("fails"), F.col("spared").alias("n")), F.struct((F.col("mask") + E_BIT).alias("fails"), (F.col("n") - F.col("spared")).alias("n"))))
    rows = texts.select("part", "good", "toxic", split.alias("s")).select("part", F.col("s.fails").alias("mask"), F.col("s.n").alias("n"), "good", "toxic")
    with_ = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), with_("good"), with_("toxic"))


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, the filter's bit, bits of the filters before it) of all orders."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append((order, step, bit, before))
            before |= bit
    return out


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each ``lang`` (a null one is the empty string), order of the five filters and step.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns are ignored.
    A null text is empty: it fails A alone, and E where a smaller doc_id has an empty or null text. A null doc_id is larger than all others and has no label; rows
    that share a doc_id have its labels, and neither is the smaller one for E. Of several labels of a document, any
    that is 1 counts. No documents give no rows.
    """
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("before")) for o, s, b, p in _steps()])
    masks = counted_masks(docs, labels)
    rows = masks.select("*", F.explode(steps).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    here = fails & ~earlier
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    counts = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~earlier).alias("kept"), total(here).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))  # one row for each order
    return counts.withColumn("shapley", shapley).drop("bit")
