"""Spelling variant grouping: a trie self-join with active-node sets over the vocabulary of a corpus.

Two words at distance one have equal text on one side of the edit: they share their first half or their last half.
The vocabulary's trie is therefore cut by prefix, and that of the last halves by suffix, into subtries that tasks join
on their own. A subtrie that is still too large is cut again, by half of what its words don't share, until it fits.
Inside a subtrie each node hands its set of active nodes, those at distance one, down to its children.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, spread, text_buffer, text_pieces, whole_groups, written

#: The share of occurrences that lose a character: those whose checksum this number divides.
EDITED = 199
#: Words have at least so many code points and occurrences; a form is at least so many times as frequent as its variant.
LEAST_POINTS, LEAST_COUNT, RATIO = 6, 5, 5
#: Bytes of text whose words are counted before they move; a longer text is counted alone and takes some 60 bytes for each byte.
PIECE = 4 << 20
#: Code points that the words of one subtrie may have beside what they share.
SUBTRIE = 1 << 17
#: Runs up to this many bytes have their checksums computed together.
TOGETHER = 64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # U+00C0 to U+00FF are 0xC3 and one more byte


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def checksums(buf: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of bytes, going on from that of what stands before it."""
    state, size, rows = ~before.astype(np.uint32), end - start, np.arange(len(start))
    for k in range(TOGETHER):
        rows = rows[size[rows] > k]
        if not len(rows):
            break
        s = state[rows]
        state[rows] = _CRC[(s ^ buf[start[rows] + k]) & 255] ^ s >> 8
    for r in np.flatnonzero(size > TOGETHER).tolist():
        state[r] = ~np.uint32(zlib.crc32(buf[start[r] : end[r]].tobytes(), int(before[r])))
    return ~state


def edited_words(buf: np.ndarray, off: np.ndarray, doc_ids: list[int | None], least: int = LEAST_POINTS) -> pa.Array:
    """The lower-cased runs of letters of every text that have ``least`` code points, after EDITED took one from some."""
    buf = LOWER[buf]
    solid = np.zeros(len(buf) + 2, bool)
    solid[1:-1] = _LETTER[buf]
    solid[2:-1] |= buf[:-1] == 0xC3
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    start = np.flatnonzero(solid[1:] & (~solid[:-1] | cut))
    end = np.flatnonzero(solid[:-1] & (~solid[1:] | cut))
    leads = np.flatnonzero((buf & 0xC0) != 0x80)
    first = np.searchsorted(leads, start)
    points = np.searchsorted(leads, end) - first
    some = points >= least
    start, end, first, points = start[some], end[some], first[some], points[some]
    doc = np.searchsorted(off, start, "right") - 1
    heads = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in doc_ids], np.uint32)
    h = checksums(buf, start, end, heads[doc]) if len(start) else np.zeros(0, np.uint32)
    gone = np.zeros(len(buf), bool)
    hit = np.flatnonzero(h % EDITED == 0)
    at = leads[first[hit] + h[hit] % points[hit]]
    gone[at] = True
    gone[at[buf[at] == 0xC3] + 1] = True
    points[hit] -= 1
    bytes_ = spread(start, end - start)
    stay = ~gone[bytes_]
    ends = np.cumsum(end - start)
    offsets = np.concatenate(([0], np.concatenate(([0], np.cumsum(stay)))[ends]))
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(buf[bytes_[stay]].tobytes())])
    return words.filter(pa.array(points >= least))


def vocabulary(docs: DataFrame, least: int = LEAST_POINTS, often: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all whole texts that occur ``often`` times; each piece of text counts its own first."""

    def run(batches):
        for batch in batches:
            for piece in text_pieces(batch, "text", PIECE):
                words = edited_words(*text_buffer(piece.column("text")), piece.column("doc_id").to_pylist(), least)
                found = pc.value_counts(words)
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def near_pairs(words: list[str]):
    """Index pairs of words that one inserted, deleted or replaced code point makes equal.

    A trie node comes with its active nodes: its parent, which lacks its last character, the siblings before it,
    which have another one, and the same child of each of its parent's active nodes.
    """
    children: list[dict[str, int]] = [{}]
    word_at = [-1]
    for k, word in enumerate(words):
        node = 0
        for c in word:
            after = children[node].get(c)
            if after is None:
                after = children[node][c] = len(children)
                children.append({})
                word_at.append(-1)
            node = after
        word_at[node] = k
    found = set()  # "aa" and "aaa" meet at several nodes
    stack = [(0, [])]
    while stack:
        node, active = stack.pop()
        own = word_at[node]
        if own >= 0:
            found.update((own, word_at[y]) if own < word_at[y] else (word_at[y], own) for y in active if word_at[y] >= 0)
        siblings = []
        for c, child in children[node].items():
            stack.append((child, [children[y][c] for y in active if c in children[y]] + [node] + siblings))
            siblings = [*siblings, child]
    return found


def _keyed(rows: DataFrame) -> DataFrame:
    """Words that share their first ``a`` and last ``b`` code points, for pairs whose shorter word has ``m``, share a key."""
    shared = F.concat_ws(" ", "m", "a", "b", F.expr("left(word, a)"), F.expr("right(word, b)"))
    return rows.withColumn("key", F.sha2(shared, 256))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: its group is cut by the first and by the last half of what the shorter words don't share.

    An edit that isn't in the first half leaves it equal, and one that isn't in the last half leaves that equal.
    """
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    sides = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b")), F.struct(F.col("a"), (F.col("m") - F.col("a") - half).alias("b")))
    return _keyed(rows.select("word", "n", "m", F.explode(sides).alias("s")).select("word", "n", "m", "s.a", "s.b"))


def _subtries(words: DataFrame, subtrie: int) -> DataFrame:
    """(key, m, a, b, word, n): every word in the subtries in which its pairs are found.

    What one subtrie's words don't share has ``subtrie`` code points at most, or is down to one code point in the shorter words,
    of which there are only so many.
    """
    length = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).filter("m > 0")
    rows = _halved(whole.select("*", F.lit(0).alias("a"), F.lit(0).alias("b")))
    done = None
    while True:
        rest = (F.length("word") - F.col("a") - F.col("b")).cast("long")
        crowded = rows.filter("m - a - b > 1").groupBy("key").agg(F.sum(rest).alias("points")).filter(F.col("points") > subtrie).select("key")
        crowded = written(crowded, "crowded")
        if crowded.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(crowded, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = written(_halved(rows.join(crowded, "key", "left_semi")), "halved")


def word_pairs(words: DataFrame, subtrie: int = SUBTRIE) -> DataFrame:
    """(a, n_a, b, n_b): each pair of the distinct words of ``words`` (word, n) at distance one, once."""

    def run(batches):
        for table, starts in whole_groups(batches, ["key"]):
            word, n = table.column("word").to_pylist(), table.column("n").to_pylist()
            shape = zip(*(table.column(c).to_numpy()[starts].tolist() for c in ("m", "a", "b")))
            out = []
            for s, e, (m, a, b) in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], shape):
                if e - s > 1:
                    for i, j in near_pairs([w[a : len(w) - b] for w in word[s:e]]):
                        u, v = sorted((s + i, s + j), key=word.__getitem__)
                        if len(word[u]) == m or len(word[v]) == m:
                            out.append((word[u], n[u], word[v], n[v]))
            names = ["a", "n_a", "b", "n_b"]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(list(zip(*out)) or [[]] * 4, [pa.string(), pa.int64()] * 2)], names=names)

    rows = _subtries(words, subtrie)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "a string, n_a long, b string, n_b long").dropDuplicates(["a", "b"])


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: forms of forms, found by doubling the step until none is left."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = written(roots.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        roots = after.drop("moved")
        if after.filter("moved").isEmpty():
            return roots


def variant_groups(docs: DataFrame, least: int = LEAST_POINTS, often: int = LEAST_COUNT, ratio: int = RATIO, subtrie: int = SUBTRIE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text) with ``least`` code points and ``often`` occurrences.

    A null text has no words, a null doc_id counts as an empty one in checksums, and rows that repeat a doc_id count
    each. Of several near words with the largest n the smallest one in code-point order is the form. Forms are at least ``ratio``
    times as frequent, so they form no circles (``ratio`` must be over 1). No words give no rows.
    """
    words = written(vocabulary(docs, least, often), "vocabulary")
    pairs = written(word_pairs(words, subtrie), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = -F.col("best.less")
    forms = words.join(best, "word", "left").withColumn("is_form", F.coalesce(near >= ratio * F.col("n"), F.lit(False)))
    forms = forms.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is_form"), F.col("best.near")).alias("form"), F.when(F.col("is_form"), near).alias("form_n"))
    forms = written(forms, "forms")
    return forms.join(_roots(forms.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
