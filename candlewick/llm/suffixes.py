"""Suffix-array removal of byte strings that an earlier document has.

The suffixes are those at anchors, places that any long enough string picks by its own content, so that equal
strings pick the same ones. Sampled splitters deal the suffixes to buckets by their leading bytes; buckets order them
by multikey quicksort and read repeats off the common prefixes of neighbours. Suffixes with equal leading bytes share a
bucket, so neighbours on two sides of a boundary never have a string in common and nothing is left to compare across it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from . import blocks
from .blocks import Block
from .common import U64, Rolling, blobs, lean, mix, seeded, whole_groups

LENGTH, GRAM = 50, 16
#: A string of LENGTH bytes holds this many grams; the least hash among them is its anchor.
WINDOW = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
PIECE = 1 << 19
#: Bytes that strings around a hot gram have before it at most, to be dealt by the suffix at the gram; the others by that HALF + 1 bytes before it.
HALF = LEFT // 2
#: Least number of suffixes in the sample, how many there are for each range of leading bytes, and the most that the driver takes (84 bytes each).
SAMPLE, EACH, MOST_SAMPLE = 65_536, 64, 1 << 20
#: A gram that so many blocks hold is hot, too, however rare it is in the sample.
HOT_BLOCKS = 4096
#: A gram is hot from this share of an average bucket's suffixes in the sample, and this number.
HOT, HOT_LEAST = 0.5, 32
#: Bytes of text for each part of the first pass and each bucket.
PART_BYTES = 4 << 20
#: Suffixes that are built at a time.
ROWS = 1 << 16


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _picked(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the least gram of each window of LENGTH bytes whose start is ``inside``, and the grams' hashes."""
    h = Rolling(seeded(256, 1)[buf], 5).windows(GRAM)
    top = (h >> U64(32)).astype(np.uint32)
    np.maximum(top, 1, out=top)
    least = _slide(top, WINDOW, np.minimum)  # of the window that starts here
    least[~inside] = 0
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), least, np.zeros(WINDOW - 1, np.uint32)])
    at = np.flatnonzero(_slide(padded, WINDOW, np.maximum) == top)
    return at, mix(h[at])


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that are the least gram of some LENGTH bytes within one text, in order, and the grams' hashes; PIECE windows at a time."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    long_ = np.diff(off) >= LENGTH
    first, last = off[:-1][long_], off[1:][long_] - LENGTH  # the first and last window of each text
    windows = max(len(buf) - LENGTH + 1, 0)
    for a in range(0, windows, PIECE):
        b = min(a + PIECE, windows)
        own = slice(int(np.searchsorted(last, a)), int(np.searchsorted(first, b)))
        if own.start < own.stop:
            change = np.zeros(b - a + 1, np.int32)
            change[np.maximum(first[own], a) - a] += 1
            np.subtract.at(change, np.minimum(last[own], b - 1) - a + 1, 1)
            at, h = _picked(buf[a : b + LENGTH - 1], np.cumsum(change[:-1]) > 0)
            places.append(at + a)
            hashes.append(h)
    found, h = np.concatenate(places), np.concatenate(hashes)
    if len(places) > 2:  # windows on both sides of a cut may pick one place
        found, at = np.unique(found, return_index=True)
        h = h[at]
    return found, h


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U64(32)) % U64(parts)).astype(np.int64)


def _grams(block: Block):
    """Anchors' places, the number of each one's gram, the distinct grams' hashes, and which of these occur in more than one text of the block."""
    places, h = anchors(block.buf, block.off)
    row = (np.searchsorted(block.off, places, "right") - 1).astype(np.int32)
    grams, first, number = np.unique(h, return_index=True, return_inverse=True)
    several = np.zeros(len(grams), bool)
    several[number[row != row[first][number]]] = True
    return places, number, grams, several


def _marks(parts: int):
    def run(batches):
        for block in blocks.cut(batches):
            _, _, h, _ = _grams(block)
            found = list(blocks.shared_marks(_part(h, parts), (h & U64(0xFFFFFFFF)).astype(np.uint32), parts))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([block.name] * len(found), pa.int64()), blobs([k.tobytes() for _, k in found])], names=["part", "block", "data"])

    return run


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 64-bit words, which compare as the bytes do."""
    wide = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), wide), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(U64)


def multikey_quicksort(words: np.ndarray, small: int = 1024) -> np.ndarray:
    """The order of rows of words: three-way partitions by one word at a time, where equal rows go on to the next word."""
    out, depth_limit = [], words.shape[1]
    todo = [(np.arange(len(words)), 0)]
    while todo:
        rows, depth = todo.pop()
        if depth == depth_limit or len(rows) < 2:
            out.append(rows)
        elif len(rows) <= small:
            out.append(rows[np.lexsort(words[rows, depth:].T[::-1])])
        else:
            key = words[rows, depth]
            pivot = np.sort(key[:: max(1, len(key) // 63)])[32 if len(key) >= 63 else len(key) // 2]
            todo.append((rows[key > pivot], depth))
            todo.append((rows[key == pivot], depth + 1))
            todo.append((rows[key < pivot], depth))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the one before it."""
    differ = rows[1:] != rows[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


class Suffixes:
    """Suffixes at anchors: LENGTH bytes from the anchor, LEFT bytes before it in reverse, how many of both the text has.

    ``reach`` tells how much further the last one of a series of anchors is that lie close together in one text and
    all have the same bytes around them, as in text with a short period.
    """

    FIELDS = (("right", np.uint8, LENGTH), ("left", np.uint8, LEFT), ("n_right", np.uint8, 1), ("n_left", np.uint8, 1), ("place", np.uint32, 1), ("reach", np.uint32, 1), ("doc", np.int64, 1))

    def __init__(self, **fields):
        self.__dict__.update(fields)

    def __len__(self):
        return len(self.doc)

    @staticmethod
    def joined(many: list[Suffixes]) -> Suffixes:
        return Suffixes(**{name: np.concatenate([getattr(s, name) for s in many]) for name, _, _ in Suffixes.FIELDS})

    @staticmethod
    def at(block: Block, places: np.ndarray) -> Suffixes:
        """ROWS anchors at a time, so that text with a short period costs no more memory than other text."""
        padded = np.concatenate([np.zeros(LEFT, np.uint8), block.buf, np.zeros(LENGTH, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, LEFT + LENGTH)
        parts = []
        for a in range(0, max(len(places), 1), ROWS):
            own = places[a : a + ROWS]
            row = np.searchsorted(block.off, own, "right") - 1
            n_right = np.minimum(block.off[row + 1] - own, LENGTH)
            n_left = np.minimum(own - block.off[row], LEFT)
            around = view[own]
            right, left = around[:, LEFT:].copy(), around[:, LEFT - 1 :: -1].copy()
            right[np.arange(LENGTH) >= n_right[:, None]] = 0
            left[np.arange(LEFT) >= n_left[:, None]] = 0
            head = np.ones(len(own), bool)
            head[1:] = (row[1:] != row[:-1]) | (own[1:] - own[:-1] > LENGTH) | (n_right[1:] != n_right[:-1]) | (n_left[1:] != n_left[:-1]) | (right[1:] != right[:-1]).any(axis=1) | (left[1:] != left[:-1]).any(axis=1)
            at = np.flatnonzero(head)
            last = np.append(at[1:], len(own)) - 1
            parts.append(Suffixes(right=right[at], left=left[at], n_right=n_right[at].astype(np.uint8), n_left=n_left[at].astype(np.uint8), place=own[at].astype(np.uint32), reach=(own[last] - own[at]).astype(np.uint32), doc=block.doc[row[at]]))
        return Suffixes.joined(parts)

    def take(self, rows) -> Suffixes:
        return Suffixes(**{name: getattr(self, name)[rows] for name, _, _ in self.FIELDS})

    def later(self) -> np.ndarray:
        """Which suffixes have all their bytes around the anchor, too, in a smaller document of these."""
        words = [*words_of(self.right).T, *words_of(self.left).T, self.n_right.astype(U64) << U64(8) | self.n_left]
        h = np.zeros(len(self), U64)
        for w in words:
            h = mix(h * U64(31) + w)
        _, first, number = np.unique(h, return_index=True, return_inverse=True)
        same = first[number]  # compared byte by byte: a suffix that only shares the hash stays
        equal = (self.right == self.right[same]).all(axis=1) & (self.left == self.left[same]).all(axis=1) & (self.n_right == self.n_right[same]) & (self.n_left == self.n_left[same])
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, number[equal], self.doc[equal])
        return equal & (self.doc > least[number])

    def pack(self) -> bytes:
        return zstandard.compress(len(self).to_bytes(8, "little") + b"".join(np.ascontiguousarray(getattr(self, name)).tobytes() for name, _, _ in self.FIELDS), 1)

    @staticmethod
    def unpack(many: list[bytes]) -> tuple[Suffixes, np.ndarray]:
        parts = []
        for data in many:
            raw = zstandard.decompress(data)
            n, at, fields = int.from_bytes(raw[:8], "little"), 8, {}
            for name, kind, wide in Suffixes.FIELDS:
                x = np.frombuffer(raw, kind, n * wide, at)
                at += n * wide * np.dtype(kind).itemsize
                fields[name] = x.reshape(n, wide) if wide > 1 else x
            parts.append(Suffixes(**fields))
        return Suffixes.joined(parts), np.array([len(p) for p in parts])


def earlier_repeats(s: Suffixes, low: int = 0, high: int = LEFT) -> np.ndarray:
    """For each suffix and o = ``low`` .. ``high``: whether the LENGTH bytes that begin o bytes before the anchor also occur, around an equal anchor, in a smaller document.

    The order of the suffixes and that of the reversed left sides, with common prefixes of neighbours, name the
    classes of equal right and left sides of every length; a string is a pair of classes.
    """
    n = len(s)
    flags = np.zeros((n, LEFT + 1), bool)
    if n < 2:
        return flags
    order = multikey_quicksort(words_of(s.right))
    common = np.concatenate(([0], _common(s.right[order])))
    left_order = multikey_quicksort(words_of(s.left))
    left_common = np.concatenate(([0], _common(s.left[left_order])))
    n_right, n_left, doc = s.n_right.astype(np.int64), s.n_left.astype(np.int64), s.doc
    for o in range(low, high + 1):
        size = LENGTH - o
        again = common >= size
        shared = again.copy()
        shared[:-1] |= again[1:]
        in_order = order[shared]
        ok = (n_right[in_order] >= size) & (n_left[in_order] >= o)
        right_class = np.cumsum(~again)[shared][ok]
        rows = in_order[ok]
        if len(rows) < 2:
            continue
        left_class = np.empty(n, np.int64)
        left_class[left_order] = np.cumsum(left_common < o)
        key = (right_class << 32) | left_class[rows]
        by = np.argsort(key, kind="stable")
        ordered = key[by]
        at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        least = np.minimum.reduceat(doc[rows[by]], at)
        flags[rows[by], o] = doc[rows[by]] > np.repeat(least, np.diff(np.append(at, len(by))))
    return flags


def _spans(start: np.ndarray, end: np.ndarray) -> bytes:
    return zstandard.compress(np.concatenate([start, end - start]).astype(np.uint32).tobytes(), 1)


def _answers(flags: np.ndarray, s: Suffixes, origin: np.ndarray):
    """(origin, packed starts and sizes) of the runs of repeated strings around each suffix."""
    padded = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    change = np.diff(padded, axis=1)
    row, low = np.nonzero(change == 1)
    _, high = np.nonzero(change == -1)  # low .. high - 1 are the o of one run, so strings start at place - high + 1 .. place - low
    start = s.place[row].astype(np.int64) - high + 1
    end = s.place[row].astype(np.int64) + s.reach[row] - low + LENGTH
    order = np.argsort(origin[row], kind="stable")
    start, end, own = start[order], end[order], origin[row][order]
    at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else []
    for a, b in zip(at, [*at[1:], len(own)]):
        yield int(own[a]), _spans(start[a:b], end[a:b])


class Buckets:
    """Which bucket a suffix goes to, by sampled splitters of its leading bytes.

    The sample is bounded, so ranges of leading bytes are, too; where more buckets are wanted, each range is cut by a hash of
    those bytes, which keeps suffixes with equal ones together. A gram that alone fills much of a bucket is hot. Strings with up to
    HALF bytes before it hold the LENGTH - HALF bytes from it on, and the others the HALF + 1 bytes before it and itself; such
    suffixes go to two buckets, each by those bytes and for those strings.
    """

    def __init__(self, around: np.ndarray, parts: int):
        """``around``: LEFT bytes before and LENGTH bytes from each anchor of the sample, in text order."""
        gram = self._key(around, LEFT, GRAM)
        names, of, counts = np.unique(gram, return_inverse=True, return_counts=True)
        hot = counts >= max(HOT_LEAST, HOT * len(around) / parts)
        self.hot, is_hot = names[hot], hot[of] if len(of) else np.zeros(0, bool)
        ranges = min(parts, max(1, MOST_SAMPLE // EACH))
        self.cuts = -(-parts // ranges)
        pick = lambda x: np.unique(np.sort(x)[np.linspace(0, len(x) - 1, min(ranges, len(x)) + 1).astype(int)[1:-1]]) if len(x) > 2 else x[:0]
        self.splitters = [pick(gram[~is_hot]), pick(self._long(around[is_hot])), pick(self._wide(around[is_hot]))]
        self.first = np.cumsum([0, *[len(x) + 1 for x in self.splitters]])

    @staticmethod
    def _key(around: np.ndarray, start: int, size: int) -> np.ndarray:
        return np.ascontiguousarray(around[:, start : start + size]).view(f"S{size}").reshape(-1)

    def _long(self, around: np.ndarray) -> np.ndarray:
        return self._key(around, LEFT, LENGTH - HALF)

    def _wide(self, around: np.ndarray) -> np.ndarray:
        return self._key(around, LEFT - HALF - 1, HALF + 1 + GRAM)

    def deal(self, s: Suffixes, more_hot: np.ndarray):
        """(bucket, suffixes) of every bucket that gets any; ``more_hot`` are grams that are hot beside those of the sample."""
        around = np.concatenate([s.left[:, ::-1], s.right], axis=1)
        gram = self._key(around, LEFT, GRAM)
        hot = np.isin(gram, self.hot) | np.isin(gram, more_hot)
        for kind, rows, key in ((0, ~hot, lambda x: self._key(x, LEFT, GRAM)), (1, hot, self._long), (2, hot & (s.n_left > HALF), self._wide)):
            at = np.flatnonzero(rows)
            keys = key(around[at])
            bucket = np.searchsorted(self.splitters[kind], keys, "right") + self.first[kind]
            if self.cuts > 1:
                bucket = bucket * self.cuts + self._cut(keys)
            order = np.argsort(bucket, kind="stable")
            at, bucket = at[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(at) else []
            for a, b in zip(cuts, [*cuts[1:], len(at)]):
                yield int(bucket[a]), s.take(at[a:b])

    def _cut(self, keys: np.ndarray) -> np.ndarray:
        h = np.zeros(len(keys), U64)
        for w in words_of(keys.view(np.uint8).reshape(len(keys), -1)).T if len(keys) else ():
            h = mix(h * U64(31) + w)
        return (h % U64(self.cuts)).astype(np.int64)

    def strings(self, bucket: int) -> tuple[int, int]:
        """The least and the largest number of bytes before the anchor, of the strings that this bucket decides."""
        range_ = bucket // self.cuts
        return (0, LEFT) if range_ < self.first[1] else (0, HALF) if range_ < self.first[2] else (HALF + 1, LEFT)


def _dealt(buckets: Buckets, parts: int):
    def work(block: Block, got: dict[int, list[bytes]]):
        places, number, h, several = _grams(block)
        again, hot = blocks.marked(_part(h, parts), parts, got)
        more_hot = Suffixes.at(block, places[hot[number]]).right[:, :GRAM] if hot.any() else np.zeros((0, GRAM), np.uint8)
        more_hot = np.unique(np.ascontiguousarray(more_hot).view(f"S{GRAM}").reshape(-1))
        places = places[(again | several)[number]]
        rows: list[tuple[int, bytes]] = []
        if len(places):
            s = Suffixes.at(block, places)
            later = s.later()  # decided inside the block: however common a string is, the block sends it once
            t = s.take(later)
            if len(t):
                place = t.place.astype(np.int64)
                rows.append((-2 - abs(block.name) % parts, _spans(place - t.n_left, place + t.reach + t.n_right)))
            rows += [(b, t.pack()) for b, t in buckets.deal(s.take(~later), more_hot)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block.name] * len(rows), pa.int64()), blobs([r[1] for r in rows])], names=["bucket", "block", "data"])

    return work


def _sorted_buckets(buckets: Buckets):
    def run(batches):
        for table, starts in whole_groups(batches, ["bucket"]):
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                group = table.slice(s, e - s)
                bucket, name = group.column("bucket")[0].as_py(), group.column("block").to_pylist()
                data = group.column("data").to_pylist()
                if bucket >= 0:
                    suffixes, sizes = Suffixes.unpack(data)
                    data = dict(_answers(earlier_repeats(suffixes, *buckets.strings(bucket)), suffixes, np.repeat(np.arange(len(sizes)), sizes)))
                else:
                    data = dict(enumerate(data))
                yield pa.RecordBatch.from_arrays([pa.array([name[k] for k in data], pa.int64()), pa.array([max(bucket, 0)] * len(data), pa.int32()), blobs(list(data.values()))], names=["block", "part", "data"])

    return run


def _sample(docs: DataFrame, size: int, parts: int) -> np.ndarray:
    """The bytes around a bounded sample of anchors: EACH for each bucket, SAMPLE at least and some MOST_SAMPLE at most, from all documents alike."""
    want = min(max(SAMPLE, EACH * parts), max(MOST_SAMPLE, 1))
    per_byte = min(1.0, 2 * want * WINDOW / 4 / max(size, 1))  # a text has some 2 / (WINDOW + 1) anchors for each byte
    share = min(1.0, 8 * per_byte)
    least = U64(int((1 - per_byte / share) * (2**64 - 1)) if per_byte < share else 0)

    def run(batches):
        for block in blocks.cut(batches):
            places, h = anchors(block.buf, block.off)
            s = Suffixes.at(block, places[mix(h ^ U64(99) + places.astype(U64)) >= least])
            yield pa.RecordBatch.from_arrays([blobs([np.concatenate([s.left[:, ::-1], s.right], axis=1).tobytes()])], names=["around"])

    got = blocks.plain(docs).sample(share, 1).mapInArrow(lean(run), "around binary").collect()
    return np.frombuffer(b"".join(r["around"] for r in got), np.uint8).reshape(-1, LEFT + LENGTH)


def repeated_bytes(docs: DataFrame, finish, schema, keep: tuple[str, ...] = ()) -> DataFrame:
    """Find each byte covered by a LENGTH-byte string that also starts in a document with a smaller doc_id.

    1. All documents: 32-bit marks of the grams at anchors, dealt by hash; a bit comes back for each mark that occurs again.
    2. The suffixes at anchors whose gram occurs again go to the bucket that sampled splitters of leading bytes
       name. A block decides what it holds of one string itself and sends the smallest document only; suffixes of hot grams
       are split by longer stretches.
    3. Buckets sort by multikey quicksort, and every run of strings with a smaller document comes back to its block.
    ``finish(block, gone)`` makes the output from a block and the bytes to remove.

    Buckets and parts follow the bytes of the text, PART_BYTES each, and MOST_TASKS tasks at most take them one after the other. What the driver and
    every task hold of the sample is bounded. A text longer than a block is a block of its own, of which a task holds some 60 bytes for each byte.
    """
    docs = blocks.stable(docs)
    size = blocks.text_bytes(docs)
    parts = max(16, -(-size // PART_BYTES))
    spread_ = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = Buckets(_sample(docs, size, parts), parts)
    marks = blocks.plain(docs).mapInArrow(lean(_marks(parts)), "part int, block long, data binary")
    again = blocks.repeated(marks, spread_, HOT_BLOCKS)
    suffixes = blocks.with_answers(docs, again, spread_, _dealt(buckets, parts), "bucket int, block long, data binary")
    found = suffixes.repartition(blocks.tasks(spread_), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_sorted_buckets(buckets)), blocks.SCHEMA)

    def work(block: Block, got: dict[int, list[bytes]]):
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for data in {d for many in got.values() for d in many}:
            x = np.frombuffer(zstandard.decompress(data), np.uint32).astype(np.int64).reshape(2, -1)
            starts.append(x[0])
            ends.append(x[0] + x[1])
        yield finish(block, blocks.covered(len(block.buf), np.concatenate(starts), np.concatenate(ends)))

    return blocks.with_answers(docs, found, spread_, work, schema, keep)


def _doc_ids(block: Block) -> pa.Array:
    return pa.array(block.doc, pa.int64(), mask=block.doc == blocks.NO_DOC)


def _digest(block: Block, gone: np.ndarray) -> pa.RecordBatch:
    sizes = np.diff(block.off)
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    first = block.off[:-1][sizes > 0]
    begins[first] = gone[first]
    sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[block.off])
    kept, at = block.buf[~gone].tobytes(), np.concatenate(([0], np.cumsum(~gone)))[block.off]
    digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
    return pa.RecordBatch.from_arrays([_doc_ids(block), pa.array(sizes, pa.int64()), pa.array(sums(gone), pa.int64()), pa.array(sums(begins), pa.int64()), pa.array(digests)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(names: list[str]):
    def finish(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        kept, at = block.buf[~gone].tobytes(), np.concatenate(([0], np.cumsum(~gone)))[block.off]
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[block.off])
        texts = [kept[a:b].decode("utf-8", errors="ignore") for a, b in zip(at[:-1], at[1:])]
        have = {"doc_id": _doc_ids(block), "n_removed": pa.array(removed, pa.int64()), "text": pa.array(texts, pa.string())}
        rest = block.columns() if block.rest else pa.table({})
        return pa.RecordBatch.from_arrays([have[c] if c in have else rest.column(c).combine_chunks() for c in names], names=names)

    return finish


def repeat_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs`` (doc_id, text; a null text is empty).

    Rows with one doc_id count as one document: neither is earlier. A null doc_id counts as the largest.
    """
    return repeated_bytes(docs, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the remaining bytes as ``text``, other columns unchanged, and ``n_removed`` (bytes).

    A character that lost only some of its bytes goes as well. A text of which nothing is left, or that was
    null, is empty.
    """
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_removed"))
    schema = blocks.plain(docs, keep).schema
    kinds = {f.name.removeprefix("__"): f.dataType for f in schema}
    names = [c for c in docs.columns if c != "n_removed"] + ["n_removed"]
    out = StructType([StructField(c, LongType() if c == "n_removed" else kinds[c]) for c in names])
    return repeated_bytes(docs, _texts(names), out, keep)
