"""Removal of word windows that occur earlier, found by recompression.

Each round collapses runs of equal symbols and then pairs of neighbours, one from each half of the alphabet. A round is a
Spark exchange: what the blocks of documents found goes to the part that a hash of it names, which compares the
contents themselves, numbers those that occur twice or more anywhere, and sends the numbers back. So names are
the same in all tasks and stand for one content each, and equal stretches of words get equal symbols but for
the edges, where the surroundings take part. A window whose inner symbols have one that occurs only once can't repeat and
leaves; what is left shares high symbols with another place, which reveal where equal windows are, and the words decide.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import Block
from .common import EIGHTS, U64, Rolling, blobs, deleted, eights, mix, seeded, spread, text_buffer, whole_groups, word_bounds, word_hashes, written

WINDOW = 20
#: Bytes of text for each part of the exchanges of windows, and of those of names.
PART_BYTES, NAME_BYTES = 4 << 20, 8 << 20
#: Rounds after which something is wrong: a round leaves at most WINDOW - 2 symbols of a window, and fewer each time.
MOST_ROUNDS = WINDOW
#: A name is the round's number above this bit, and a number within the round below.
ROUND_BIT = 48
_TABLE = "kind string, block long, part int, data binary"


# ---------------------------------------------------------------- one round


@dataclass
class Zones:
    """Symbols of stretches of words, the word where each begins, whether it begins a stretch; and series of windows: first word of the
    first one, how many there are, one word apart, and the symbols low .. high - 1 that each of them alone decides."""

    symbol: np.ndarray
    at: np.ndarray
    edge: np.ndarray
    begin: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def without(self, unique: np.ndarray) -> Zones:
        """Windows without unique symbols, and the symbols that these need."""
        sums = np.concatenate(([0], np.cumsum(unique)))
        ok = sums[self.high] == sums[self.low]
        return self.cut(self.begin[ok], self.n[ok], self.low[ok], self.high[ok])

    def cut(self, begin: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> Zones:
        """Other windows, those that follow each other with the same symbols as one series, and the symbols that they need."""
        if len(begin):
            new = np.ones(len(begin), bool)
            new[1:] = (begin[1:] != begin[:-1] + n[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            at = np.flatnonzero(new)
            begin, n, low, high = begin[at], np.add.reduceat(n, at), low[at], high[at]
        needed = blocks.covered(len(self.symbol), low, high)
        edge = self.edge.copy()
        edge[1:] |= ~needed[:-1]
        number = np.cumsum(needed) - 1
        return Zones(self.symbol[needed], self.at[needed], edge[needed], begin, n, number[low] if len(low) else low, number[high - 1] + 1 if len(high) else high)


@dataclass
class Nodes:
    """What a round makes of the symbols: one run or a pair of runs each, as (symbol, length) once or twice; ``zones`` has places for symbols yet to be named."""

    s1: np.ndarray
    l1: np.ndarray
    s2: np.ndarray
    l2: np.ndarray
    key: np.ndarray
    zones: Zones


def shrunk(z: Zones, key: np.ndarray, level: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Nodes]:
    """(first word, number, word of a symbol, the symbol's index) of windows that end here, and the nodes of the others.

    ``key`` is a hash of what each symbol stands for; it decides halves of the alphabet and goes on into the nodes' keys. A round
    may join the run at either edge of a window with what lies outside, so both edge runs drop out; so does a left edge of the right
    half or a right edge of the left half, which may pair with an outside neighbour. A window of which nothing would be left ends
    with the symbols it has, and takes the least of them by hash.
    """
    size = len(z.symbol)
    new = z.edge.copy()
    new[1:] |= z.symbol[1:] != z.symbol[:-1]
    run_at = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    length = np.diff(np.append(run_at, size))
    runs = z.symbol[run_at]
    hashes = mix(key[run_at] * U64(3) + length.astype(U64))
    edge = z.edge[run_at]
    right = (mix(hashes ^ seeded(1, 100 + level)[0]) >> U64(63)).astype(bool)
    pair = np.zeros(len(runs), bool)
    pair[:-1] = ~right[:-1] & right[1:] & ~edge[1:]
    head = np.ones(len(runs), bool)
    head[1:] = ~pair[:-1]
    node = np.cumsum(head) - 1

    low, high = run[z.low] + 1, run[z.high - 1]
    open_ = low < high
    low += right[np.minimum(low, len(runs) - 1)] if len(runs) else 0
    high -= ~right[high - 1]
    open_ &= low < high
    closed = ~open_
    a, b = z.low[closed], z.high[closed]
    zone = np.ones(len(a), bool)
    zone[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[zone], b[zone]
    best = a.copy()
    for k in range(1, int((b - a).max(initial=0))):
        at = np.minimum(a + k, b - 1)
        best = np.where(key[at] < key[best], at, best)
    pick = best[np.cumsum(zone) - 1] if len(zone) else best
    done = z.begin[closed], z.n[closed], z.at[pick], pick

    heads = np.flatnonzero(head)
    low, high = node[low[open_]], node[high[open_] - 1] + 1
    own = z.begin[open_], z.n[open_], low, high
    zones = Zones(heads, z.at[run_at[heads]], edge[heads], *own).cut(*own)
    first = zones.symbol
    paired = pair[first]
    second = np.minimum(first + 1, len(runs) - 1)
    s2, l2 = np.where(paired, runs[second], 0), np.where(paired, length[second], 0)
    single = (length[first] == 1) & ~paired
    names = np.where(single, key[run_at[first]], mix(hashes[first] * U64(5) + np.where(paired, hashes[second], U64(0)) + U64(1)))
    return done, Nodes(runs[first], length[first], s2, l2, names, zones)


def _first_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first place of each distinct value, the number of each value), in order of appearance."""
    number = pd.factorize(key)[0]
    most = np.maximum.accumulate(number) if len(number) else number
    new = np.ones(len(number), bool)
    new[1:] = most[1:] > most[:-1]
    return np.flatnonzero(new), number


def distinct_rows(key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(one row of each distinct content, the number of each row's content); equal keys are compared as contents."""
    first, number = _first_of(key)
    if not all(np.array_equal(c, c[first][number]) for c in columns):
        _, first, number = np.unique(np.stack(columns, 1), axis=0, return_index=True, return_inverse=True)
    return first, number.reshape(-1)


def exact_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one occurrence of each distinct word, the number of each word); equal hashes are compared as bytes."""
    first, number = _first_of(h)
    size = end - start
    rep = first[number]
    same = np.array_equal(size, size[rep])
    if same:
        again = np.flatnonzero(rep != np.arange(len(rep)))
        here, there = (eights(buf, start[x], end[x]) for x in (again, rep[again]))
        same = all(np.array_equal(x, y) for (_, x), (_, y) in zip(here, there))
        same = same and all(np.array_equal(buf[start[k] : end[k]], buf[start[rep[k]] : end[rep[k]]]) for k in again[size[again] > EIGHTS].tolist())
    if not same:
        raw = buf.tobytes()
        _, first, number = np.unique(np.array([raw[a:b] for a, b in zip(start, end)], object), return_index=True, return_inverse=True)
    return first, number.reshape(-1)


def window_marks(words: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within one text, the number of each window's mark, and the marks: the rounds inside one task, with
    hashes for names. A mark is the symbol that the window ends with."""
    z = _windows(words, counts, window)
    begin, marks, where = z.begin, [], []
    key = words
    for level in range(1, MOST_ROUNDS + 1):
        (own, n, _, pick), nodes = shrunk(z, key, level)
        marks.append(np.repeat(key[pick], n))
        where.append(np.searchsorted(begin, spread(own, n)))
        z, key = nodes.zones, nodes.key
        z.symbol = key
        if not len(z.begin):
            break
    number = np.zeros(len(begin), np.int64)
    found, number[np.concatenate(where)] = np.unique(np.concatenate(marks), return_inverse=True)
    return begin, number, found


def _windows(symbol: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> Zones:
    """All words of some texts, and all windows within one text."""
    first = np.cumsum(counts) - counts
    room = np.maximum(counts - window + 1, 0)
    begin = np.repeat(first - (np.cumsum(room) - room), room) + np.arange(room.sum())
    edge = np.zeros(len(symbol), bool)
    edge[first[counts > 0]] = True
    return Zones(symbol, np.arange(len(symbol)), edge, begin, np.ones(len(begin), np.int64), begin.copy(), begin + window)


# ---------------------------------------------------------------- packing


def _planes(x: np.ndarray, by: str) -> tuple[int, bytes]:
    """Bytes for each number, and byte planes of whole numbers: as they are ("r"), or of their differences, small for both signs ("d")."""
    x = x.astype(np.int64)
    if by == "d":
        x = np.diff(x, prepend=0)
        x = (x << 1) ^ (x >> 63)
    wide = max(1, -(-int(np.bitwise_or.reduce(x.view(U64), initial=U64(0))).bit_length() // 8))
    return wide, np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def packed(by: str, *arrays: np.ndarray, plain: bool = False) -> bytes:
    """``plain``: not compressed, for what is compressed as a whole later."""
    planes = [_planes(x, k) for k, x in zip(by, arrays)]
    head = b"".join(len(x).to_bytes(4, "little") + bytes([wide]) for x, (wide, _) in zip(arrays, planes))
    body = b"".join(data for _, data in planes)
    return head + (body if plain else zstandard.compress(body, 1))


def unpacked(by: str, data: bytes, plain: bool = False) -> list[np.ndarray]:
    heads = [(int.from_bytes(data[5 * k : 5 * k + 4], "little"), data[5 * k + 4]) for k in range(len(by))]
    raw, at, out = data[5 * len(by) :], 0, []
    if not plain:
        raw = zstandard.decompress(raw)
    for k, (n, wide) in zip(by, heads):
        x = np.zeros((n, 8), np.uint8)
        x[:, :wide] = np.frombuffer(raw, np.uint8, wide * n, at).reshape(wide, n).T
        x = x.view(np.int64).reshape(-1)
        at += wide * n
        out.append(np.cumsum((x.view(U64) >> U64(1)).view(np.int64) ^ -(x & 1)) if k == "d" else x)
    return out


def _by_part(part: np.ndarray, order: np.ndarray):
    """(part, rows) of each part that has any, in the order that ``order`` puts the rows in."""
    at = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1]))) if len(order) else []
    for a, b in zip(at, [*at[1:], len(order)]):
        yield int(part[order[a]]), order[a:b]


# ---------------------------------------------------------------- the first round, on words


class _Words:
    """A block's words, and the distinct contents that the first round asks names for: words, and the runs and pairs of them."""

    def __init__(self, block: Block, parts: int):
        self.start, self.end, self.counts = word_bounds(block.buf, block.off)
        h = word_hashes(block.buf, self.start, self.end)
        first, self.word = exact_words(block.buf, self.start, self.end, h)
        self.zones = _windows(self.word, self.counts)
        self.done, self.nodes = shrunk(self.zones, h, 1)
        n = self.nodes
        self.made = (n.l1 > 1) | (n.l2 > 0)
        columns = [x[self.made] for x in (n.s1, n.l1, n.s2, n.l2)]
        row, self.node = distinct_rows(n.key[self.made], columns)
        self.s1, self.l1, self.s2, self.l2 = (x[row] for x in columns)
        key = np.concatenate([mix(h[first]), mix(n.key[self.made][row])])
        self.several = np.concatenate([np.bincount(self.word, minlength=len(first)) > 1, np.bincount(self.node, minlength=len(row)) > 1])
        self.part = (key % U64(parts)).astype(np.int64)
        self.order = np.argsort(self.part.astype(np.uint16) if parts <= 1 << 16 else self.part, kind="stable")
        self.first = first

    def contents(self, block: Block) -> tuple[bytes, np.ndarray]:
        """Bytes and sizes of the contents in the order of ``order``. Words have no white space, so a space between runs and a tab before
        a run's length keep contents apart."""
        size = (self.end - self.start)[self.first]
        ends = np.concatenate(([0], np.cumsum(size)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(block.buf[spread(self.start[self.first], size)])])
        pair = (self.l1 == 1) & (self.l2 == 1)
        pairs = pc.binary_join_element_wise(words.take(pa.array(self.s1[pair])), words.take(pa.array(self.s2[pair])), pa.scalar(b" ", pa.large_binary()))
        word = lambda k, n: words[k].as_py() + (b"\t%d" % n if n > 1 else b"")
        runs = [word(a, m) + (b" " + word(b, n) if n else b"") for a, m, b, n in zip(*(x[~pair].tolist() for x in (self.s1, self.l1, self.s2, self.l2)))]
        at = np.where(pair, np.cumsum(pair) - 1, len(pairs) + np.cumsum(~pair) - 1) + len(words)
        texts = pa.concat_arrays([words, pairs, pa.array(runs, pa.large_binary())]).take(pa.array(np.concatenate([np.arange(len(words)), at])[self.order]))
        out, ends = text_buffer(texts)
        return out.tobytes(), np.diff(ends)


def _asked(parts: int):
    def run(batches):
        compress = zstandard.ZstdCompressor(1).compress
        for block in blocks.cut(batches):
            words = _Words(block, parts)
            raw, sizes = words.contents(block)
            ends = np.cumsum(sizes)
            several, part, out = words.several[words.order], words.part[words.order], []
            cuts = np.searchsorted(part, np.arange(parts + 1)).tolist()
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < b:
                    out.append((p, compress(packed("rr", sizes[a:b], several[a:b], plain=True) + raw[ends[a] - sizes[a] : ends[b - 1]])))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([block.name] * len(out), pa.int64()), blobs([d for _, d in out])], names=["part", "block", "data"])

    return run


def _numbers(number: np.ndarray, several: np.ndarray) -> np.ndarray:
    """1, 2, ... for contents that occur twice or more, 0 for the others."""
    again = np.bincount(number, 1.0 + several) > 1
    return np.where(again, np.cumsum(again), 0)[number]


def _named(words: bool):
    """Number the contents of each part, alike in all blocks."""

    def run(batches):
        for table, starts in whole_groups(batches, ["part"]):
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                group = table.slice(s, e - s)
                data = group.column("data").to_pylist()
                if words:
                    sizes, several, texts = [], [], []
                    for d in map(zstandard.decompress, data):
                        size, flag = unpacked("rr", d, plain=True)
                        sizes.append(size)
                        several.append(flag)
                        texts.append(d[len(d) - int(size.sum()) :])
                    size, buf = np.concatenate(sizes), np.frombuffer(b"".join(texts), np.uint8)
                    end = np.cumsum(size)
                    _, number = exact_words(buf, end - size, end, word_hashes(buf, end - size, end))
                    cuts = np.cumsum([0, *map(len, sizes)])
                    found = _numbers(number, np.concatenate(several))
                else:
                    lists = [unpacked("drrrr", d) for d in data]
                    s1, l1, s2, l2, several = (np.concatenate(x) for x in zip(*lists))
                    key = mix(mix(mix(s1.astype(U64)) + l1.astype(U64)) + mix(s2.astype(U64) * U64(3) + l2.astype(U64)))
                    _, number = distinct_rows(key, [s1, l1, s2, l2])
                    cuts = np.cumsum([0, *[len(x[0]) for x in lists]])
                    found = _numbers(number, several)
                yield pa.RecordBatch.from_arrays([group.column("block").combine_chunks(), group.column("part").combine_chunks(), blobs([packed("r", found[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])], names=["block", "part", "data"])

    return run


def _names(replies: list[tuple[int, bytes]], level: int, parts: int) -> np.ndarray:
    """Names in the order in which the contents were asked for, part by part; 0 for what occurs once."""
    out = [np.zeros(0, np.int64)]
    for part, data in replies:
        number = unpacked("r", data)[0]
        out.append(np.where(number > 0, (level << ROUND_BIT) + (number - 1) * parts + part, 0))
    return np.concatenate(out)


def _rows(block: int, rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), blobs([r[2] for r in rows])], names=["kind", "block", "part", "data"])


def _ended(begin: np.ndarray, n: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> list[tuple[str, int, bytes]]:
    return [("done", -1, packed("drdr", begin, n, at, symbol))] if len(begin) else []


def _next(z: Zones, level: int, parts: int) -> list[tuple[str, int, bytes]]:
    """The next round of named symbols: windows that end, contents to name, and what to go on with."""
    if not len(z.begin):
        return []
    key = mix(z.symbol.astype(U64))
    (begin, many, at, pick), n = shrunk(z, key, level)
    out = _ended(begin, many, at, z.symbol[pick])
    if len(n.zones.begin):
        made = (n.l1 > 1) | (n.l2 > 0)
        columns = [x[made] for x in (n.s1, n.l1, n.s2, n.l2)]
        row, number = distinct_rows(n.key[made], columns)
        s1, l1, s2, l2 = (x[row] for x in columns)
        several = np.bincount(number, minlength=len(row)) > 1
        part = (mix(n.key[made][row]) % U64(parts)).astype(np.int64)
        order = np.lexsort((s1, part))
        out += [("ask", p, packed("drrrr", s1[k], l1[k], s2[k], l2[k], several[k])) for p, k in _by_part(part, order)]
        rank = np.empty(len(row), np.int64)
        rank[order] = np.arange(len(row))
        value = np.where(made, 1, n.s1 * 2)
        value[made] = rank[number] * 2 + 1
        w = n.zones
        out.append(("state", -1, packed("rdrdrdd", value, w.at, w.edge, w.begin, w.n, w.low, w.high)))
    return out


def _first_round(parts: int):
    def work(block: Block, got: dict[int, list[bytes]]):
        words = _Words(block, parts)
        names = np.zeros(len(words.order), np.int64)
        found = _names([(p, d[0]) for p, d in sorted(got.items())], 1, parts)
        if len(found) != len(names):
            raise RuntimeError("a block's documents differ between two scans of the same table")
        names[words.order] = found
        word, node = names[: len(words.first)], names[len(words.first) :]
        own = word[words.word]  # each word's name
        z = words.nodes.zones
        symbol = word[words.nodes.s1]
        symbol[words.made] = node[words.node]
        unique = np.concatenate(([0], np.cumsum(own == 0)))
        # a series of windows has as many starts as its word has windows; each window needs all its own words shared
        begin, n, at, pick = words.done
        at, pick, begin = np.repeat(at, n), np.repeat(pick, n), spread(begin, n)
        ok = unique[begin + WINDOW] == unique[begin]
        begin, at, pick = begin[ok], at[ok], pick[ok]
        low, high, left = np.repeat(z.low, z.n), np.repeat(z.high, z.n), spread(z.begin, z.n)
        ok = unique[left + WINDOW] == unique[left]
        one = np.ones(int(ok.sum()), np.int64)
        z = Zones(symbol, z.at, z.edge, left[ok], one, low[ok], high[ok]).without(symbol == 0)
        out = _ended(begin, np.ones(len(begin), np.int64), at, own[pick]) + _next(z, 2, parts)
        left = np.sort(np.concatenate([begin, spread(z.begin, z.n)]))
        if len(left):  # the words of all windows that are left
            needed = blocks.covered(len(own), left, left + WINDOW)
            first = np.flatnonzero(needed & ~np.concatenate(([False], needed[:-1])))
            out.append(("words", -1, packed("dddddr", first, np.flatnonzero(needed & ~np.concatenate((needed[1:], [False]))) + 1, words.counts, block.doc, np.zeros(0), own[needed])))
        yield _rows(block.name, out)

    return work


def _round(level: int, parts: int):
    def run(batches):
        for table, starts in whole_groups(batches, ["block"]):
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                rows = table.slice(s, e - s).to_pylist()
                replies = list({r["part"]: r["data"] for r in rows if r["part"] >= 0}.items())
                names = _names(replies, level, parts)
                for r in rows:  # equal blocks have one name, and equal rows
                    if r["part"] < 0:
                        value, at, edge, begin, n, low, high = unpacked("rdrdrdd", r["data"])
                        made = (value & 1).astype(bool)
                        if int(value[made].max(initial=-1) >> 1) + 1 != len(names):
                            raise RuntimeError("names of a block are missing")
                        symbol = value >> 1
                        symbol[made] = names[symbol[made]]
                        z = Zones(symbol, at, edge.astype(bool), begin, n, low, high).without(symbol == 0)
                        yield _rows(r["block"], _next(z, level + 1, parts))

    return run


# ---------------------------------------------------------------- words decide


def _squeezed(x: np.ndarray) -> bytes:
    return packed("d", x)


def _unsqueezed(data: bytes) -> np.ndarray:
    return unpacked("d", data)[0]


def _later(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows have an equal one in a smaller document, or at a smaller start in the same one."""
    order = np.lexsort((start, doc, key))
    k, d, s = key[order], doc[order], start[order]
    first = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    at = np.flatnonzero(first)[np.cumsum(first) - 1]
    out = np.zeros(len(key), bool)
    out[order] = (d != d[at]) | (s != s[at])
    return out


def _same_words(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The number of each window's word sequence among the distinct ones; equal hashes are compared as words."""
    key = Rolling(words.astype(U64), 9).of(begin, begin + WINDOW)
    first, number = _first_of(key)
    if not all(np.array_equal(words[begin + k], words[begin[first] + k][number]) for k in range(WINDOW)):
        _, number = np.unique(np.stack([words[begin + k] for k in range(WINDOW)], 1), axis=0, return_inverse=True)
    return number.reshape(-1)


def _candidates(parts: int):
    """Windows that are first in their block, around the symbol they ended with: each occurrence of a symbol goes to the bucket that the symbol names, with the words of its windows."""

    def run(batches):
        for table, starts in whole_groups(batches, ["block"]):
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                rows = table.slice(s, e - s).to_pylist()
                texts = [r["data"] for r in rows if r["kind"] == "words"]
                if not texts:
                    continue
                low, high, counts, docs, _, words = unpacked("dddddr", texts[0])  # equal blocks have one name, and equal answers
                ended = [unpacked("drdr", d) for d in {r["data"] for r in rows if r["kind"] == "done"}]
                if not ended:
                    continue
                begin, n, at, symbol = (np.concatenate(x) for x in zip(*ended))
                begin, at, symbol = spread(begin, n), np.repeat(at, n), np.repeat(symbol, n)
                order = np.argsort(begin, kind="stable")
                begin, at, symbol = begin[order], at[order], symbol[order]
                sizes = high - low
                compact = begin - low[np.searchsorted(low, begin, "right") - 1] + (np.cumsum(sizes) - sizes)[np.searchsorted(low, begin, "right") - 1]
                first = np.cumsum(counts) - counts
                row = np.searchsorted(first + counts, begin, "right")
                doc, start = docs[row], begin - first[row]
                gone = _later(_same_words(words, compact), doc, start)  # decided inside the block
                out = [(-2 - abs(rows[0]["block"]) % parts, _squeezed(begin[gone]))]
                begin, at, symbol, compact, doc, start = (x[~gone] for x in (begin, at, symbol, compact, doc, start))
                order = np.lexsort((begin, symbol, at))
                new = np.ones(len(order), bool)
                new[1:] = (at[order][1:] != at[order][:-1]) | (symbol[order][1:] != symbol[order][:-1])
                lead, last = order[new], order[np.append(np.flatnonzero(new)[1:], len(order)) - 1] if len(order) else order
                group = np.empty(len(order), np.int64)
                group[order] = np.cumsum(new) - 1
                offset = begin - begin[lead][group]  # of each window in its group, below WINDOW
                bits = np.zeros(len(lead), np.int64)
                np.bitwise_or.at(bits, group, np.int64(1) << offset)
                wide = begin[last] - begin[lead] + WINDOW
                part = (mix(symbol[lead].astype(U64) ^ U64(77)) % U64(parts)).astype(np.int64)
                for p, k in _by_part(part, np.lexsort((begin[lead], part))):
                    out.append((p, packed("rdrrrdr", symbol[lead[k]], begin[lead[k]], bits[k], doc[lead[k]], start[lead[k]], wide[k], words[spread(compact[lead[k]], wide[k])])))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([rows[0]["block"]] * len(out), pa.int64()), blobs([r[1] for r in out])], names=["bucket", "block", "data"])

    return run


def _compared(batches):
    for table, starts in whole_groups(batches, ["bucket"]):
        for s, e in zip(starts, [*starts[1:], table.num_rows]):
            group = table.slice(s, e - s)
            bucket, name, data = group.column("bucket")[0].as_py(), group.column("block").to_pylist(), group.column("data").to_pylist()
            if bucket >= 0:
                lists = [unpacked("rdrrrdr", x) for x in data]
                symbol, place, bits, doc, start, wide, words = (np.concatenate(x) for x in zip(*lists))
                origin = np.repeat(np.arange(len(lists)), [len(x[0]) for x in lists])
                _, number, count = np.unique(symbol, return_inverse=True, return_counts=True)
                shared = np.flatnonzero(count[number] > 1)  # a symbol at one place only has no equal window elsewhere
                row, offset = np.nonzero(bits[shared, None] >> np.arange(WINDOW) & 1)
                row = shared[row]
                same = _same_words(words, (np.cumsum(wide) - wide)[row] + offset)
                gone = _later(same, doc[row], start[row] + offset)
                row, found = row[gone], (place[row] + offset)[gone]
                data = {k: _squeezed(found[origin[row] == k]) for k in np.unique(origin[row]).tolist()}
            else:
                data = dict(enumerate(data))
            yield pa.RecordBatch.from_arrays([pa.array([name[k] for k in data], pa.int64()), pa.array([max(bucket, 0)] * len(data), pa.int32()), blobs(list(data.values()))], names=["block", "part", "data"])


def repeated_words(docs: DataFrame, finish, schema) -> DataFrame:
    """Find each word covered by a window of WINDOW words that also starts earlier: in a smaller doc_id, or before in the same document.

    1. The first round names words, and runs and pairs of them, from the bytes of all documents; each further round names runs and
       pairs of symbols, for the windows that are left, and ends in a shared table.
    2. Windows that are left at their end are compared as sequences of words' names, which stand for one word each: inside their
       block, so that a window occurs once for each block however common it is, and then where the symbol they ended with meets its like.
    3. Later windows come back to their block. ``finish(block, start, end, counts, gone)`` makes the output.

    All exchanges have parts in proportion to the bytes of the text, which MOST_TASKS tasks at most take one after the other. A text longer than a block is a block of its own, of which a
    task holds some 100 bytes for each byte.
    """
    spark = docs.sparkSession
    docs = blocks.stable(docs)
    size = blocks.text_bytes(docs)
    parts, names = max(16, -(-size // PART_BYTES)), max(16, -(-size // NAME_BYTES))
    named = lambda asked, words: asked.repartition(blocks.tasks(names), "part").sortWithinPartitions("part").mapInArrow(_named(words), blocks.SCHEMA)
    asked = blocks.plain(docs).mapInArrow(_asked(names), "part int, block long, data binary")
    table = written(blocks.with_answers(docs, named(asked, True), parts, _first_round(names), _TABLE), "round", by=("kind",))
    kind = lambda k: table.filter(F.col("kind") == k).select("block", "part", "data")  # noqa: B023, E731
    kept = table.filter("kind in ('words', 'done')")
    for level in range(2, MOST_ROUNDS + 1):
        state = kind("state")
        if state.isEmpty():
            break
        rows = state.unionByName(named(kind("ask"), False)).repartition(blocks.tasks(names), "block").sortWithinPartitions("block", "part")
        old, table = table, written(rows.mapInArrow(_round(level, names), _TABLE), "round", by=("kind",))
        for path in {f.rsplit("/kind=", 1)[0] for f in old.inputFiles()}:
            for k in ("state", "ask"):
                deleted(spark, f"{path}/kind={k}")
        kept = kept.unionByName(table.filter("kind = 'done'"))
    else:
        raise RuntimeError("a window outlived all rounds")
    windows = kept.select("kind", "block", "data").repartition(blocks.tasks(parts), "block").sortWithinPartitions("block").mapInArrow(_candidates(parts), "bucket int, block long, data binary")
    later = windows.repartition(blocks.tasks(parts), "bucket").sortWithinPartitions("bucket").mapInArrow(_compared, blocks.SCHEMA)

    def work(block: Block, got: dict[int, list[bytes]]):
        start, end, counts = word_bounds(block.buf, block.off)
        at = np.concatenate([np.zeros(0, np.int64), *[_unsqueezed(d) for many in got.values() for d in set(many)]])
        yield finish(block, start, end, counts, blocks.covered(len(start), at, at + WINDOW))

    return blocks.with_answers(docs, later, parts, work, schema)


def _kept(block: Block, start: np.ndarray, end: np.ndarray, counts: np.ndarray, gone: np.ndarray):
    """Kept words of each text, joined by one space."""
    sizes = (end - start)[~gone]
    out = np.append(block.buf, np.uint8(0x20))[spread(start[~gone], sizes + 1)]
    ends = np.cumsum(sizes + 1)
    out[ends - 1] = 0x20
    raw = out.tobytes()
    kept = np.concatenate(([0], np.cumsum(~gone)))[np.concatenate(([0], np.cumsum(counts)))]
    at = np.concatenate(([0], ends))[kept]
    removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[np.concatenate(([0], np.cumsum(counts)))])
    return removed, [raw[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:])]


def _doc_ids(block: Block) -> pa.Array:
    return pa.array(block.doc, pa.int64(), mask=block.doc == blocks.NO_DOC)


def _digest(block: Block, start, end, counts, gone) -> pa.RecordBatch:
    removed, kept = _kept(block, start, end, counts, gone)
    return pa.RecordBatch.from_arrays([_doc_ids(block), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _text(block: Block, start, end, counts, gone) -> pa.RecordBatch:
    removed, kept = _kept(block, start, end, counts, gone)
    return pa.RecordBatch.from_arrays([_doc_ids(block), pa.array(removed, pa.int64()), pa.array([x.decode() for x in kept], pa.string())], names=["doc_id", "n_removed", "kept_text"])


def repeat_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of ``docs`` (doc_id, text; a null text is empty).

    A null doc_id counts as the largest; rows with one doc_id count as one document.
    """
    return repeated_words(docs, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_removed, kept_text): kept words joined by one space."""
    return repeated_words(docs, _text, "doc_id long, n_removed long, kept_text string")
