"""Byte-level BPE over a distinct-word table: every distinct word is encoded once and its ids are joined back by position."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from . import blocks
from .common import U64, Rolling, blobs, lean, mix, spread, text_buffer, text_pieces, whole_groups

#: Text of one block of documents, whose words share one dictionary, and of one step inside it.
BLOCK_BYTES, PIECE = 4 << 20, 1 << 19
#: Text for each part of the two exchanges: distinct words are fewer than words.
WORD_BYTES, PART_BYTES = 16 << 20, 4 << 20
#: Ids that are joined and decoded at a time.
STEP = 100_000
#: White space of the split pattern, and what follows an apostrophe in a contraction.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(1)
def _kinds() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c in "LN":
            kinds[cp] = LETTER if c == "L" else NUMBER
    kinds[WHITE] = SPACE
    return kinds


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, {str(x.content): i for i, x in t.get_added_tokens_decoder().items()}


def _spec(path: str) -> dict:
    """The tokenizer's file, if it is of the kind whose words can be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("only byte-level BPE with the usual split pattern, without normalizer and prefix space")
    if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take in their surroundings aren't supported")
    return spec


def _special(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec.get("added_tokens", [])}


def split_words(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where words start in the code points of texts that begin at ``off[:-1]``: the split that byte-level BPE makes before its merges.

    Runs of letters, numbers, other characters or white space are words. A single space before a run that isn't white
    space goes to that run; of longer white space before another run only the last character stands
    apart; contractions are cut from the letters that follow them.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[cp]
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    first = first[:n]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.zeros(n, bool)  # the last character of a text
    last[off[1:][np.diff(off) > 0] - 1] = True
    space = kind == SPACE
    run_end = space & ~last
    run_end[:-1] &= ~space[1:]  # white space whose next character, in the same text, is not
    run_end[-1] = False
    at = np.flatnonzero(run_end)
    start[at] = True  # it begins a word, alone or with what follows
    joined = at[cp[at] == 0x20]
    start[joined + 1] = False
    # contractions: an apostrophe that begins a word and is followed by one of the endings in the same text
    begin = np.flatnonzero((cp == 0x27) & start)
    if len(begin):
        ends = np.append(np.flatnonzero(first), n)
        room = ends[np.searchsorted(ends, begin, "right")] - begin
        done = np.zeros(len(begin), bool)
        padded = np.concatenate([cp, np.zeros(2, cp.dtype)])
        for c in CONTRACTIONS:
            hit = ~done & (room > len(c))
            for k, ch in enumerate(c):
                hit &= padded[begin + 1 + k] == ord(ch)
            done |= hit
            b = begin[hit]
            for k in range(len(c)):
                start[b + 1 + k] = False
            after = b + 1 + len(c)
            after = after[after < n]
            start[after] = True
            # a space after the contraction keeps its own role, a start is set there anyway
    return np.flatnonzero(start)


def _segments(text: str, special: dict[str, int]):
    """Text between special tokens, and the special tokens' ids; where several begin, the longest counts."""
    at = 0
    for found in re.finditer("|".join(map(re.escape, sorted(special, key=len, reverse=True))), text):
        if found.start() > at:
            yield text[at : found.start()], None
        yield None, special[found[0]]
        at = found.end()
    if at < len(text):
        yield text[at:], None


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as compressed planes of their bytes."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unplanes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def _distinct(cp: np.ndarray, joined: str, start: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The number of each word among the distinct ones, and those; equal hashes are compared as words."""
    codes, names = pd.factorize(Rolling(mix(cp), 11).of(start, ends))
    first = np.full(len(names), len(codes), np.int64)
    np.minimum.at(first, codes, np.arange(len(codes)))
    size = ends - start
    same = np.array_equal(size, size[first][codes]) and np.array_equal(cp, cp[spread(start[first][codes], size)])
    if same:
        return codes, [joined[a:b] for a, b in zip(start[first].tolist(), ends[first].tolist())]
    codes, names = pd.factorize(np.array([joined[a:b] for a, b in zip(start.tolist(), ends.tolist())], object))
    return codes, list(names)


class _Block:
    """The dictionary of some documents, and their words as numbers in it.

    A word is a str, or the id of a special token that the text spells out.
    """

    def __init__(self, rows: pa.RecordBatch, parts: int, special: dict[str, int]):
        digest = xxhash.xxh3_64()
        per_doc, codes, numbers = [], [np.zeros(0, np.int32)], {}
        marks = [s.encode() for s in special]
        for piece in text_pieces(rows, "text", PIECE):
            buf, off = text_buffer(piece.column("text"))
            raw = buf.tobytes()
            digest.update(raw)
            digest.update(np.diff(off).tobytes())
            if any(s in raw for s in marks):
                segments, owner, ids = [], [], []
                for d, (a, b) in enumerate(zip(off[:-1], off[1:])):
                    for s, i in _segments(raw[a:b].decode(), special):
                        segments.append(s or "")
                        owner.append(d)
                        ids.append(-1 if i is None else i)
                joined = "".join(segments)
                lengths, owner, ids = np.fromiter(map(len, segments), np.int64, len(segments)), np.array(owner, np.int64), np.array(ids, np.int64)
            else:
                joined = raw.decode()
                chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                lengths, owner, ids = np.diff(chars[off]), np.arange(len(off) - 1), None
            cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            seg_off = np.concatenate(([0], np.cumsum(lengths)))
            start = split_words(cp, seg_off)
            ends = np.append(start[1:], len(cp)) if len(start) else start
            counts = np.diff(np.searchsorted(start, seg_off))
            own, words = _distinct(cp, joined, start, ends)
            if ids is not None and (ids >= 0).any():  # a special token is a word of its own
                place = (np.cumsum(counts) - counts)[ids >= 0]
                names, of = np.unique(ids[ids >= 0], return_inverse=True)
                own = np.insert(own, place, len(words) + of)
                words = [*words, *names.tolist()]
                counts = counts + (ids >= 0)
            per_doc.append(np.bincount(owner, counts, len(off) - 1).astype(np.int64))
            codes.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))[own])
        self.name = int(np.uint64(digest.intdigest()).view(np.int64))
        self.per_doc = np.concatenate(per_doc) if per_doc else np.zeros(0, np.int64)
        found = np.concatenate(codes)
        often = np.argsort(-np.bincount(found, minlength=len(numbers)), kind="stable")
        rank = np.empty(len(numbers), np.int32)
        rank[often] = np.arange(len(numbers))
        words = list(numbers)
        # a special token goes as its id, marked by a byte that no UTF-8 has
        self.codes, self.words = rank[found], [w.encode() if isinstance(w := words[k], str) else b"\xff%d" % w for k in often]
        self.part = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in self.words), np.int64, len(words))


def _blocks(batches, parts: int, special: dict[str, int]):
    for batch in batches:
        for rows in text_pieces(batch, "text", BLOCK_BYTES):
            yield rows, _Block(rows, parts, special)


_REPLY = "block long, part int, counts binary, ids binary, docs binary"


def _dictionaries(parts: int, special: dict[str, int]):
    def run(batches):
        for _, block in _blocks(batches, parts, special):
            order = np.argsort(block.part, kind="stable")
            edges = np.searchsorted(block.part[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(edges))
            lists = [[block.words[i] for i in order[edges[p] : edges[p + 1]]] for p in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), block.name), pa.int64()), blobs([_planes(np.array([len(w) for w in x], np.int64)) for x in lists]), blobs([zstandard.compress(b"".join(x), 3) for x in lists])], names=["part", "block", "lengths", "words"])

    return run


def _sequences(parts: int, special: dict[str, int]):
    def run(batches):
        for rows, block in _blocks(batches, parts, special):
            docs = pa.table({"doc_id": rows.column("doc_id")})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema) as w:
                w.write_table(docs)
            head = np.concatenate([[len(block.per_doc)], block.per_doc, block.part])
            yield pa.RecordBatch.from_arrays([pa.array([block.name], pa.int64()), pa.array([-1], pa.int32()), blobs([_planes(head)]), blobs([_planes(block.codes)]), blobs([zstandard.compress(sink.getvalue().to_pybytes(), 1)])], names=["block", "part", "counts", "ids", "docs"])

    return run


def _encoded(path: str):
    def run(batches):
        tokenizer, _ = _tokenizer(path)
        for table, starts in whole_groups(batches, ["part"]):
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                group = table.slice(s, e - s)
                ids: dict[bytes, list[int]] = {}
                lists = []
                for lengths, words in zip(group.column("lengths").to_pylist(), group.column("words").to_pylist()):
                    raw, ends = zstandard.decompress(words), np.cumsum(_unplanes(lengths)).tolist()
                    lists.append([raw[a:b] for a, b in zip([0, *ends], ends)])
                    ids.update(dict.fromkeys(lists[-1]))
                own = [w for w in ids if w[:1] != b"\xff"]
                for a in range(0, len(own), 10_000):
                    part = own[a : a + 10_000]
                    ids.update(zip(part, (x.ids for x in tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False))))
                ids.update({w: [int(w[1:])] for w in ids if w[:1] == b"\xff"})
                counts = [_planes(np.array([len(ids[w]) for w in x], np.int64)) for x in lists]
                flat = [_planes(np.array([i for w in x for i in ids[w]], np.int64)) for x in lists]
                yield pa.RecordBatch.from_arrays([group.column("block").combine_chunks(), group.column("part").combine_chunks(), blobs(counts), blobs(flat), pa.nulls(len(lists), pa.binary())], names=["block", "part", "counts", "ids", "docs"])

    return run


@functools.lru_cache(2)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every id's piece, one after the other, and where each begins: the right side of the id-to-piece join."""
    spec = _spec(path)
    #: The bytes that byte-level BPE writes as themselves; the others are characters from 256 on, in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
    named = {i: bytes(chars[c] for c in w) for w, i in spec["model"]["vocab"].items()} | {i: s.encode() for s, i in _special(spec).items()}
    pieces = [named.get(i, b"") for i in range(max(named) + 1)]
    ends = np.cumsum([0, *map(len, pieces)])
    return np.frombuffer(b"".join(pieces), np.uint8), ends


def _joined(path: str, emit):
    def run(batches):
        piece_bytes, piece_at = _pieces(path)
        for table, starts in whole_groups(batches, ["block"]):
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                rows = table.slice(s, e - s).to_pylist()
                heads = [r for r in rows if r["part"] < 0]
                replies = [r for r in rows if r["part"] >= 0]
                # equal blocks of documents have one name: each is answered as often as it occurs, all alike
                replies = list({r["part"]: r for r in replies}.values())
                counts = np.concatenate([_unplanes(r["counts"]) for r in replies] or [np.zeros(0, np.uint32)]).astype(np.int64)
                flat = np.concatenate([_unplanes(r["ids"]) for r in replies] or [np.zeros(0, np.uint32)])
                for r in heads:
                    head = _unplanes(r["counts"]).astype(np.int64)
                    n = head[0]
                    per_doc, part = head[1 : n + 1], head[n + 1 :]
                    if len(part) != len(counts):
                        raise RuntimeError("a block's documents differ between two reads of the same input")
                    order = np.argsort(part, kind="stable")
                    first = np.empty(len(order), np.int64)
                    size = np.empty(len(order), np.int64)
                    first[order] = np.cumsum(counts) - counts
                    size[order] = counts
                    codes = _unplanes(r["ids"])
                    docs = pa.ipc.open_stream(zstandard.decompress(r["docs"])).read_all()
                    ends = np.cumsum(per_doc)
                    a = 0
                    while a < n:  # some documents at a time
                        begin = ends[a] - per_doc[a]
                        b = max(a + 1, int(np.searchsorted(ends, begin + STEP, "right")))
                        w = codes[begin : ends[b - 1]]
                        ids = flat[spread(first[w], size[w])]
                        word_ends = np.cumsum(size[w])
                        cut = np.concatenate(([0], ends[a:b] - begin))
                        at = np.concatenate(([0], word_ends))[cut]
                        size_of = piece_at[ids + 1] - piece_at[ids]
                        out = piece_bytes[spread(piece_at[ids], size_of)]
                        out_at = np.concatenate(([0], np.cumsum(size_of)))[at]
                        yield emit(docs.slice(a, b - a), ids, at, out, out_at)
                        a = b

    return run


def _digests(docs: pa.Table, ids: np.ndarray, at: np.ndarray, out: np.ndarray, out_at: np.ndarray) -> pa.RecordBatch:
    raw, text = ids.astype("<u4").tobytes(), out.tobytes()
    hexes = [[hashlib.sha256(data[a * k : b * k]).hexdigest() for a, b in zip(w[:-1], w[1:])] for data, k, w in ((raw, 4, at), (text, 1, out_at))]
    return pa.RecordBatch.from_arrays([docs.column("doc_id").combine_chunks(), pa.array(np.diff(at), pa.int64()), pa.array(hexes[0]), pa.array(hexes[1])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _full(docs: pa.Table, ids: np.ndarray, at: np.ndarray, out: np.ndarray, out_at: np.ndarray) -> pa.RecordBatch:
    text = out.tobytes()
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
    decoded = pa.array([text[a:b].decode(errors="replace") for a, b in zip(out_at[:-1], out_at[1:])], pa.string())
    return pa.RecordBatch.from_arrays([docs.column("doc_id").combine_chunks(), lists, decoded], names=["doc_id", "ids", "decoded"])


def _ids(docs: pa.Table, ids: np.ndarray, at: np.ndarray, out: np.ndarray, out_at: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([docs.column("doc_id").combine_chunks(), pa.array(np.diff(at), pa.int64()), lists], names=["doc_id", "n_tokens", "ids"])


def _run(docs: DataFrame, tokenizer: str | None, emit, schema: str) -> DataFrame:
    path = tokenizer or default_tokenizer()
    special = _special(_spec(path))
    docs = blocks.stable(docs)
    size = blocks.text_bytes(docs)
    parts, shuffle = max(16, -(-size // WORD_BYTES)), max(16, -(-size // PART_BYTES))
    docs = blocks.plain(docs)
    words = docs.mapInArrow(lean(_dictionaries(parts, special)), "part int, block long, lengths binary, words binary")
    replies = words.repartition(blocks.tasks(parts), "part").sortWithinPartitions("part").mapInArrow(lean(_encoded(path)), _REPLY)
    sequences = docs.mapInArrow(lean(_sequences(parts, special)), _REPLY)
    return sequences.unionByName(replies).repartition(blocks.tasks(shuffle), "block").sortWithinPartitions("block", "part").mapInArrow(lean(_joined(path, emit)), schema)


def encode_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs`` (doc_id, text; a null text is empty).

    Ids equal what the tokenizers library gives for the whole text with add_special_tokens=False: words are split in
    the tasks that read the documents, each distinct word is encoded once in the task that its
    hash names, and the ids go back to the words' positions; special tokens that a text spells out are ids of their own. The
    documents travel as word numbers, not as text. Repeated rows give repeated rows; further columns are ignored.
    Both exchanges have as many parts as the bytes of the text ask for. A text longer than a block is a block of its
    own; steps inside are of whole texts, and hold some 40 bytes for each byte of the longest one.
    """
    return _run(docs, tokenizer, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) by the same steps, with the ids themselves."""
    return _run(docs, tokenizer, _ids, "doc_id long, n_tokens long, ids array<int>")


def encode_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) by the same steps, with the ids and the decoded text themselves."""
    return _run(docs, tokenizer, _full, "doc_id long, ids array<int>, decoded string")
