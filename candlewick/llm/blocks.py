"""Blocks of documents that several scans of one table cut alike, so that what later stages find comes back by block and byte.

A block is named by a hash of its texts and doc_ids. Answers are joined to the block's texts under that name; if a
second scan cut the rows differently, the names would not meet and the job fails rather than losing rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, lean, text_buffer, whole_groups, written

BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 10_000
#: Most tasks of one exchange. Groups inside of it may be more: a task takes one after the other.
MOST_TASKS = 100_000
#: Every table that is dealt by block: part -1 has the texts, other parts have answers.
SCHEMA = "block long, part int, data binary"
NO_DOC = np.iinfo(np.int64).max


class Block:
    """``buf`` and ``off`` are the texts' bytes and offsets, ``doc`` the doc_ids; a null doc_id counts as the largest.

    ``rest`` holds further columns, as a stream of Arrow record batches.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, doc: np.ndarray, name: int | None = None, rest: bytes = b""):
        self.buf, self.off, self.doc, self.rest = buf, off, doc, rest
        if name is None:
            h = xxhash.xxh3_64(buf.tobytes())
            h.update(off.tobytes())
            h.update(doc.tobytes())
            name = int(np.uint64(h.intdigest()).view(np.int64))
        self.name = name

    def pack(self) -> bytes:
        head = np.concatenate([[len(self.doc), len(self.buf)], np.diff(self.off), self.doc]).astype(np.int64)
        return zstandard.compress(head.tobytes() + self.buf.tobytes() + self.rest, 3)

    @staticmethod
    def unpack(data: bytes, name: int) -> Block:
        raw = zstandard.decompress(data)
        n, size = np.frombuffer(raw, np.int64, 2).tolist()
        sizes, doc = np.frombuffer(raw, np.int64, 2 * n, 16).reshape(2, n)
        at = 16 * (n + 1)
        return Block(np.frombuffer(raw, np.uint8, size, at), np.concatenate(([0], np.cumsum(sizes))), doc, name, raw[at + size :])

    def columns(self) -> pa.Table:
        return pa.ipc.open_stream(self.rest).read_all()


def stable(docs: DataFrame) -> DataFrame:
    """``docs`` if it is a plain scan of files, whose rows are cut alike at every scan; else a written table of it.

    How files are split must not follow the number of executors, which changes when some are lost: their least number
    of parts is set once for the session, unless it is set already.
    """
    spark = docs.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    plan = docs._jdf.queryExecution().optimizedPlan()
    nodes = {re.sub(r"^[ :+\-]*", "", line).split(" ")[0] for line in plan.toString().splitlines() if line.strip()}
    return docs if plan.deterministic() and nodes <= {"Project", "Filter", "Relation"} else written(docs, "documents")


def plain(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"__{c}") for c in keep])


def cut(batches):
    """Blocks of rows in their order: BLOCK_BYTES of text and BLOCK_ROWS rows at most, or one row.

    Only the texts decide where a block ends, not the record batches, which also follow what other columns hold; so scans that read
    different columns cut alike.
    """
    held: list[pa.RecordBatch] = []
    bytes_, rows = 0, 0
    for batch in batches:
        _, off = text_buffer(batch.column("text"))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + BLOCK_BYTES - bytes_, "right")) - 1
            end = min(end, start + BLOCK_ROWS - rows)
            if end <= start and rows:
                yield _block(held)
                held, bytes_, rows = [], 0, 0
                continue
            end = max(end, start + 1)
            held.append(batch.slice(start, end - start))
            bytes_, rows, start = bytes_ + int(off[end] - off[start]), rows + end - start, end
    if rows:
        yield _block(held)


def _block(held: list[pa.RecordBatch]) -> Block:
    texts = [text_buffer(b.column("text")) for b in held]
    ends = np.cumsum(np.concatenate([[0], *[np.diff(off) for _, off in texts]]))
    rest = b""
    if held[0].num_columns > 2:
        names = [c.removeprefix("__") for c in held[0].schema.names[2:]]
        sink, more = pa.BufferOutputStream(), [pa.RecordBatch.from_arrays([*b.columns[2:]], names=names) for b in held]
        with pa.ipc.new_stream(sink, more[0].schema) as out:
            for b in more:
                out.write_batch(b)
        rest = sink.getvalue().to_pybytes()
    doc = np.concatenate([b.column("doc_id").fill_null(NO_DOC).to_numpy() for b in held])
    return Block(np.concatenate([buf for buf, _ in texts]), ends, doc, rest=rest)


def _packed(batches):
    for block in cut(batches):
        yield pa.RecordBatch.from_arrays([pa.array([block.name], pa.int64()), pa.array([-1], pa.int32()), blobs([block.pack()])], names=["block", "part", "data"])


def with_answers(docs: DataFrame, answers: DataFrame, parts: int, work, schema, keep: tuple[str, ...] = ()) -> DataFrame:
    """Call ``work(block, {part: [data, ...]})`` for every block with the answers that name it; it yields record batches."""

    def run(batches):
        for table, starts in whole_groups(batches, ["block"]):
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                rows = table.slice(s, e - s).to_pylist()
                packed = [r["data"] for r in rows if r["part"] == -1]
                if not packed:
                    raise RuntimeError("a block's documents differ between two scans of the same table")
                got: dict[int, list[bytes]] = {}
                for r in rows:
                    if r["part"] != -1:
                        got.setdefault(r["part"], []).append(r["data"])
                for data in packed:  # equal blocks have one name, and equal answers
                    yield from work(Block.unpack(data, rows[0]["block"]), got)

    texts = plain(docs, keep).mapInArrow(lean(_packed), SCHEMA)
    return texts.unionByName(answers).repartition(tasks(parts), "block").sortWithinPartitions("block", "part").mapInArrow(lean(run), schema)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, from which the number of parts follows."""
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def tasks(parts: int) -> int:
    return min(parts, MOST_TASKS)


def shared_marks(part: np.ndarray, keys: np.ndarray, parts: int):
    """Split 32-bit keys by part, in order: (part, keys) of those parts that have any."""
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
        yield int(ordered[a]), keys[order[a:b]]


def repeated(marks: DataFrame, parts: int, hot: int) -> DataFrame:
    """Answer each row of (part, block, keys) with a bit for each key, whether it occurs again in the part, and, if any does, another for whether it occurs ``hot`` times.

    Keys have 32 bits beside the part, of which there are as many as the input needs; a key that looks
    repeated by accident only costs a later comparison.
    """

    def run(batches):
        for table, starts in whole_groups(batches, ["part"]):
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                group = table.slice(s, e - s)
                buf, off = text_buffer(group.column("data"))
                keys = np.frombuffer(buf, np.uint32)
                ordered = np.sort(keys)
                again, often = ordered[1:][ordered[1:] == ordered[:-1]], ordered[hot - 1 :][ordered[hot - 1 :] == ordered[: max(len(ordered) - hot + 1, 0)]]
                hit, many = _among(keys, again), _among(keys, often)
                off = off // 4
                data = [np.packbits(hit[a:b]).tobytes() + (np.packbits(many[a:b]).tobytes() if many[a:b].any() else b"") for a, b in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays([group.column("block").combine_chunks(), group.column("part").combine_chunks(), blobs(data)], names=["block", "part", "data"])

    return marks.repartition(tasks(parts), "part").sortWithinPartitions("part").mapInArrow(lean(run), SCHEMA)


def _among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def marked(part: np.ndarray, parts: int, got: dict[int, list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The answers of ``repeated`` back in the order of the keys: which occur again, and which are hot."""
    hit, hot = np.zeros(len(part), bool), np.zeros(len(part), bool)
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
        p = int(ordered[a])
        if p not in got:
            raise RuntimeError("a block's documents differ between two scans of the same table")
        own, bits = order[a:b], np.frombuffer(got[p][0], np.uint8)
        wide = -(-len(own) // 8)
        hit[own] = np.unpackbits(bits[:wide], count=len(own)).astype(bool)
        if len(bits) > wide:
            hot[own] = np.unpackbits(bits[wide:], count=len(own)).astype(bool)
    return hit, hot


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the half-open intervals."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0
