"""Mixing sources to target weights by pivotal dependent rounding, with residuals combined in a reduction tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, lean, mix, text_buffer, text_pieces, word_bounds, written

#: Mean number of rows that meet in a leaf of the tree, how many leaves meet in an inner node, and mean number of sources that share a tree.
LEAF, FAN, SOURCES = 1000, 32, 64
WEIGHTS = (3.0, 1.0, 2.0)


def word_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``size``, the number of runs of bytes other than 0x20 and 0x09-0x0D in the whole text; 0 for null."""
    schema = docs.select(*keep).schema.add("size", "long")

    def run(batches):
        for batch in batches:
            for piece in text_pieces(batch, "__text", 1 << 20):
                counts = word_bounds(*text_buffer(piece.column("__text")))[2]
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], pa.array(counts, pa.int64())], names=[*keep, "size"])

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(lean(run), schema)


def targets(sizes: list[float], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares of ``share`` times all sizes by weight, none above ``most`` times its size; excess goes to the rest by weight."""
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): sources in order of code points, null last, take the weights in turn.

    The excess of capped sources is dealt again in rounds of Spark aggregates, since there may be many
    sources: the ratio of a target to its weight only rises, so capped sources stay capped.
    """
    spark = sized.sparkSession
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The order of sources needs their rank: range-partitioned and counted by partition, not through one task.
    dealt = by.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = written(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "sources")
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one number for each partition
    before, offsets = 0, {}
    for part in sorted(counts):
        offsets[part] = before
        before += counts[part]
    first = spark.createDataFrame(list(offsets.items()) or [(0, 0)], "part int, first long")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = placed.join(first, "part").withColumn("weight", F.get(cycle, ((F.col("first") + F.col("at")) % len(weights)).cast("int")))
    ranked = ranked.withColumn("limit", F.col("source_size") * most / F.col("weight")).select("source", "source_size", "weight", "limit")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:  # level: what a weight of 1 gets; sources whose limit is lower are capped
        over = F.col("limit") < level if level is not None else F.lit(False)
        row = ranked.agg(F.sum(F.when(over, F.col("source_size") * most)).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("n")).first()
        if row["n"] == capped or not row["open"]:
            break
        level, capped = (share * total - (row["taken"] or 0.0)) / row["open"], row["n"]
    target = F.least(F.col("source_size") * float(most), F.col("weight") * F.lit(float(level or 0.0)))
    return ranked.select("source", "source_size", target.alias("target"))


def _unit(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> U64(11)).astype(np.float64) / (1 << 53)


def _transfer(sizes: np.ndarray, share: np.ndarray, chance: np.ndarray, taken: np.ndarray) -> int:
    """Round the fractions ``share`` in place into ``taken`` (0 or 1); the index of the residual, or -1.

    The current residual meets the next row: a random transfer between the two keeps the sum of
    size * share and each expectation, and makes one of the two integral.
    """
    held = -1
    for i in range(len(sizes)):
        if share[i] <= 1e-12 or sizes[i] == 0:
            continue
        if share[i] >= 1 - 1e-12:
            taken[i] = 1
            continue
        if held < 0:
            held = i
            continue
        a, b, p, q = sizes[held], sizes[i], share[held], share[i]
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
        move = up if chance[i] * (up + down) < down else -down
        p, q = p + move / a, q - move / b
        share[held], share[i] = p, q
        p_done, q_done = p < 1e-9 or p > 1 - 1e-9, q < 1e-9 or q > 1 - 1e-9
        if p_done:
            taken[held] = int(p > 0.5)
        if q_done:
            taken[i] = int(q > 0.5)
        held = -1 if p_done and q_done else i if p_done else held
    return held


_ROW = "doc_id long, source string, size long, whole long, share double, tie long, tree long, leaves long, node long, extra long, done boolean"


def _node(level: int):
    def run(table: pa.Table) -> pa.Table:
        pdf = table.to_pandas()
        last = len(pdf) > 0 and bool(pdf["leaves"].iloc[0] == 1)  # the root of a tree
        pdf["_s"] = pdf["source"].isna()
        pdf["_d"] = -pdf["size"]  # large rows first, so that what is left over at the end is small
        pdf = pdf.sort_values(["_s", "source", "_d", "tie", "doc_id"], kind="stable", na_position="last").reset_index(drop=True)
        sizes, share = pdf["size"].to_numpy(np.float64), pdf["share"].to_numpy(np.float64, copy=True)
        taken, done = np.zeros(len(pdf), np.int64), np.ones(len(pdf), bool)
        chance = _unit(pdf["tie"].to_numpy().view(U64) ^ U64(level * 0x9E3779B9))
        key = pdf["source"].fillna("\0\0null") + np.where(pdf["_s"], "-", "+")
        cuts = [*np.flatnonzero(np.concatenate(([True], key.to_numpy()[1:] != key.to_numpy()[:-1]))), len(pdf)] if len(pdf) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            held = _transfer(sizes[a:b], share[a:b], chance[a:b], taken[a:b])
            if held >= 0:
                if last:
                    taken[a + held] = int(chance[a + held] < share[a + held])
                else:
                    done[a + held] = False
        pdf["extra"], pdf["done"], pdf["share"], pdf["node"], pdf["leaves"] = taken, done, share, pdf["node"] // FAN, -(-pdf["leaves"] // FAN)
        return pa.Table.from_pandas(pdf.drop(columns=["_s", "_d"]), schema=table.schema, preserve_index=False)

    return run


def pivotal_copies(sized: DataFrame, share_of: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for rows of (doc_id, source, size), and ``salt``, a long that tells rows of one doc_id and size apart, if there is one.

    A row's expected copies are its source's target / source_size. The whole part is taken; the fraction is
    rounded by weighted pivotal sampling: rows of a source meet in pairs, mass moves between them at
    random so that expectations and the source's total stay, until one is integral. Leaves are dealt by a hash of the row,
    so a hot source fills as many leaves as it needs, and leave at most one residual for each source; residuals
    meet in nodes of FAN leaves, level by level. Some SOURCES sources share a tree, so a node never has more than FAN times as many residuals. Only the last residual of a source is rounded
    alone, so its total differs from the target by less than one document. Chances are hashes of doc_id, size and salt: reruns agree.
    """
    want = share_of.withColumn("copies", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    rows = sized.join(want.select(F.col("source").alias("s"), "source_size", "target", "copies"), sized["source"].eqNullSafe(F.col("s"))).drop("s")
    tie = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "size", *(["salt"] if "salt" in sized.columns else []), F.lit(11))
    trees = max(1, -(-want.count() // SOURCES))
    rows = rows.withColumns({"whole": F.floor("copies").cast("long"), "tie": tie, "tree": F.pmod(F.xxhash64("source", F.lit(7)), F.lit(trees)).cast("long")})
    sizes = rows.groupBy("tree").agg(F.ceil(F.count("*") / LEAF).cast("long").alias("leaves"))
    rows = rows.join(written(sizes, "trees"), "tree")
    node = F.pmod(F.xxhash64("tie", F.lit(3)), F.col("leaves"))
    level_rows = rows.select("doc_id", "source", "size", "whole", (F.col("copies") - F.col("whole")).alias("share"), "tie", "tree", "leaves", node.alias("node"), F.lit(0).cast("long").alias("extra"), F.lit(False).alias("done"))
    parts, level = [], 0
    while True:
        table = written(level_rows.groupBy("tree", "node").applyInArrow(_node(level), _ROW), "mixing")
        parts.append(table.filter("done"))
        level_rows = table.filter("not done")
        if level_rows.isEmpty():
            break
        level += 1
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    out = done.join(want.select(F.col("source").alias("s"), "source_size", "target"), done["source"].eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "source_size", "target", ((F.col("whole") + F.col("extra")) * F.col("size")).alias("taken"), (F.col("whole") + F.col("extra")).alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Sizes, targets and taken words of each row of ``docs`` (doc_id, source, text).

    ``size`` counts words; a null text has none and is taken 0 times its 0 words. A null source is a source of its own, last in order.
    Repeated rows with one doc_id are rounded one by one; rows without doc_id are told apart by their texts. An empty table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sized = written(word_counts(plain.withColumn("salt", F.xxhash64("text")), ["doc_id", "source", "salt"]), "sizes")
    return pivotal_copies(sized, source_targets(sized, weights, share, most))
