"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, components, text_buffer, whole_groups, written

#: Leading principal dimensions whose grid cells order the vectors, and bits of a cell's number.
GRID_DIMS, CELL_BITS = 8, 7
#: Vectors in one interval of the sequence, and in one leaf of the recursion.
INTERVAL, LEAF = 8192, 512
LEAD = tuple(f"lead{k}" for k in range(GRID_DIMS))
#: Room for rounding when distances decide what may be skipped; cosines themselves decide links.
SLACK = 1e-6


def _unit(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the vectors that can have a cosine: as many components as the batch says, finite, not all zero."""
    lists = batch.column("embedding")
    n = len(lists)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    off = lists.offsets.to_numpy().astype(np.int64)
    if lists.values.null_count:
        values[np.asarray(lists.values.is_null())] = np.nan
    sizes = np.diff(off)
    valid = np.asarray(lists.is_valid()) & (sizes > 0)
    wide = int(batch.column("wide")[0].as_py() or 0) if n else 0
    valid &= sizes == wide
    rows = np.flatnonzero(valid)
    raw = values[(off[rows][:, None] + np.arange(wide)[None, :])] if len(rows) else np.zeros((0, wide))
    good = np.isfinite(raw).all(axis=1) & (raw != 0).any(axis=1)
    rows, raw = rows[good], raw[good]
    raw = raw / np.abs(raw).max(axis=1, initial=0, keepdims=True)  # no square overflows or vanishes
    return rows, raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _moments(batches):
    for batch in batches:
        if batch.num_rows:
            _, unit = _unit(batch)
            wide = unit.shape[1]
            sums = np.concatenate([[len(unit)], unit.sum(axis=0), (unit.T @ unit).reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), wide), pa.int32()), pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["wide", "at", "value"])


def principal_axes(vectors: DataFrame, wide: int) -> np.ndarray:
    """Axes by falling variance, from the sums of all vectors; (1 + d + d * d) numbers reach the driver."""
    sums = vectors.mapInArrow(_moments, "wide int, at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    got = np.zeros(1 + wide + wide * wide)
    for r in sums.collect():
        got[r["at"]] = r["value"]
    n = max(got[0], 1.0)
    mean, second = got[1 : wide + 1] / n, got[wide + 1 :].reshape(wide, wide) / n
    variance, axes = np.linalg.eigh(second - np.outer(mean, mean))
    return axes[:, np.argsort(-variance)]


def _projected(axes: np.ndarray, epsilon: float):
    dims = min(GRID_DIMS, axes.shape[1])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, unit = _unit(batch)
            lead = np.zeros((len(rows), GRID_DIMS))
            lead[:, :dims] = unit @ axes[:, :dims]
            cells = np.clip(np.floor(lead[:, :dims] / epsilon) + 64, 0, (1 << CELL_BITS) - 1).astype(np.int64)
            order = np.zeros(len(rows), np.int64)
            for d in range(GRID_DIMS):
                order = (order << CELL_BITS) | (cells[:, d] if d < dims else 0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows, pa.int64())), pa.array(order, pa.int64()), blobs([x.tobytes() for x in unit]), *[pa.array(x) for x in lead.T]], names=["vec_id", "cells", "unit", *LEAD])

    return run


def in_sequence(placed: DataFrame, interval: int) -> DataFrame:
    """Number the intervals ``own`` of the sequence sorted by cells.

    The sort is a range partition; only a count for each partition reaches the driver.
    """
    spark = placed.sparkSession
    dealt = placed.repartitionByRange("cells", "vec_id").sortWithinPartitions("cells", "vec_id")
    dealt = written(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "sequence")
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())
    offsets, before = [], 0
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    first = spark.createDataFrame(offsets or [(0, 0)], "part int, first long")
    return dealt.join(first, "part").select("vec_id", "unit", *LEAD, F.floor((F.col("first") + F.col("at")) / interval).cast("long").alias("own"))


def near_intervals(numbered: DataFrame, epsilon: float) -> DataFrame:
    """(i, j), i <= j: intervals whose boxes on the leading axes are not provably farther apart than ``epsilon``.

    One row for each interval: its box, and the cells as wide as epsilon that it touches on the first axis. Boxes of one cell or of
    neighbours meet, once for the first cell that both touch, and their distance on all leading axes decides before any vector moves.
    """
    bounds = [f(c).alias(f"{name}{k}") for k, c in enumerate(LEAD) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    boxes = written(numbered.groupBy("own").agg(*bounds), "boxes")
    cell = lambda c: F.floor(F.col(c) / epsilon).cast("long")
    placed = boxes.withColumns({"c0": cell("lo0"), "c1": cell("hi0")})
    left = placed.select(*[F.col(c).alias(f"a_{c}") for c in placed.columns], F.explode(F.sequence("c0", "c1")).alias("cell"))
    reach = placed.withColumns({"c0": F.col("c0") - 1, "c1": F.col("c1") + 1})
    right = reach.select(*[F.col(c).alias(f"b_{c}") for c in reach.columns], F.explode(F.sequence("c0", "c1")).alias("cell"))
    gaps = [F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")) for k in range(GRID_DIMS)]
    apart = sum((g * g for g in gaps), F.lit(0.0))
    once = F.col("cell") == F.greatest("a_c0", "b_c0")  # the first cell that both rows have
    met = left.join(right, "cell").filter(once & (F.col("a_own") <= F.col("b_own")) & (apart <= (epsilon + SLACK) ** 2))
    return met.select(F.col("a_own").alias("i"), F.col("b_own").alias("j"))


def _far(a: np.ndarray, b: np.ndarray, epsilon: float) -> bool:
    """Whether the boxes around two parts are provably more than epsilon apart."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return bool((gap * gap).sum() > (epsilon + SLACK) ** 2)


class Links:
    """Counts of links, and edges that connect what the links connect."""

    def __init__(self, n: int):
        self.count, self.label, self.edges = np.zeros(n, np.int64), np.arange(n), []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(self.count, x, 1)
        np.add.at(self.count, y, 1)
        while True:
            open_ = self.label[x] != self.label[y]
            if not open_.any():
                return
            x, y = x[open_], y[open_]
            row = x == x[0]
            others = np.unique(self.label[y[row]], return_index=True)
            self.edges += [(int(x[0]), int(y[row][k])) for k in others[1]]
            merged = np.append(others[0], self.label[x[0]])
            self.label[np.isin(self.label, merged)] = merged.min()


def _join(a, b, same: bool, least: float, epsilon: float, links: Links) -> None:
    """Join two parts of the sequence recursively: halves are skipped where their boxes are too far apart.

    A part is (unit vectors, the same turned to the principal axes, their numbers in ``links``).
    """
    if not len(a[0]) or not len(b[0]) or (not same and _far(a[1], b[1], epsilon)):
        return
    if len(a[0]) <= LEAF and len(b[0]) <= LEAF:
        close = a[0] @ b[0].T >= least
        if same:
            close = np.triu(close, 1)
        x, y = np.nonzero(close)
        if len(x):
            links.add(a[2][x], b[2][y])
        return
    halves = lambda v: [tuple(z[s] for z in v) for s in (slice(None, len(v[0]) // 2), slice(len(v[0]) // 2, None))]
    if same:
        low, high = halves(a)
        _join(low, low, True, least, epsilon, links)
        _join(low, high, False, least, epsilon, links)
        _join(high, high, True, least, epsilon, links)
    elif len(a[0]) >= len(b[0]):
        for part in halves(a):
            _join(part, b, False, least, epsilon, links)
    else:
        for part in halves(b):
            _join(a, part, False, least, epsilon, links)


def _pairs(least: float, epsilon: float, axes: np.ndarray):
    def run(batches):
        """Links of every vector of two intervals (a = b), and edges with 0 links that connect the same vectors."""
        for table, starts in whole_groups(batches, ["i", "j"]):
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                group = table.slice(s, e - s)
                unit = np.frombuffer(text_buffer(group.column("unit"))[0], np.float64).reshape(-1, len(axes))
                ids, own = group.column("vec_id").to_numpy(), group.column("own").to_numpy()
                i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
                links = Links(len(ids))
                turned = unit @ axes
                part = lambda k: (lambda at: (unit[at], turned[at], at))(np.flatnonzero(own == k))
                a = part(i)
                _join(a, a if i == j else part(j), i == j, least, epsilon, links)
                hit = np.flatnonzero(links.count)
                left, right = np.array(links.edges, np.int64).reshape(-1, 2).T
                count = np.concatenate([links.count[hit], np.zeros(len(left), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate([hit, left])]), pa.array(ids[np.concatenate([hit, right])]), pa.array(count)], names=["a", "b", "links"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, interval: int = INTERVAL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Vectors are linked if their cosine, in double precision, is at least ``least``. Null, empty and zero vectors, those
    with null or non-finite components and rows without vec_id link with nothing; vectors of different length
    aren't compared. Rows that repeat a vec_id are vectors of their own in the counts.

    Vectors are turned to principal axes and sorted by cells of a grid on leading axes; cells are as wide as epsilon, the
    distance of unit vectors at that cosine. Intervals of the sequence meet if their boxes on all leading axes are within
    epsilon, which a join of the boxes finds before any vector moves; each pair is joined recursively in one task, and parts whose boxes are more
    than epsilon apart on all axes together are skipped. A tight group becomes counts and a spanning forest there, never all pairs.
    """
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    spark = vectors.sparkSession
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("wide", F.coalesce(F.size("embedding"), F.lit(0)))
    lengths = [r["wide"] for r in plain.filter("wide > 0").groupBy("wide").count().collect()]  # one number for each length that occurs
    facts = spark.createDataFrame([], "a long, b long, links long")
    for wide in sorted(lengths):
        own = plain.filter((F.col("wide") == wide) & F.col("vec_id").isNotNull())
        axes = principal_axes(own, wide)
        placed = own.mapInArrow(_projected(axes, epsilon), ", ".join(["vec_id long", "cells long", "unit binary", *[f"{c} double" for c in LEAD]]))
        numbered = in_sequence(placed, interval)
        near = written(near_intervals(numbered, epsilon), "near")
        members = near.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
        met = numbered.select("own", "vec_id", "unit").join(members.hint("merge"), "own")
        tasks = met.repartition("i", "j").sortWithinPartitions("i", "j", "own")
        facts = facts.unionByName(tasks.mapInArrow(_pairs(least, epsilon, axes), "a long, b long, links long"))
    facts = written(facts, "links")
    counts = facts.filter("links > 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("links").alias("n_links"))
    groups = components(facts.filter("links = 0")).toDF("vec_id", "component")
    out = plain.select("vec_id").join(counts, "vec_id", "left").join(groups, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
