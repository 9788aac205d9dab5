"""Quality rules: word statistics of each text, and robust multivariate outliers among them.

``text_statistics`` counts; ``robust_outliers`` fits a minimum-covariance-determinant estimate for each
language and source and rejects the vectors that lie far from it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Rolling, in_files, lean, text_buffer, text_pieces, word_bounds, word_hashes, written

#: Punctuation that counts as a symbol.
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
PIECE = 1 << 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: The statistics that enter the distance.
FEATURES = ("x_length", "x_symbols", "x_dup", "x_repeat")


def _repeated_lines(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def _piece_statistics(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    n = len(off) - 1
    start, end, counts = word_bounds(buf, off)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[off])

    chars = per_text(~SPACE[buf] & ((buf & 0xC0) != 0x80))
    symbols = per_text(SYMBOL[buf])
    raw = buf.tobytes()
    lines = np.array([_repeated_lines(raw[a:b]) for a, b in zip(off[:-1], off[1:])], np.int64).reshape(n, 2)

    doc = np.repeat(np.arange(n), counts)
    repeat = np.zeros(n, np.int64)
    if len(start) >= 3:
        ids = word_hashes(buf, start, end)
        window = Rolling(ids, 2).windows(3)
        at = np.flatnonzero(doc[2:] == doc[:-2])
        window = window[at]
        owner = doc[at]
        order = np.lexsort((window, owner))
        w, d = window[order], owner[order]
        same = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(w), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        cover = np.zeros(len(start), bool)
        for k in range(3):
            cover[hit + k] = True
        repeat = np.bincount(doc[cover], minlength=n)
    return [counts, chars, symbols, lines[:, 0], lines[:, 1], repeat]


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the counts of every whole text: words, code points in words, symbols, lines with a word,
    lines that repeat an earlier one, words in 3-word windows found twice or more. A null text has none."""
    schema = docs.select(*keep).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches):
        for batch in batches:
            for piece in text_pieces(batch, "__text", PIECE):
                found = _piece_statistics(*text_buffer(piece.column("__text")))
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], *[pa.array(x, pa.int64()) for x in found]], names=[*keep, *COUNTS])

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(lean(run), schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _features(stats: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("n_lines", F.lit(1)).cast("double")
    return stats.withColumns({
        "x_length": F.log(F.greatest("word_chars", F.lit(1)).cast("double") / words),
        "x_symbols": F.sqrt(F.col("n_symbols") / words),
        "x_dup": F.sqrt(F.col("n_dup_lines") / lines),
        "x_repeat": F.sqrt(F.col("n_repeat_words") / words),
    })


def _estimates_schema() -> str:
    k = len(FEATURES)
    return "grp string, " + ", ".join([f"m{i} double" for i in range(k)] + [f"p{i}{j} double" for i in range(k) for j in range(i, k)])


def _distance() -> F.Column:
    """Squared Mahalanobis distance of a row to the estimate joined to it."""
    k = len(FEATURES)
    d = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    terms = [d[i] * d[j] * F.col(f"p{i}{j}") * (1.0 if i == j else 2.0) for i in range(k) for j in range(i, k)]
    return sum(terms[1:], terms[0])


def _moments(rows: DataFrame) -> DataFrame:
    k = len(FEATURES)
    aggregates = [F.count("*").alias("n")] + [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    aggregates += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i in range(k) for j in range(i, k)]
    return rows.groupBy("grp").agg(*aggregates)


def _inverted(moments: DataFrame, scale: float, floor: tuple[float, ...]) -> DataFrame:
    """One row of mean and inverse covariance for each group; every variance gets a floor, so that
    statistics that are constant in a group don't make the matrix singular. The floors of repeated lines
    and words are correlated by ``SHARED``."""
    k = len(FEATURES)

    def run(frames):
        for pdf in frames:
            out = {"grp": pdf["grp"]} | {f"m{i}": pdf[f"m{i}"] for i in range(k)}
            cov = np.zeros((len(pdf), k, k))
            for i in range(k):
                for j in range(i, k):
                    cov[:, i, j] = cov[:, j, i] = pdf[f"c{i}{j}"].fillna(0.0) * scale
            least = np.diag(np.square(floor))
            least[2, 3] = least[3, 2] = SHARED * floor[2] * floor[3]
            cov += least
            inverse = np.linalg.inv(cov)
            out |= {f"p{i}{j}": inverse[:, i, j] for i in range(k) for j in range(i, k)}
            yield pd.DataFrame(out)

    return moments.mapInPandas(run, _estimates_schema())


#: Consistency factor of the covariance of the inner 75 % of a 4-variate normal sample: 0.75 / P(chi2(6) <= q), q the 75 % point of chi2(4).
INNER, CONSISTENCY = 0.75, 0.75 / 0.503
#: Smallest standard deviations that count, in units of the transformed statistics.
FLOOR = (0.05, 0.06, 0.12, 0.12)
#: Parts of a group in the joins that bring estimates to rows.
SALTS = 32
#: Correlation of the floors of x_dup and x_repeat: a repeated line repeats its words, so the two aren't separate evidence.
SHARED = 0.5
#: Squared distance beyond which a vector is rejected: chi2(4) exceeds it once in 1000.
CUTOFF = 18.467
#: The estimates have settled when no mean moves by more than this share of its standard deviation and no standard deviation by more than this share of itself.
TOLERANCE = 0.01



def _moved(old: DataFrame, new: DataFrame) -> float:
    """The largest change of a mean or of a standard deviation between two estimates, in standard deviations."""
    k = len(FEATURES)
    was = old.select("grp", *[F.col(f"m{i}").alias(f"n{i}") for i in range(k)], *[F.col(f"p{i}{i}").alias(f"q{i}") for i in range(k)])
    change = [F.abs(F.col(f"m{i}") - F.col(f"n{i}")) * F.sqrt(f"p{i}{i}") for i in range(k)] + [F.abs(F.log(F.col(f"p{i}{i}") / F.col(f"q{i}"))) / 2 for i in range(k)]
    return new.join(was, "grp").agg(F.max(F.greatest(*change))).first()[0] or 0.0


def robust_outliers(stats: DataFrame, most_steps: int = 60, least_group: int = 100, inner: float = INNER, cutoff: float = CUTOFF) -> DataFrame:
    """Add ``base_failed``, ``distance`` (squared Mahalanobis) and ``kept`` to the rows of ``text_statistics``.

    Minimum covariance determinant for each (lang, source), by concentration steps from a robust start
    (medians and median absolute deviations, a deterministic start): each step keeps the ``inner`` share of
    rows nearest to the current estimate and estimates anew from those, until the estimates of all groups
    settle; it is an error if they don't. Groups smaller than
    ``least_group`` are pooled within their language, and what is left over is pooled as a whole. All rows
    enter every step; medians and shares come from Spark's percentile sketches, whose partial results are
    combined before the shuffle, so a hot source costs no more than others. Rows that fail the base rules
    get no verdict from the estimates and don't enter them. Nulls in lang or source are a group of their own.
    """
    rows = _features(stats).withColumn("base_failed", base_failed())
    tag = lambda *cols: F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols])
    rows = written(rows.withColumns({"own": tag("lang", "source"), "pool": tag("lang"), "salt": F.monotonically_increasing_id() % SALTS}), "statistics")
    good = rows.filter(~F.col("base_failed"))
    sizes = good.groupBy("own", "pool").count()
    pools = sizes.groupBy("pool").agg(F.sum(F.when(F.col("count") < least_group, F.col("count"))).alias("rest"))
    names = sizes.join(pools, "pool").select(
        "own", F.when(F.col("count") >= least_group, F.col("own")).when(F.col("rest") >= least_group, F.concat(F.lit("pool:"), "pool")).otherwise("rest").alias("grp"))
    names = written(names, "groups")
    groups = names.count()  # estimates are as many at most

    # named() keeps all rows: a group that has only failed rows has no name and no estimate
    named = rows.join(names, "own", "left")
    inside = named.filter(~F.col("base_failed"))
    k = len(FEATURES)
    # a salt beside the group keeps the rows of a hot group apart in joins, so that aggregates combine them before their shuffle
    salted = lambda table: table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    at = ["grp", "salt"]
    centre = inside.groupBy("grp").agg(*[F.percentile_approx(f, 0.5, 1000).alias(f"m{i}") for i, f in enumerate(FEATURES)])
    spread = inside.join(salted(centre), at).groupBy("grp").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(k)], *[F.pow(1.4826 * F.percentile_approx(F.abs(F.col(f) - F.col(f"m{i}")), 0.5, 1000), 2).alias(f"c{i}{i}") for i, f in enumerate(FEATURES)])
    zero = {f"c{i}{j}": F.lit(0.0) for i in range(k) for j in range(i + 1, k)}
    estimate = written(_inverted(in_files(spread.withColumns(zero), groups), 1.0, FLOOR), "estimate")
    for _ in range(most_steps):
        near = inside.join(salted(estimate), at).withColumn("distance", _distance())
        edge = near.groupBy("grp").agg(F.percentile_approx("distance", inner, 1000).alias("edge"))
        chosen = near.join(salted(edge), at).filter(F.col("distance") <= F.col("edge"))
        before, estimate = estimate, written(_inverted(in_files(_moments(chosen), groups), CONSISTENCY, FLOOR), "estimate")
        if _moved(before, estimate) <= TOLERANCE:
            break
    else:
        raise RuntimeError("robust estimates did not settle")
    judged = named.join(salted(estimate), at, "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return judged.withColumn("kept", kept).drop("own", "pool", "salt", *[f.name for f in estimate.schema if f.name != "grp"])
