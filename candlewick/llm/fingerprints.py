"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, and how like two of them are.

Everything here is DataFrame functions. A sketch is a table of cells in three rows of equal width; each paragraph's digest
adds to one cell of each row its count, itself (by exclusive or) and a check value. Subtracting two sketches cell by
cell leaves the paragraphs that only one text has. A cell that holds one of them alone tells which it is, and that one can
be taken out of its other cells, until none is left; where cells stay, the pair is tried again with larger sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Paragraphs are lines, cut after each sentence, since many documents are one line.
PARAGRAPH = r"\n|(?<=[.!?]) "
#: Rows of a sketch, and cells of each row in the fingerprint that is returned; what differs is found with wider ones of both texts.
ROWS, WIDTH = 3, 8
#: A pair's sketches have SPARE cells for each paragraph of both texts at the first try, LEAST in each row at least, and each later try MORE times as many.
SPARE, LEAST, MORE = 1.6, 48, 4
#: Times that lone paragraphs are taken out before a pair counts as failed, and tries before the job fails.
PEELS, TRIES = 8, 12
#: Digests whose cells a task holds at a time, and tasks at most; more than these spill.
DIGESTS, MOST_TASKS = 100_000, 100_000


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, without surrounding spaces; empty ones don't count."""
    pieces = F.filter(F.transform(F.split(text, PARAGRAPH), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(pieces, lambda x: F.xxhash64(x)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _places(digest: Column, width: Column) -> list[Column]:
    """The cell of ``digest`` in each row of a sketch."""
    return [width * r + F.pmod(F.xxhash64(digest, F.lit(r)), width) for r in range(ROWS)]


def cells(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, cell, n, digest, check): the sketch of each key from ``rows`` (keys, width, digest, n); n = -1 subtracts.

    Cells that hold nothing are left out.
    """
    placed = rows.select(*keys, F.explode(F.array(*_places(F.col("digest"), F.col("width")))).alias("cell"), "n", "digest", _check(F.col("digest")).alias("check"))
    return _summed(placed, *keys)


def _summed(placed: DataFrame, *keys: str) -> DataFrame:
    sums = placed.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"))
    return sums.filter("n <> 0 OR digest <> 0 OR check <> 0")


#: Cells that count the paragraphs found of the first and of the second text, beside those of the sketch.
_LEFT, _RIGHT = -1, -2
#: What names a pair's sketch: ``first`` of row k and the side of it that is compared.
_PAIR = ("k", "side", "width")


def _peeled(sketch: DataFrame) -> DataFrame:
    """Take every paragraph that is alone in a cell out of the sketches ``(k, side, width, cell, n, digest, check)`` and count it.

    A paragraph alone in several cells tells its removal several times; these tellings are equal and count once.
    All steps group by k among others, so rows stay where they are.
    """
    cell = F.col("cell")
    alone = (cell >= 0) & F.abs("n").eqNullSafe(1) & (F.col("check") == _check(F.col("digest")))
    entry = lambda cell, n, digest, check, told: F.struct(cell.cast("long").alias("cell"), n.cast("long").alias("n"), digest.alias("digest"), check.alias("check"), F.lit(told).alias("told"))
    zero = F.lit(0).cast("long")
    own = entry(cell, F.col("n"), F.col("digest"), F.col("check"), 0)
    removals = [entry(p, -F.col("n"), F.col("digest"), F.col("check"), 1) for p in _places(F.col("digest"), F.col("width"))]
    found = entry(F.when(F.col("n") > 0, _LEFT).otherwise(_RIGHT), F.lit(1), F.col("digest"), zero, 1)
    rows = sketch.select(*_PAIR, F.explode(F.when(alone, F.array(own, *removals, found)).otherwise(F.array(own))).alias("e")).select(*_PAIR, "e.*")
    once = rows.groupBy(*_PAIR, "cell", "n", "digest", "check", "told").agg(F.lit(0).alias("x")).drop("x", "told")
    counted = once.withColumn("digest", F.when(F.col("cell") < 0, zero).otherwise(F.col("digest")))
    return _summed(counted, *_PAIR)


def _parts(texts: DataFrame, size: Column) -> int:
    """Tasks for rows that hold ``size`` digests each."""
    total = texts.agg(F.sum(size.cast("long"))).first()[0] or 0
    return min(max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // DIGESTS)), MOST_TASKS)


def compared(texts: DataFrame, spare: float = SPARE) -> DataFrame:
    """(k, side, differ): how many paragraphs only one text has, of each pair of ``first`` and an entry of ``others``.

    ``texts`` is (k, first, others): digests, and an array of such arrays; k is unique. Sketches fit the paragraphs of both texts at first;
    pairs that fail, since a cell holds several to the end, are tried again with larger ones. A pair without any difference may have no row.
    """
    sizes = F.aggregate("others", F.size("first"), lambda n, x: n + F.size(x))
    rows, out = texts.withColumn("sides", F.when(F.size("others") > 0, F.sequence(F.lit(0), F.size("others") - 1))), None
    rows = rows.repartition(_parts(texts, sizes), "k")
    for attempt in range(TRIES):
        pairs = rows.select("k", "first", F.explode("sides").alias("side"), "others").withColumn("second", F.get("others", F.col("side")))
        width = F.greatest(F.lit(LEAST), F.ceil((F.size("first") + F.size("second")) * (spare / ROWS))) * MORE**attempt
        signed = F.array(F.struct(F.lit(1).alias("n"), F.col("first").alias("digests")), F.struct(F.lit(-1).alias("n"), F.col("second").alias("digests")))
        pairs = pairs.select("k", "side", width.cast("int").alias("width"), F.explode(signed).alias("s"))
        sketch = cells(pairs.select(*_PAIR, "s.n", F.explode("s.digests").alias("digest")), *_PAIR)
        for _ in range(PEELS):
            sketch = _peeled(sketch)
        left = F.sum(F.when(F.col("cell") >= 0, 1).otherwise(0))
        found = F.sum(F.when(F.col("cell") < 0, F.col("n")).otherwise(0))
        tried = written(sketch.groupBy("k", "side").agg((left > 0).alias("failed"), found.alias("differ")), "tried")
        done = tried.filter("NOT failed").select("k", "side", "differ")
        out = done if out is None else out.unionByName(done)
        if tried.filter("failed").isEmpty():
            return out
        failed = tried.filter("failed").groupBy("k").agg(F.collect_set("side").alias("sides"))
        rows = texts.join(failed, "k").repartition("k")  # few: Spark sends them to the texts if they are small, and only their texts move
    raise RuntimeError("sketches did not peel")


def sketch_texts(texts: DataFrame) -> DataFrame:
    """(k, side, sketch): the fingerprints of ``first`` (side -1) and ``others`` (0 and on) as text: cell:count:digest:check, all but the cell in hexadecimal."""
    each = F.transform(F.concat(F.array("first"), F.col("others")), lambda x, i: F.struct((i - 1).alias("side"), x.alias("digests")))
    sides = texts.select("k", F.explode(each).alias("s")).select("k", "s.side", F.lit(WIDTH).alias("width"), F.lit(1).alias("n"), F.explode("s.digests").alias("digest"))
    cell = F.struct("cell", F.format_string("%d:%x:%x:%x", "cell", "n", "digest", "check").alias("text"))
    return cells(sides, "k", "side").groupBy("k", "side").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["text"])).alias("sketch"))


_KEY = ("none", "id", "h")


def _sequence(docs: DataFrame) -> DataFrame:
    """(none, id, h, n, copies, k, before, before_n): the distinct documents in order of doc_id, numbered, with the key and length of the one
    before; the last comes before the first.

    Rows are dealt by range of (doc_id, hash), so a doc_id that many rows have is not one task; only the first and last row of each part are looked at together.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    ids = ids.repartitionByRange(parts, *_KEY).select(F.struct(*_KEY).alias("at"), "copies", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("k"))
    ids = written(ids, "numbered")
    own = Window.partitionBy("part").orderBy("at")
    end = F.struct("at", "n")
    ends = ids.groupBy("part").agg(F.max(end).alias("last"))
    every = Window.orderBy("part")  # one row for each part
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = ends.select("part", F.coalesce(F.lag("last").over(every), F.last("last").over(whole)).alias("prior"))
    inside = ids.withColumn("behind", F.lag(end).over(own)).join(edges, "part").withColumn("behind", F.coalesce("behind", "prior"))
    return written(inside.select("at.*", "n", "copies", "k", F.col("behind.at").alias("before"), F.col("behind.n").alias("before_n")), "sequence")


def edited_documents(docs: DataFrame) -> DataFrame:
    """(k, id, copies, n, edited_sha256, own, edited, next, n_next): distinct documents with the digests of their paragraphs, of their edited text's and of the next document's.

    The last half of a text's code points (rounded down) is replaced by as many from the start of the next document, or all it has. Texts move
    once to meet their place in the sequence, and the start that the document before takes moves on to it, with the digests.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), text.alias("text")).withColumn("h", F.sha2("text", 256))
    sequence = _sequence(rows.withColumn("n", F.length("text"))).hint("merge")
    whole = rows.groupBy(*_KEY).agg(F.first("text").alias("text"))
    heads = whole.join(sequence, [*_KEY]).select("before.*", F.expr("left(text, CAST(floor(before_n / 2) AS INT))").alias("head"), paragraphs(F.col("text")).alias("next"))
    both = whole.join(sequence.drop("before", "before_n"), [*_KEY]).join(heads.hint("merge"), [*_KEY])
    both = both.withColumn("edited_text", F.concat(F.expr("left(text, n - CAST(floor(n / 2) AS INT))"), "head"))
    return both.select("k", F.when(~F.col("none"), F.col("id")).alias("id"), "copies", "n", F.sha2("edited_text", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited_text")).alias("edited"), "next", F.size("next").alias("n_next"))


def _likeness(paragraphs_: Column, differ: Column) -> Column:
    """Common paragraphs as a share of all that either text has, from how many both have together and what the sketches say differs; two texts without any are alike."""
    return F.coalesce(F.try_divide((paragraphs_ - differ).cast("double"), (paragraphs_ + differ).cast("double")), F.lit(1.0))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs`` (doc_id, text).

    A null text is empty; an empty text has the empty fingerprint and is like another empty one alone. A null doc_id comes last. Rows with one doc_id follow each other by the
    SHA-256 of their texts; rows equal in both are one document, of which each copy is returned. A document that is alone is
    the next one of itself. Digests and check values have 64 bits each. Other columns are ignored; no rows give none.
    """
    edited = written(edited_documents(docs), "edited")
    texts = edited.select("k", F.col("own").alias("first"), F.array("edited", "next").alias("others"))
    each = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("differ"))), F.lit(0).cast("long"))
    likes = compared(texts).groupBy("k").agg(each(0).alias("edited_differ"), each(1).alias("next_differ"))
    dealt = edited.drop("next").repartition(_parts(edited, F.size("own") + F.size("edited")), "k")
    named = lambda text: F.coalesce(F.max(F.when(F.col("side") == text, F.col("sketch"))), F.lit("")).alias
    prints = sketch_texts(dealt.select("k", F.col("own").alias("first"), F.array("edited").alias("others"))).groupBy("k").agg(named(-1)("fingerprint"), named(0)("edited_fingerprint"))
    narrow = edited.select("k", "id", "copies", "n", "edited_sha256", F.size("own").alias("n_own"), F.size("edited").alias("n_edited"), "n_next")
    out = prints.hint("merge").join(narrow.join(likes.hint("merge"), "k", "left").hint("merge"), "k", "right")
    none = F.lit(0).cast("long")
    rows = out.select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        _likeness(F.col("n_own") + F.col("n_edited"), F.coalesce("edited_differ", none)).alias("near_edited"), _likeness(F.col("n_own") + F.col("n_next"), F.coalesce("next_differ", none)).alias("near_next"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.drop("copy")
