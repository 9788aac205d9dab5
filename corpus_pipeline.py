"""From raw documents to token ids: quality rules, near-duplicates, repeated strings, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next
stage's ``docs``. Nulls, empty and repeated rows pass as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import bpe, minhash, mixing, quality, suffixes
from candlewick.llm.common import dropped, scratch, written

#: Joins that bring texts to decisions are merge joins at every size: the decisions grow with the input.
_KEY = "__key"


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with equal doc_id and text share a key, and so a fate."""
    return docs.withColumn(_KEY, F.xxhash64("doc_id", "text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust distance reject go."""
    keyed = _keyed(docs)
    judged = quality.robust_outliers(quality.text_statistics(keyed, [_KEY, "lang", "source"]))
    gone = judged.filter(~F.col("kept")).select(_KEY).distinct()
    return keyed.join(gone.hint("merge"), _KEY, "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that with the smallest doc_id, and with none if no row has one.

    Texts without words have no duplicates. Rows with equal doc_id and text are one row if they have words.
    """
    keyed = _keyed(docs)
    ids = keyed.select(_KEY, "doc_id").distinct()
    found = minhash.near_duplicates(keyed.select(F.col(_KEY).alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias(_KEY), "component_id", (F.col("n_shingles") > 0).alias("__words")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _KEY, "__words")).alias("first")
    kept = groups.join(ids.hint("merge"), _KEY).groupBy("component_id").agg(first).select(f"first.{_KEY}", "first.__words")
    each = F.when(F.col("__words"), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id())
    return keyed.join(kept.hint("merge"), _KEY).withColumn("__each", each).dropDuplicates([_KEY, "__each"]).select(*docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that an earlier document has are cut out; n_chars follows the text."""
    out = suffixes.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document occurs as often as the mix takes it, not at all, once or twice."""
    keyed = _keyed(docs)
    sized = written(mixing.word_counts(keyed, [_KEY, "source"]).withColumnRenamed(_KEY, "doc_id").distinct(), "sizes")
    copies = mixing.pivotal_copies(sized, mixing.source_targets(sized)).select(F.col("doc_id").alias(_KEY), F.col("source").alias("__source"), F.col("copies").alias("__copies"))
    same = (keyed[_KEY] == copies[_KEY]) & keyed["source"].eqNullSafe(copies["__source"])
    repeated = keyed.join(copies.filter("__copies > 0").hint("merge"), same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row that is left."""
    return bpe.encode_ids(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("source mixing", mix_sources),
    ("BPE encoding", encode),
]
#: Robust estimates, sketches, random rounding and BPE merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is deleted when the next one is written, the tables inside a stage when it ends."""
    raw = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with scratch(spark):
            docs = written(stage(spark, before, sf_dir), name.split()[0].lower(), keep=True)
        if before is not raw:
            dropped(before)
    return docs
