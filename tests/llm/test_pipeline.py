"""The pipeline's stages against plain decisions on their own input."""

import pytest
from pyspark.sql.types import StructField, StructType

import corpus_pipeline as pipeline
from candlewick.llm import bpe, minhash, mixing, quality, suffixes
from candlewick.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], data), "test"))
    return out


def test_columns_stay_until_the_last_stage(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1]) and stages[-1].columns == ["doc_id", "n_tokens", "ids"]


def test_each_stage_follows_its_operator(stages):
    raw, good, apart, cut, mix, ids = stages
    verdict = {r.doc_id: r.kept for r in quality.robust_outliers(quality.text_statistics(raw, ["doc_id", "lang", "source"])).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, k in verdict.items() if k}
    kept = {r.doc_id for r in minhash.near_duplicates(good).collect() if r.kept}
    assert {r.doc_id for r in apart.collect()} == kept
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.repeat_digests(apart).collect()}
    for r in cut.collect():
        n, gone = removed[r.doc_id]
        assert n - gone - 6 <= len(r.text.encode()) <= n - gone and r.n_chars == len(r.text)
    sizes = {r.doc_id: (r.source, len(r.text.split())) for r in cut.collect()}
    copies = {}
    for r in mix.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 2
    for source in {s for s, _ in sizes.values()}:
        own = {d: n for d, (s, n) in sizes.items() if s == source}
        target = next(r.target for r in mixing.mixed(cut).filter(f"source = '{source}'").limit(1).collect())
        assert abs(sum(copies.get(d, 0) * n for d, n in own.items()) - target) <= max(own.values())
    texts = {r.doc_id: r.text for r in mix.collect()}
    tokenizer, _ = bpe._tokenizer(bpe.default_tokenizer())
    rows = ids.collect()
    assert len(rows) == mix.count() and all(list(r.ids) == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows)


def test_rows_with_nulls_and_clashing_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40).selectExpr("*", "'x' as copies", "1 as size", "'y' as kept")
    odd = spark.createDataFrame([(None, None, None, None, None, "x", 1, "y"), (10**9, None, None, None, None, None, None, None), (10**9, "", "en", "s", 0, "x", 1, "y")], StructType([StructField(f.name, f.dataType) for f in docs.schema]))
    out = docs.unionByName(odd).unionByName(docs.limit(3))
    for _, stage in pipeline.STAGES:
        out = written(stage(spark, out, data), "test")
    assert out.count() > 0
    empty = docs.filter("false")
    for _, stage in pipeline.STAGES:
        empty = written(stage(spark, empty, data), "test")
    assert empty.count() == 0


def test_near_duplicates_without_ids(spark):
    other = " ".join(f"o{k}" for k in range(60))
    third = " ".join(f"t{k}" for k in range(60))
    rows = [(None, other), (None, other + " end"), (None, other), (7, third), (None, third), (7, third), (None, None), (None, None), (9, "")]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert len([r for r in got if r.text and r.text.startswith("o0")]) == 1
    assert [r.doc_id for r in got if r.text and r.text.startswith("t0")] == [7]
    assert len([r for r in got if not r.text]) == 3


@pytest.mark.parametrize("percent", [60, 80])
def test_pairs_at_the_least_similarity_are_found(spark, percent):
    rows = []
    for p in range(200):
        words = [f"p{p}w{k}" for k in range(304)]  # 300 shingles, and the same with the first n words changed
        n = next(n for n in range(300, -1, -1) if 100 * (300 - n) >= percent * (300 + n))
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(f"c{w}" if k < n else w for k, w in enumerate(words)))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)
