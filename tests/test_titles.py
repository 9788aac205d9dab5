"""Similar titles against a plain loop, in blocks, and that no task keeps the pairs it has seen; the start of a text that titles are made of."""

import random

from pyspark.sql import functions as F

from candlewick import queries
from candlewick.operators import text


def test_similar_titles_of_blocks_equal_a_loop(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(9)]
    titles = [(k, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for k in range(150)] + [(900, None), (901, "  "), (902, "alone"), (903, "W1 w2")]
    df = spark.createDataFrame(titles, "article_id long, title string").repartition(3)
    first = {}
    for k, t in titles:
        if (s := frozenset((t or "").lower().split())) and (s not in first or k < first[s]):
            first[s] = k
    want = {(a, b): len(s & t) / len(s | t) for s, a in first.items() for t, b in first.items() if a < b and len(s & t) / len(s | t) >= 0.8}
    for block in (4, 1000):
        out = text.similar_titles(df, block=block)
        got = out.collect()
        assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want)
        assert "keys=[a#" not in out._jdf.queryExecution().toString()  # each pair is met once, so none is remembered
    assert text.similar_titles(df.filter("false")).count() == 0


def test_titles_are_the_first_ten_words(spark, tmp_path):
    texts = [None, "", " ", "one", "\n two\twords ", "a  b c d\r\ne f g h i j k l", "x" * 30000, " y" * 10 + "\n", "z " * 11]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' source").write.parquet(f"{tmp_path}/documents.parquet")
    whole = F.trim(F.regexp_extract(F.regexp_replace("description", r"\s+", " "), r"^ ?((?:[^ ]+ ?){0,10})", 1))
    rows = queries.articles(spark, str(tmp_path)).select("article_id", "title", whole.alias("want")).collect()
    assert len(rows) == len(texts) and all(r.title == r.want for r in rows)
