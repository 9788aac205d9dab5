"""Workers give free memory back between tasks, and small tables are few files however many parts Spark deals."""

import os

import pytest

from candlewick.llm import bpe, common, minhash


def _held() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20


@pytest.mark.skipif(common._TRIM is None or not os.path.exists("/proc/self/statm"), reason="the C library can't give memory back")
def test_free_memory_goes_back_at_the_end_of_a_task():
    def work(batches):
        rows = [os.urandom(100_000) for _ in range(2000)]
        pins.append(os.urandom(100_000))
        yield from batches
        del rows

    pins = []
    tasks = common.lean(work)([1, 2])
    assert next(tasks) == 1
    full = _held()
    assert list(tasks) == [2]
    assert full - _held() > 150


def test_tasks_of_the_encoder_are_lean(spark, tmp_path):
    """Every step in Python gives back what it took."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k * 7919 % 100_003}x{j}" for j in range(20_000))) for k in range(8)], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    calls = []
    put = type(docs).mapInArrow
    try:
        type(docs).mapInArrow = lambda self, f, *a, **k: (calls.append(f.__qualname__), put(self, f, *a, **k))[1]
        assert bpe.encode_ids(docs).count() == 8
    finally:
        type(docs).mapInArrow = put
    assert calls and all(c.startswith("lean.") for c in calls)


def test_small_tables_are_few_files(spark, monkeypatch):
    files = {}

    def counted(df, name, *a, put=common.written, **k):
        out = put(df, name, *a, **k)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(common, "written", counted)
    monkeypatch.setattr(minhash, "written", counted)
    monkeypatch.setattr(common, "PIECE_EDGES", 3)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = [(k, " ".join(f"w{k // 2}x{j}" for j in range(60)) + f" end{k}") for k in range(300)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
        assert got == {k: k - k % 2 for k in range(300)}
        chain = common.components(spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long").repartition(8)).collect()
        assert {r.node: r.component for r in chain} == dict.fromkeys(range(201), 0)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    most = spark.sparkContext.defaultParallelism
    rounds = files["edges"][3:]  # the first tables are written by the tasks that find the edges
    assert rounds and max(files["classes"] + rounds) <= most
