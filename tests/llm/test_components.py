"""Components are found in few rounds: tasks contract their edges first, and stars end the search."""

import random

from candlewick.llm import common


def _want(edges):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_stars_need_no_round(spark):
    edges = [(5, 1), (1, 6), (7, 1), (9, 8), (4, 4), (5, 1)]
    df = spark.createDataFrame(edges, "a long, b long").coalesce(1)
    got = common.components(df, most_rounds=0).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (5, 1), (6, 1), (7, 1), (8, 8), (9, 8)]


def test_chains_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECE_EDGES", 7)
    r = random.Random(3)
    names = r.sample(range(10_000), 400)
    edges = [(a, b) for k, (a, b) in enumerate(zip(names, names[1:])) if k % 50] + [(names[0], names[7])]
    r.shuffle(edges)
    got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()
    assert len(got) == len({x.node for x in got}) and {x.node: x.component for x in got} == _want(edges)
