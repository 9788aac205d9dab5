"""What one task reads where few keys have many rows, and that results stay those of plain loops."""

import datetime as dt
import random

import pytest

from candlewick.operators import alerts, names

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def dealt(spark):
    """Small tables in as many tasks as large ones."""
    put = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def most_read(spark, run):
    """What ``run`` returns, and the most rows that one task read from a shuffle meanwhile."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return [(s.stageId(), s.attemptId()) for s in (found.apply(k) for k in range(found.size()))]

    before = max([s for s, _ in stages()], default=-1)
    out, most = run(), 0
    for stage, attempt in stages():
        if stage > before:
            tasks = sc.statusStore().taskList(stage, attempt, 100_000)
            for m in (tasks.apply(k).taskMetrics() for k in range(tasks.size())):
                most = max(most, m.get().shuffleReadMetrics().recordsRead() if m.isDefined() else 0)
    return out, most


def _fires(kind, target, percent, price, previous):
    change = None if not previous else (price - previous) / previous * 100
    return {"ABOVE": lambda: price > target, "BELOW": lambda: price < target, "CROSSES_ABOVE": lambda: previous is not None and previous <= target < price, "CROSSES_BELOW": lambda: previous is not None and previous >= target > price,
            "PERCENT_CHANGE_UP": lambda: change is not None and percent is not None and change >= percent, "PERCENT_CHANGE_DOWN": lambda: change is not None and percent is not None and change <= -percent}[kind]()


@pytest.mark.parametrize("step", [0.3, 40.0])
def test_alerts_of_one_symbol_are_many_tasks(spark, dealt, step):
    r = random.Random(step)
    price, ticks = 50.0, []
    for k in range(3000):
        price = round(min(max(price + r.uniform(-step, step), 1.0), 99.0), 2)
        ticks.append(("A", T0 + dt.timedelta(minutes=k // 2), k, price))
    ticks += [("B", T0, 9000, 5.0), (None, T0, 9001, 5.0)]
    kinds = ("ABOVE", "BELOW", "CROSSES_ABOVE", "CROSSES_BELOW", "PERCENT_CHANGE_UP", "PERCENT_CHANGE_DOWN")
    asked = [(f"a{n}", "A", kinds[n % 6], round(r.uniform(-5, 105), 1), r.choice([None, 0.5, 5.0, 80.0]), r.choice(["active", "active", "off"]), r.choice([None, T0 + dt.timedelta(minutes=700)])) for n in range(240)]
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp, tick_id long, price double").repartition(4)
    rules = spark.createDataFrame(asked, "alert_id string, symbol string, condition string, target_price double, percent_change double, status string, expires_at timestamp")
    got, most = most_read(spark, lambda: alerts.triggered(rules, df).collect())
    want = {}
    for a, symbol, kind, target, percent, status, expires in asked:
        previous = None
        for s, ts, _, price in ticks:
            if s != symbol or status != "active":
                continue
            if _fires(kind, target, percent, price, previous) and (expires is None or ts < expires):
                want[a] = (ts, price, previous)
                break
            previous = price
    assert {x.alert_id: (x.ts, x.price, x.previous_price) for x in got} == want and len(want) > 50
    assert most < 2000 or step < 1  # of 3,000 ticks; small moves are all kept where no move crosses a part as a whole


def test_names_move_neither_texts_nor_their_grams(spark, dealt):
    r = random.Random(4)
    texts = [(k, "".join(r.choice("abcdefgh ") for _ in range(600))) for k in range(300)]
    wanted = ["customer#%09d" % k for k in range(300)] + [texts[7][1][5:40], "bad"]
    df, asked = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in wanted], "name string")
    got, most = most_read(spark, lambda: names.contained(df, "id", "text", asked, most=0).collect())
    assert {(x.id, x.name) for x in got} == {(k, w) for k, t in texts for w in wanted if w in t}
    assert most < 2000  # all their grams are 180,000


def test_few_names_need_no_python(spark):
    df = spark.createDataFrame([(1, "a name"), (2, None)], "id long, text string")
    found = names.found_by_automaton(df, "id", "text", ["name", "x"])
    assert [(x.id, x.name) for x in found.collect()] == [(1, "name")] and "Python" not in found._jdf.queryExecution().executedPlan().toString()
