"""Hot-key forms give the rows of the plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from tollgate.operators import audit, config, handshake, monitoring, ordered
from tollgate.plans.views import pair_turns


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = []
    for n in range(3000):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None, "c"])
        value = None if rng.random() < 0.1 else float(rng.randint(0, 40))
        rows.append((key, rng.randint(0, 200), n, value))
    df = spark.createDataFrame(rows, "key string, t int, id int, value double").repartition(5)
    return df.cache()


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)

    def rows(df):
        listed = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()]
        return sorted(listed, key=repr)

    assert rows(left) == rows(right)


HOT = {"max_group_rows": 10}


def test_lag_and_lead(events):
    def near(df, w):
        return df.withColumns({"prev": F.lag("id").over(w), "next": F.lead("id").over(w)})

    plain = ordered.over_order(events, ["key"], ["t", "id"], near, before=1, after=1)
    hot = ordered.over_order(events, ["key"], ["t", "id"], near, before=1, after=1, block_rows=7, **HOT)
    same(plain, hot)


@pytest.mark.parametrize("block", [20, 64])
def test_rolling_frames(events, block):
    plain = monitoring.rolling(events, ["key"], ["t", "id"], 20)
    hot = monitoring.rolling(events, ["key"], ["t", "id"], 20, block_rows=block, **HOT)
    same(plain, hot)


def test_numbering(events):
    same(
        ordered.numbered(events, ["key"], ["t", "id"], "no"),
        ordered.numbered(events, ["key"], ["t", "id"], "no", **HOT),
    )


def test_carry_forward(events):
    same(
        ordered.carried_forward(events, ["key"], ["t", "id"], ["value"]),
        ordered.carried_forward(events, ["key"], ["t", "id"], ["value"], **HOT),
    )


def test_exact_quantile(events):
    rows = events.filter("key IS NOT NULL")
    expected = {
        r["key"]: r["q"] for r in rows.groupBy("key").agg(F.percentile("value", 0.9).alias("q")).collect()
    }
    for limits in ({}, HOT):
        got = monitoring.exact_quantiles(rows, "key", 0.9, "id", **limits)
        assert {r["key"]: round(r["quantile"], 9) for r in got.collect()} == {
            k: round(v, 9) for k, v in expected.items()
        }


def test_replays_with_a_hot_token(events):
    uses = events.filter("key IS NOT NULL").select(F.col("key").alias("token"), F.col("t").alias("ts"), F.col("id").alias("log_id"))
    assert handshake.replays(uses).count() == uses.count() - uses.select("token").distinct().count()


def test_gaps_and_pairs_with_hot_keys(spark, events):
    log = events.withColumn("ts", F.timestamp_seconds(F.col("t") * 1000))
    same(audit.log_gaps(log, "key", ["ts", "id"], 500), audit.log_gaps(log, "key", ["ts", "id"], 500, block_rows=3, **HOT))
    turns = spark.createDataFrame(
        [(1, n, "user" if n % 3 else "assistant", f"t{n}") for n in range(40)], "conv_id long, turn long, role string, text string"
    )
    same(pair_turns(turns), pair_turns(turns, block_rows=4, **HOT))


def test_config_in_force(spark):
    metrics = spark.createDataFrame([("m", t, t * 10) for t in range(0, 100)], "metric string, ts int, row_id long")
    versions = spark.createDataFrame([("m", 20, 1, 0.5), ("m", 60, 2, 0.7)], "metric string, ts int, version_id long, threshold double")
    for limits in ({}, {"max_versions": 0}, {"max_versions": 0} | HOT):
        found = config.in_force(metrics, versions, "metric", "threshold", **limits)
        got = {r["ts"]: r["threshold"] for r in found.collect()}
        assert got[19] is None and got[20] == 0.5 and got[59] == 0.5 and got[60] == 0.7 and len(got) == 100


def test_config_in_force_forms_agree(spark):
    rng = random.Random(6)
    metrics = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(30)]), i) for i in range(400)]
    versions = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), i, rng.choice([None, float(i)])) for i in range(60)]
    m = spark.createDataFrame(metrics, "metric string, ts int, row_id long")
    v = spark.createDataFrame(versions, "metric string, ts int, version_id long, threshold double")
    near, far = config.in_force(m, v, "metric", "threshold"), config.in_force(m, v, "metric", "threshold", max_versions=0)
    same(near, far)
    plan = near._jdf.queryExecution().executedPlan().toString()
    probe = plan[plan.index("BroadcastHashJoin") :].split("BroadcastExchange")[0]
    assert "Exchange" not in probe  # metrics stay where they are
    assert config.in_force(m, v.limit(0), "metric", "threshold").filter("threshold IS NOT NULL").count() == 0


@pytest.mark.parametrize("limit", [1, 50, 10**6])
def test_quantiles_by_selection(spark, monkeypatch, limit):
    monkeypatch.setattr(monitoring, "SKETCH", 20)
    rng = random.Random(7)
    rows = [("hot", float(rng.randrange(3000))) for _ in range(5000)] + [("same", 4.0)] * 700 + [("ties", float(rng.choice([1, 2, 2, 2, 9]))) for _ in range(900)]
    rows += [("one", 3.5), ("two", 1.0), ("two", 2.0), (None, 5.0), (None, 6.0), ("gone", None)] + [("skew", rng.random() ** 9) for _ in range(2000)]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "key string, value double, id long").repartition(6)
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        want = {r["key"]: round(r["q"], 9) for r in df.filter("value IS NOT NULL").groupBy("key").agg(F.percentile("value", q).alias("q")).collect()}
        got = {r["key"]: round(r["quantile"], 9) for r in monitoring.exact_quantiles(df, "key", q, "id", max_group_rows=limit).collect()}
        assert got == want, q
