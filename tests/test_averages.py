import random

import pytest
from pyspark.sql import functions as F

import cadence as cd


def test_group_mean(spark):
    rows = [(1, 0, 1.0, 1.0), (1, 1, 3.0, 1.0), (1, 2, 5.0, 2.0), (2, 0, 2.0, 0.0),
            (3, 0, None, 4.0), (3, 1, 8.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, i int, v double, w double")
    out = df.groupBy("k").agg(
        cd.weighted_mean("v", "w").alias("avg"), cd.last_value("v", "i").alias("last"),
        cd.weighted_summary("v", "w", ["i"]).alias("s"),
    )
    got = {r.k: r for r in out.collect()}
    assert (got[1].avg, got[1].last) == (3.5, 5.0)
    assert got[1].s.asDict() == {"last": 5.0, "avg": 3.5, "sum": 14.0, "count": 4.0}
    assert (got[2].avg, got[2].last) == (None, 2.0)
    assert got[3].avg == 8.0
    assert df.where("false").agg(cd.weighted_mean("v").alias("a")).first().a is None


@pytest.mark.parametrize("coalesced", [True, False])
def test_running_mean(spark, coalesced):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, float(rng.randrange(100)) if rng.random() > 0.1 else None,
             float(rng.randrange(3))) for i in range(800)]
    df = spark.createDataFrame(rows, "k int, i int, v double, w double").repartition(6)
    out = cd.running_weighted_mean(df, "v", "w", ["k"], ["i"])
    assert out.columns == ["k", "i", "v", "w", "avg"]
    sums, want = {}, {}
    for k, i, v, w in rows:
        total, weight = sums.get(k, (0.0, 0.0))
        if v is not None:
            total, weight = total + v * w, weight + w
        sums[k] = total, weight
        want[i] = total / weight if weight else None
    got = {r.i: r.avg for r in out.collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_running_mean_golden(spark):
    df = spark.createDataFrame([(0, 1.0, 1), (1, 3.0, 1), (2, 5.0, 2)], "i int, v double, w int")
    out = cd.running_weighted_mean(df.withColumn("k", F.lit(1)), "v", "w", ["k"], ["i"])
    assert [r.avg for r in out.orderBy("i").collect()] == [1.0, 2.0, 3.5]
