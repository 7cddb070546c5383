import pytest

import cadence as cd


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")


def test_uniqueness(spark, items):
    assert cd.assert_unique(items, "id") is items
    twice = items.unionByName(items.where("id < 3"))
    assert {(r.id, r.n) for r in cd.duplicate_keys(twice, "id").collect()} == {(1, 2), (2, 2)}
    with pytest.raises(ValueError, match=r"\(1,\)"):
        cd.assert_unique(twice.where("id <> 2"), "id")


def test_remaining_and_complete(items):
    done = items.where("id = 2")
    assert {r.id for r in cd.remaining_items(items, done, "id").collect()} == {1, 3}
    with pytest.raises(ValueError, match="without a result"):
        cd.assert_complete(items, done, "id")
    cd.assert_complete(items, items, "id")


def test_upsert_and_latest(spark, items):
    delta = spark.createDataFrame([(2, "B"), (4, "D")], "id int, v string")
    got = cd.ordered_results(cd.upsert_results(items, delta, "id"), "id")
    assert [tuple(r) for r in got.collect()] == [(1, "a"), (2, "B"), (3, "c"), (4, "D")]
    log = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 5)], "k int, i int")
    assert {tuple(r) for r in cd.keep_latest(log, "k", "i").collect()} == {(1, 6), (1, 7), (1, 8), (2, 5)}
    assert {tuple(r) for r in cd.latest_by_key(log, "k", ["i"]).collect()} == {(1, 8), (2, 5)}


def test_keep_latest_of_many(spark):
    log = spark.range(5000).selectExpr("id % 2 AS k", "id AS i")
    got = cd.keep_latest(log, "k", "i", 1500).collect()
    assert sorted(r.i for r in got) == list(range(2000, 5000))


def test_keep_latest_limits_before_the_shuffle(spark):
    log = spark.range(1000).selectExpr("id % 3 AS k", "id AS i")
    plan = cd.keep_latest(log, "k", "i")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]
