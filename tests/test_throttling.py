import random
from datetime import datetime, timedelta

import pytest

import cadence as cd
from cadence.functions.steps import step_spec


def greedy(rows, spec, seconds, iters, reset_index):
    """Row-at-a-time definition: ids that fire for one key's (micros, id) rows."""
    parsed, last_i, last_t, out = step_spec(spec), -1, None, []
    for i, (t, ident) in enumerate(sorted(rows)):
        fires = bool(parsed.fires_at(i))
        if iters is not None:
            fires |= i - last_i >= iters
        if seconds is not None:
            fires |= last_t is None or t - last_t >= seconds * 1_000_000
        if fires:
            out.append(ident)
            last_t = t
            if reset_index:
                last_i = i
    return out


def sample(seed, size=900):
    rng = random.Random(seed)
    rows, now = [], 0
    for ident in range(size):
        now += rng.choice([0, 0, 1, 3, 10, 400]) * 1_000_000 + rng.randrange(3)
        rows.append((rng.choice([None, 7, 7, 7, 8, 9]), now, ident))
    return rows


CASES = [
    dict(seconds=60.0), dict(seconds=0.5), dict(seconds=100_000.0), dict(iters=4),
    dict(step_spec="2,3::10"), dict(step_spec="2,3:20,60:10", iters=3),
    dict(step_spec="::6", iters=4, reset_index=False), dict(seconds=45.0, iters=5),
    dict(seconds=300.0, iters=9, step_spec="1::20"), dict(seconds=30.0, step_spec="::13"),
    dict(seconds=200.0, iters=50, reset_index=False),
]


@pytest.mark.parametrize("limit, block", [(None, None), (100, 16), (100, 1000)])
@pytest.mark.parametrize("case", CASES, ids=str)
def test_against_the_definition(spark, case, limit, block, monkeypatch):
    if block:
        monkeypatch.setattr("cadence.operators.throttling.BLOCK_ROWS", block)
    rows = sample(len(str(case)))
    zero = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(k, zero + timedelta(microseconds=t), i) for k, t, i in rows],
        "k long, ts timestamp_ntz, id long",
    ).repartition(5)
    out = cd.throttle(df, "k", "ts", ["id"], max_key_rows=limit, **case)
    assert out.columns == ["k", "ts", "id"]
    by_key = {}
    for k, t, i in rows:
        by_key.setdefault(k, []).append((t, i))
    want = [
        i for group in by_key.values()
        for i in greedy(group, case.get("step_spec", "::"), case.get("seconds"),
                        case.get("iters"), case.get("reset_index", True))
    ]
    assert sorted(r.id for r in out.collect()) == sorted(want)


def test_many_small_keys_cross_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, float(t * 10), k * 100 + t) for k in range(40) for t in range(k % 11)]
        df = spark.createDataFrame(rows, "k long, t double, id long")
        got = sorted(r.id for r in cd.throttle(df, "k", "t", seconds=25).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(i for k, t, i in rows if t % 30 == 0)


@pytest.mark.parametrize("limit", [None, 5])
@pytest.mark.parametrize("key", [
    "double('NaN')", "CAST(NULL AS DOUBLE)", "named_struct('a', 1, 'b', double('NaN'))",
    "IF(id % 2 = 0, 0.0D, -0.0D)",
])
def test_odd_keys_are_one_key_on_either_path(spark, key, limit):
    df = spark.range(40).selectExpr(f"{key} AS k", "id * 1000.0D AS t", "id")
    got = cd.throttle(df, "k", "t", seconds=3000, max_key_rows=limit).collect()
    assert sorted(r.id for r in got) == list(range(0, 40, 3))


def test_rows_without_a_time_never_fire(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 5.0, 2)], "k int, t double, id int")
    assert [r.id for r in cd.throttle(df, "k", "t", seconds=1).collect()] == [2]


def test_other_kinds_of_time(spark):
    days = spark.range(9).selectExpr(
        "1 AS k", "date_add(DATE'2024-01-01', cast(id AS int)) AS d",
        "timestamp_seconds(id * 86400) AS z", "id * 86400 AS n", "id"
    )
    for time in ("d", "z", "n"):
        got = cd.throttle(days, "k", time, seconds=3 * 86400).collect()
        assert sorted(r.id for r in got) == [0, 3, 6], time


def test_wall_clock_times_ignore_the_session_zone(spark):
    hours = [datetime(2024, 3, 10, h, 30) for h in (1, 2, 3, 4)]
    df = spark.createDataFrame([(1, h) for h in hours], "k int, t timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted(r.t for r in cd.throttle(df, "k", "t", seconds=7200).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [hours[0], hours[2]]


def test_bad_settings(spark):
    df = spark.createDataFrame([(1, 5.0)], "k int, t double")
    for bad in (dict(seconds=0), dict(iters=0), dict(step_spec="::0")):
        with pytest.raises(ValueError):
            cd.throttle(df, "k", "t", **bad)
