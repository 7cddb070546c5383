import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import cadence as cd
from cadence.operators.ordering import batch_bounds


@pytest.mark.parametrize("n, size, sizes", [
    (10, 3, [3, 3, 2, 2]), (9, 3, [3, 3, 3]), (1, 5, [1]), (11, 5, [4, 4, 3]), (0, 3, []),
])
def test_balanced_batches(spark, n, size, sizes):
    rows = cd.balanced_batches(spark.range(n).repartition(3), "id", size, index="i").collect()
    assert all(r.i == r.id for r in rows)
    counted = Counter(r.batch_id for r in rows)
    assert [counted[b] for b in sorted(counted)] == sizes
    assert [b - a for a, b in batch_bounds(n, size)] == sizes
    ordered = [r.batch_id for r in sorted(rows, key=lambda r: r.id)]
    assert ordered == sorted(ordered)


def test_batch_bounds_match_numpys_split():
    for n in range(1, 120):
        for size in range(1, 25):
            split = np.array_split(np.arange(n), (n - 1) // size + 1)
            assert [list(range(a, b)) for a, b in batch_bounds(n, size)] == [list(s) for s in split]


def test_dense_index_is_a_permutation_in_order(spark):
    rng = random.Random(3)
    values = [(rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(values, "a long, b long").repartition(7)
    rows = cd.dense_index(df, [F.col("a").desc(), "b"]).collect()
    want = sorted(values, key=lambda v: (-v[0], v[1]))
    assert [(r.a, r.b) for r in sorted(rows, key=lambda r: r.idx)] == want
    assert sorted(r.idx for r in rows) == list(range(3000))


def test_dense_index_has_no_single_task_window_over_the_rows(spark):
    plan = cd.dense_index(spark.range(1000), "id").explain
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()) as shown:
        plan()
    text = shown.getvalue()
    above_windows = text[: text.index("Window")]
    assert "BroadcastHashJoin" in above_windows
    assert "HashAggregate" in text[text.index("Window"):]


@pytest.fixture(params=[True, False], ids=["small", "spread"])
def partitions(spark, request):
    """Small tables in one partition, or spread, so that keys go on from one to the next."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, request.param)
    yield
    spark.conf.unset(name)


def test_key_index_with_hot_and_null_keys(spark, partitions):
    rng = random.Random(11)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice("xy"), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, s string, i long").repartition(5)
    got = cd.key_index(df, ["k", "s"], ["i"], "pos").collect()
    seen, want = Counter(), {}
    for k, s, i in rows:
        want[i] = seen[k, s]
        seen[k, s] += 1
    assert {r.i: r.pos for r in got} == want


def test_batches_inside_each_key(spark, partitions):
    sizes = {"a": 10, "b": 9, "c": 1, None: 11}
    rows = [(k, i) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long").repartition(3)
    counted = {}
    for r in cd.key_batches(df, ["k"], ["i"], 3).orderBy("i").collect():
        counted.setdefault(r.k, Counter())[r.batch_id] += 1
    want = {"a": [3, 3, 2, 2], "b": [3, 3, 3], "c": [1], None: [3, 3, 3, 2]}
    assert {k: list(c.values()) for k, c in counted.items()} == want


def test_key_index_takes_nan_as_one_key_and_structs(spark, partitions):
    df = spark.range(400).selectExpr(
        "IF(id % 4 = 0, double('NaN'), IF(id % 4 = 1, -0.0D, 0.0D)) AS k",
        "named_struct('a', id % 2, 'b', CAST(NULL AS INT)) AS s", "id",
    ).repartition(3)
    by_number = {r.id: r.i for r in cd.key_index(df, ["k"], ["id"]).collect()}
    assert [by_number[i] for i in range(0, 400, 4)] == list(range(100))
    assert [by_number[i] for i in range(400) if i % 4] == list(range(300))
    by_struct = {r.id: r.i for r in cd.key_index(df, ["s"], ["id"]).collect()}
    assert [by_struct[i] for i in range(400)] == [i // 2 for i in range(400)]


def test_key_index_of_nothing(spark, partitions):
    nothing = spark.range(0).withColumn("k", F.lit(1))
    assert cd.key_index(nothing, ["k"], ["id"]).collect() == []
    assert cd.key_batches(nothing, ["k"], ["id"], 2).collect() == []
