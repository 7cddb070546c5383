import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import cadence as cd
from cadence.functions.steps import next_step, previous_step, step_spec

EVERY_FIFTH = list(range(0, 51, 5))
FIRES = {
    "": [],
    "::": [],
    ":,:": [],
    "::5": EVERY_FIFTH,
    "0::5": EVERY_FIFTH,
    "0:,20:5": [0, 5, 10, 15, 20],
    "0,1:10,:5": [0, 1, *range(10, 51, 5)],
    ":,5:1+::25": [0, 1, 2, 3, 4, 5, 25, 50],
    "3,50:10,20:7": [3, 14, 50],
    "7:10,20:": [7],
}


def fired(spark, spec):
    steps = spark.range(51)
    return [r.id for r in steps.where(cd.step_filter("id", spec)).orderBy("id").collect()]


@pytest.mark.parametrize("spec", FIRES)
def test_golden_specs(spark, spec):
    assert fired(spark, spec) == FIRES[spec]
    assert np.flatnonzero(step_spec(spec).fires_at(np.arange(51))).tolist() == FIRES[spec]


@pytest.mark.parametrize("spec", ["5", "a::", ":5:1", "-1::", "1,,2::", "::0", ":::", ":1,2,3:4", "::5+x"])
def test_rejected_specs(spec):
    with pytest.raises(ValueError):
        step_spec(spec)


def test_negative_and_null_steps(spark):
    rows = spark.createDataFrame([(-5,), (-4,), (None,), (5,)], "s long")
    assert {r.s for r in rows.where(cd.step_filter("s", "::5")).collect()} == {-5, 5}


def test_a_single_clause_takes_no_union():
    with pytest.raises(ValueError):
        cd.step_clause("s", "::5+::7")


def random_spec(rng):
    def clause():
        listed = ",".join(str(rng.randrange(40)) for _ in range(rng.randrange(3)))
        limits = ""
        if rng.random() < 0.5:
            limits = f"{rng.choice(['', rng.randrange(30)])},{rng.choice(['', rng.randrange(60)])}"
        return f"{listed}:{limits}:{rng.choice(['', rng.randrange(1, 9)])}"

    return "+".join(clause() for _ in range(rng.randrange(1, 4)))


def test_next_and_previous_step_agree_with_the_filter(spark):
    rng = random.Random(7)
    for _ in range(12):
        text = random_spec(rng)
        spec = step_spec(text)
        hits = fired(spark, text)
        rows = (
            spark.range(-1, 40)
            .select("id", next_step("id", spec).alias("n"), previous_step("id", spec).alias("p"))
            .collect()
        )
        for r in rows:
            after = [h for h in hits if h > r.id]
            before = [h for h in hits if h < r.id]
            if after:
                assert r.n == after[0], text
            assert r.p == (before[-1] if before else None), text


def test_bounded_spec_reaches_the_parquet_reader(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    picked = spark.read.parquet(path).where(cd.step_filter("id", "3,50:10,200:7"))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(id,3)" in pushed and "LessThanOrEqual(id,200)" in pushed
    assert "WholeStageCodegen" in picked._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    )


def test_type_of_the_column_is_kept(spark):
    out = spark.range(3).select(cd.step_filter(F.col("id"), "::2").alias("hit"))
    assert out.schema["hit"].dataType.simpleString() == "boolean"
