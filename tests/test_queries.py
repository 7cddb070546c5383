"""Every registered query against its SQL, at the smallest scale."""

import contextlib
import io

import pytest

import __spark_entry__ as contract
from cadence.plans import ORACLES, QUERIES
from check import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    frame = contract.queries()[name](spark, FOLDER)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        frame.explain()
    assert "CartesianProduct" not in plan.getvalue()
    assert "NestedLoopJoin" not in plan.getvalue()
    sql = contract.oracle_sql()[name]
    assert differences(frame.toPandas(), duck.execute(sql).df()) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "step_filter", "weighted_mean", "running_mean", "dense_index", "keep_latest", "json_get",
    "json_set", "json_flatten_nested", "json_defaults", "json_merge", "struct_flatten",
    "set_path", "canonical_json", "level_map", "log_scan", "log_thresholds", "text_table",
])
def test_no_python_on_the_way(spark, name):
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        contract.queries()[name](spark, FOLDER).explain()
    assert not any(word in plan.getvalue() for word in ("Python", "Arrow", "Pandas"))
