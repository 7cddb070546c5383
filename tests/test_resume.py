import pytest
from pyspark.sql import functions as F

import cadence as cd
from cadence.runtime import staging_root, subfolders

SCHEMA = "id long, twice long"


def doubling(log, broken=None):
    """Function that notes in the folder ``log`` every item it was called with."""

    def double(ident):
        with open(f"{log}/{ident}", "a") as f:
            f.write("x")
        if ident == broken:
            raise RuntimeError("item is broken")
        return 2 * ident

    return cd.per_item(double, ["id"], "twice", ["id"])


def calls(log):
    return {int(p.name): len(p.read_text()) for p in log.iterdir()}


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def test_crash_and_resume(spark, tmp_path, log):
    items, root = spark.range(200).repartition(3), str(tmp_path / "out")
    with pytest.raises(Exception, match="item is broken"):
        cd.resumable_map(items, "id", doubling(log, broken=130), SCHEMA, root, batch_rows=50)
    committed = cd.read_batches(spark, root)
    assert sorted(r.id for r in committed.collect()) == list(range(100))
    again = tmp_path / "again"
    again.mkdir()
    got = cd.resumable_map(items, "id", doubling(again), SCHEMA, root, batch_rows=50)
    assert [tuple(r) for r in cd.ordered_results(got, "id").collect()] == [(i, 2 * i) for i in range(200)]
    assert calls(again) == {i: 1 for i in range(100, 200)}

    idle = tmp_path / "idle"
    idle.mkdir()
    cd.resumable_map(items, "id", doubling(idle), SCHEMA, root, batch_rows=50)
    assert calls(idle) == {}
    grown = cd.resumable_map(spark.range(210), "id", doubling(idle), SCHEMA, root, batch_rows=4)
    assert calls(idle) == {i: 1 for i in range(200, 210)}
    assert grown.count() == 210


def test_default_commits_keep_what_was_done(spark, tmp_path, log):
    items, root = spark.range(100), str(tmp_path / "out")
    with pytest.raises(Exception, match="item is broken"):
        cd.resumable_map(items, "id", doubling(log, broken=99), SCHEMA, root)
    kept = cd.read_batches(spark, root).count()
    assert 0 < kept < 100
    again = tmp_path / "again"
    again.mkdir()
    assert cd.resumable_map(items, "id", doubling(again), SCHEMA, root).count() == 100
    assert len(calls(again)) == 100 - kept


def test_unfinished_batches_do_not_count(spark, tmp_path, log):
    items, root = spark.range(20), str(tmp_path / "out")
    cd.resumable_map(items, "id", doubling(log), SCHEMA, root, batch_rows=5)
    (tmp_path / "out" / "batch=3" / "_SUCCESS").unlink()
    assert cd.read_batches(spark, root).count() == 15
    again = tmp_path / "again"
    again.mkdir()
    assert cd.resumable_map(items, "id", doubling(again), SCHEMA, root).count() == 20
    assert calls(again) == {i: 1 for i in range(15, 20)}


def staged(spark):
    app = f"{staging_root(spark)}/cadence-{spark.sparkContext.applicationId}"
    return set(subfolders(spark, app))


def test_batches_are_balanced_and_in_key_order(spark, tmp_path, log):
    root = str(tmp_path / "out")
    items = spark.range(1000).repartition(7)
    before = staged(spark)
    cd.resumable_map(items, "id", doubling(log), SCHEMA, root, batch_rows=333)
    sizes = []
    for n in range(4):
        ids = sorted(r.id for r in spark.read.parquet(f"{root}/batch={n}").collect())
        assert ids == list(range(250 * n, 250 * n + 250))
        sizes.append(len(ids))
    assert sizes == [250] * 4
    assert staged(spark) == before


def test_commits_by_time(spark, tmp_path, log):
    root = str(tmp_path / "out")
    got = cd.resumable_map(
        spark.range(400), "id", doubling(log), SCHEMA, root, batch_rows=150, commit_seconds=2.0
    )
    assert sorted(r.id for r in got.collect()) == list(range(400))
    assert calls(log) == {i: 1 for i in range(400)}
    sizes = [spark.read.parquet(str(p)).count() for p in (tmp_path / "out").iterdir()]
    assert len(sizes) >= 4 and max(sizes) <= 150 and min(sizes) <= 4


def test_no_root_is_a_plain_map(spark, log, tmp_path):
    got = cd.resumable_map(spark.range(5), "id", doubling(log), SCHEMA, None)
    assert sorted(r.twice for r in got.collect()) == [0, 2, 4, 6, 8]
    assert not (tmp_path / "out").exists()


def test_strict_and_incomplete(spark, tmp_path, log):
    root = str(tmp_path / "out")
    twice = spark.range(3).unionByName(spark.range(1))
    with pytest.raises(ValueError, match="Duplicate"):
        cd.resumable_map(twice, "id", doubling(log), SCHEMA, root, strict=True)
    with pytest.raises(ValueError, match="lacks the key"):
        cd.resumable_map(spark.range(3), "id", doubling(log), "twice long", root)
    cd.resumable_map(spark.range(3), "id", doubling(log), SCHEMA, root)
    with pytest.raises(ValueError, match="unknown items"):
        cd.resumable_map(spark.range(2), "id", doubling(log), SCHEMA, root, strict=True)

    def loses(frames):
        for frame in frames:
            yield frame[frame.id != 1].assign(twice=0)

    with pytest.raises(ValueError, match="without a result"):
        cd.resumable_map(spark.range(3), "id", loses, SCHEMA, str(tmp_path / "other"))


def test_empty_input(spark, tmp_path, log):
    got = cd.resumable_map(spark.range(0), "id", doubling(log), SCHEMA, str(tmp_path / "out"))
    assert got.count() == 0 and got.columns == ["id", "twice"]


def test_several_keys(spark, tmp_path):
    items = spark.range(30).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))

    def add(frames):
        for frame in frames:
            yield frame.assign(c=frame.a + frame.b)

    got = cd.resumable_map(items, ["a", "b"], add, "a long, b long, c long", str(tmp_path / "o"), batch_rows=7)
    assert sorted(r.c for r in got.collect()) == sorted(i % 3 + i for i in range(30))
