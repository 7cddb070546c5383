import random

import pytest

import cadence as cd
from cadence.sources import manifests, states
from cadence.sources.manifests import Entry, Manifest, read_manifest, write_manifest
from cadence.streaming import incremental
from tests.test_resume import staged


def sample(seed=4, size=600):
    rng, now, rows = random.Random(seed), 0.0, []
    for ident in range(size):
        now += rng.choice([0.5, 2.0, 30.0])
        rows.append((rng.choice([1, 1, 2, 3]), now, ident, float(rng.randrange(50))))
    return rows


SCHEMA = "k long, t double, id long, v double"


@pytest.fixture
def drops(spark, tmp_path):
    """Function that drops some rows into the source folder and gives a stream on it."""
    folder = str(tmp_path / "in")

    def drop(rows):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(folder)
        return spark.readStream.schema(SCHEMA).parquet(folder)

    return drop


def test_incremental_job_takes_only_what_is_new(spark, tmp_path, drops):
    out, checkpoint, seen = str(tmp_path / "out"), str(tmp_path / "ck"), []

    def fn(batch):
        seen.append(batch.count())
        return batch

    rows = sample()
    for part in (rows[:400], rows[400:]):
        cd.incremental_job(drops(part), fn, checkpoint, out).awaitTermination()
    cd.incremental_job(drops(rows[:0]), fn, checkpoint, out).awaitTermination()
    assert [n for n in seen if n] == [400, 200]
    assert sorted(r.id for r in cd.read_batches(spark, out).collect()) == list(range(600))


@pytest.mark.parametrize("rule", [
    dict(seconds=60.0), dict(iters=7), dict(seconds=100.0, iters=20, step_spec="3::50"),
    dict(seconds=40.0, iters=30, reset_index=False),
], ids=str)
def test_throttle_equals_the_batch_form(spark, tmp_path, drops, rule):
    rows, out, checkpoint = sample(), str(tmp_path / "out"), str(tmp_path / "ck")
    for part in (rows[:150], rows[150:320], rows[320:]):
        fired = cd.stream_throttle(drops(part), "k", "t", ["id"], **rule)
        cd.incremental_job(fired, lambda b: b, checkpoint, out).awaitTermination()
    want = cd.throttle(spark.createDataFrame(rows, SCHEMA), "k", "t", ["id"], **rule)
    assert sorted(cd.read_batches(spark, out).collect()) == sorted(want.collect())


@pytest.mark.parametrize("limit", [None, 40])
@pytest.mark.parametrize("rule", [
    dict(seconds=60.0), dict(iters=7), dict(step_spec="2::11", iters=4),
    dict(seconds=100.0, iters=20, step_spec="3::50"),
    dict(seconds=40.0, iters=30, reset_index=False), dict(iters=300, step_spec="::90", reset_index=False),
], ids=str)
def test_throttle_job_equals_the_batch_form(spark, tmp_path, drops, rule, limit, monkeypatch):
    monkeypatch.setattr("cadence.operators.throttling.BLOCK_ROWS", 16)
    rows, out, states = sample(), str(tmp_path / "out"), str(tmp_path / "states")
    before = staged(spark)
    for part in (rows[:150], rows[150:320], rows[320:]):
        cd.throttle_job(
            drops(part), "k", "t", str(tmp_path / "ck"), out, states, ["id"],
            max_key_rows=limit, **rule,
        ).awaitTermination()
    assert staged(spark) == before
    want = cd.throttle(spark.createDataFrame(rows, SCHEMA), "k", "t", ["id"], **rule)
    assert sorted(cd.read_batches(spark, out).collect()) == sorted(want.collect())
    version, clocks = cd.read_clocks(spark, states, "k")
    assert version == 2
    counted = {r.k: r.clock_position for r in clocks.collect()}
    assert counted == {k: sum(r[0] == k for r in rows) for k in (1, 2, 3)}


def test_a_batch_delivered_again_changes_nothing(spark, tmp_path, drops):
    rows, out, states = sample(), str(tmp_path / "out"), str(tmp_path / "states")

    def run(part):
        cd.throttle_job(
            drops(part), "k", "t", str(tmp_path / "ck"), out, states, ["id"], seconds=60.0, iters=9
        ).awaitTermination()
        clocks = cd.read_clocks(spark, states, "k")[1]
        return sorted(cd.read_batches(spark, out).collect()), sorted(clocks.collect())

    run(rows[:300])
    once = run(rows[300:])
    for name in ("1", ".1.crc"):
        (tmp_path / "ck" / "commits" / name).unlink()  # as if the driver died before this
    assert run(rows[:0]) == once


def test_clocks_are_written_for_changed_keys_only(spark, tmp_path, drops, monkeypatch):
    """Six micro-batches over whole states every two; a key of each batch is in no other."""
    monkeypatch.setattr("cadence.streaming.keyed.WHOLE_CLOCKS", 2)
    out, states, ck = (str(tmp_path / n) for n in ("out", "states", "ck"))
    rows = [(k, float(10 * k + 60 * j), 100 * k + j, 0.0) for k in range(6) for j in range(3)]
    rows += [(99, 5.0 * k, 5000 + k, 0.0) for k in range(6)]
    parts = [[r for r in rows if r[2] // 100 == k or r[2] == 5000 + k] for k in range(6)]
    for part in parts:
        cd.throttle_job(drops(part), "k", "t", ck, out, states, ["id"], seconds=20.0).awaitTermination()
    want = cd.throttle(spark.createDataFrame(rows, SCHEMA), "k", "t", ["id"], seconds=20.0)
    assert sorted(cd.read_batches(spark, out).collect()) == sorted(want.collect())
    version, clocks = cd.read_clocks(spark, states, "k")
    assert version == 5
    assert {r.k: r.clock_position for r in clocks.collect()} == {k: 3 for k in range(6)} | {99: 6}
    stored = {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "states").glob("*=*")}
    assert {n for name, n in stored.items() if name.startswith("changed=")} == {2}
    # the newest whole state, the one before it and the changes since
    assert sum(name.startswith("whole=") for name in stored) == 2 and len(stored) <= 2 + 2 * 2


def late_rows():
    """Micro-batches whose rows are partly earlier than those of the batches before."""
    return [[(1, 100.0, 1, 0.0), (1, 130.0, 2, 0.0), (2, 5.0, 3, 0.0)],
            [(1, 20.0, 4, 0.0), (1, 135.0, 5, 0.0), (1, 195.0, 6, 0.0)],
            [(1, 50.0, 7, 0.0), (1, 210.0, 8, 0.0), (2, 1.0, 9, 0.0)],
            [(1, 60.0, 10, 0.0), (1, 300.0, 11, 0.0), (1, 301.0, 12, 0.0)]]


@pytest.mark.parametrize(("rule", "limit"), [
    (dict(seconds=30.0), None), (dict(seconds=50.0, iters=2), 2), (dict(seconds=40.0, iters=3, reset_index=False), None),
], ids=str)
def test_both_stream_forms_agree_on_late_rows(spark, tmp_path, drops, rule, limit):
    outs = [str(tmp_path / "a"), str(tmp_path / "b")]
    for part in late_rows():
        stream = drops(part)
        fired = cd.stream_throttle(stream, "k", "t", ["id"], **rule)
        cd.incremental_job(fired, lambda b: b, str(tmp_path / "ck-a"), outs[0]).awaitTermination()
        cd.throttle_job(stream, "k", "t", str(tmp_path / "ck-b"), outs[1], str(tmp_path / "states"),
                        ["id"], max_key_rows=limit, **rule).awaitTermination()
    one, other = (sorted(cd.read_batches(spark, out).collect()) for out in outs)
    assert one == other and len(one) >= 2


def test_output_of_another_checkpoint_is_refused(spark, tmp_path, drops):
    rows, out, states = sample(), str(tmp_path / "out"), str(tmp_path / "states")
    cd.incremental_job(drops(rows[:9]), lambda b: b, str(tmp_path / "a"), out).awaitTermination()
    for checkpoint in ("b", "used"):
        if checkpoint == "used":
            cd.incremental_job(
                drops(rows[9:10]), lambda b: b, str(tmp_path / "used"), str(tmp_path / "own")).awaitTermination()
        with pytest.raises(ValueError, match="another run"):
            cd.incremental_job(drops(rows[:0]), lambda b: b, str(tmp_path / checkpoint), out)
    with pytest.raises(ValueError, match="another run"):
        cd.throttle_job(drops(rows[:0]), "k", "t", str(tmp_path / "b"), out, states, iters=2)
    cd.incremental_job(drops(rows[10:20]), lambda b: b, str(tmp_path / "a"), out).awaitTermination()
    assert cd.read_batches(spark, out).count() == 20
    spark.range(3).write.parquet(str(tmp_path / "old" / "batch=0"))
    with pytest.raises(ValueError, match="without a manifest"):
        cd.incremental_job(drops(rows[:0]), lambda b: b, str(tmp_path / "c"), str(tmp_path / "old"))


def test_batches_are_merged_and_read_in_few_calls(spark, tmp_path, drops, monkeypatch):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    rows = sample()
    for k in range(6):
        job = cd.incremental_job(drops(rows[10 * k:10 * k + 10]), lambda b: b, checkpoint, out, merge_batches=3)
        job.awaitTermination()
        assert sorted(cd.read_batches(spark, out).collect()) == sorted(
            spark.createDataFrame(rows[:10 * k + 10], SCHEMA).collect())
    manifest = read_manifest(spark, out)
    numbers = [n for e in manifest.entries for n in range(e.first, e.last + 1)]
    assert numbers == list(range(6)) and len(manifest.entries) < 5
    there = {p.name for p in (tmp_path / "out").glob("*=*")}
    assert there == {e.folder for e in manifest.entries} | set(manifest.retired)
    assert len(list((tmp_path / "out" / "_manifest").glob("*.json"))) == 3
    calls = []
    for name in ("read_text", "children", "subfolders"):
        original = getattr(manifests, name)
        monkeypatch.setattr(manifests, name, lambda *a, f=original: calls.append(a[1:]) or f(*a))
    monkeypatch.setattr(states, "is_committed", lambda *a: pytest.fail("a call for each batch"))
    entries = tuple(Entry(n, n, "batch=7") for n in range(10_000))
    write_manifest(spark, str(tmp_path / "many"), Manifest("x", -1, entries))
    assert len(read_manifest(spark, str(tmp_path / "many")).entries) == 10_000
    assert len(calls) == 2


def test_a_merged_batch_delivered_again_changes_nothing(spark, tmp_path, drops):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    rows = sample()
    for k in range(4):
        cd.incremental_job(drops(rows[10 * k:10 * k + 10]), lambda b: b, checkpoint, out,
                           merge_batches=3).awaitTermination()
    for name in ("3", ".3.crc"):
        (tmp_path / "ck" / "commits" / name).unlink()  # as if the driver died before this
    cd.incremental_job(drops(rows[:0]), lambda b: b, checkpoint, out, merge_batches=3).awaitTermination()
    assert sorted(r.id for r in cd.read_batches(spark, out).collect()) == list(range(40))
    incremental.store_batch(spark.createDataFrame(rows[:1], SCHEMA), 0, out, checkpoint, 3)
    assert cd.read_batches(spark, out).count() == 40


def test_mean_equals_the_batch_form(spark, tmp_path, drops):
    rows, latest = sample(), {}

    def keep(batch, _number):
        latest.update({r.k: (r.avg, r.last) for r in batch.collect()})

    for part in (rows[:300], rows[300:]):
        means = cd.stream_weighted_mean(drops(part), "k", "v", "t", ["id"])
        query = (
            means.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    for k in (1, 2, 3):
        mine = [(v, t, i) for kk, t, i, v in rows if kk == k]
        assert latest[k][0] == pytest.approx(sum(v * t for v, t, _ in mine) / sum(t for _, t, _ in mine))
        assert latest[k][1] == mine[-1][0]


def test_log_lines_as_a_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("2024-01-01 00:00:07 ERROR: x\n  at y\n")
    out = str(tmp_path / "out")
    lines = cd.stream_log_lines(spark, str(tmp_path / "logs"), "shorter", maxFilesPerTrigger=1)
    cd.incremental_job(lines, lambda b: b, str(tmp_path / "ck"), out).awaitTermination()
    assert sorted(r.message for r in cd.read_batches(spark, out).collect()) == ["  at y", "x"]


def test_when_to_commit():
    assert cd.cadence() == {"trigger": {"availableNow": True}, "options": {}, "resume": {}}
    assert cd.cadence(seconds=120, files=3, rows=9) == {
        "trigger": {"processingTime": "120000 milliseconds"},
        "options": {"maxFilesPerTrigger": "3"}, "resume": {"commit_seconds": 120, "batch_rows": 9},
    }


@pytest.mark.parametrize(("spec", "commits"), [
    ("1::3", {0: [0], 1: [1], 3: [2, 3], 6: [4, 5, 6], 7: [7]}), ("99::", {7: list(range(8))}),
])
def test_batches_pile_up_until_a_commit(spark, tmp_path, spec, commits):
    got = {}

    def act(rows, number):
        got[number] = sorted(r.id for r in rows.collect())

    pending = cd.on_batches(spec, act, str(tmp_path / "pending"))
    for number in range(8):
        for _ in range(1 + number % 2):  # odd ones are delivered twice
            pending(spark.range(number, number + 1), number)
    pending.flush(spark)
    pending.flush(spark)
    assert got == commits


@pytest.mark.parametrize(("make", "groups"), [
    (lambda k: (k, None), 5), (lambda k: (None if k % 9 == 0 else k, str(k % 2)), 5),
    (lambda k: (k, ["", None, '"', "null", "a,b"][k % 5]), 5), (lambda k: (k % 40, float("nan")), 40),
], ids=["whole", "null", "strings", "doubles"])
def test_clocks_of_many_keys_are_few_states(spark, tmp_path, make, groups):
    rng, now, rows = random.Random(8), 0, []
    for ident in range(1200):
        now += rng.choice([0, 0, 1, 40])
        rows.append((*make(rng.randrange(200)), now, ident))
    schema = f"a long, b {'double' if groups == 40 else 'string'}, t long, id long"
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ck"))

    def run(part, buckets):
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        fired = cd.stream_throttle(stream, ["a", "b"], "t", ["id"], seconds=2000, buckets=buckets)
        job = cd.incremental_job(fired, lambda b: b, checkpoint, out)
        job.awaitTermination()
        return job

    for part in (rows[:700], rows[700:]):
        job = run(part, 5)
    assert job.recentProgress[0].stateOperators[0].numRowsTotal == groups
    want = cd.throttle(spark.createDataFrame(rows, schema), ["a", "b"], "t", ["id"], seconds=2000)
    got = cd.read_batches(spark, out)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    if groups == 5:
        with pytest.raises(Exception, match="made for 5 buckets"):
            run(rows[:100], 4)
