import json

import pytest
from pyspark.sql import functions as F

import cadence as cd
from cadence.plans import QUERIES
from cadence.runtime import staging_root

YAML = {
    "twice.yml": "a: 1\na: 2\n",
    "nested.yml": "p: {a: 1, a: 2}\n",
    "listed.yml": "- {b: 1, b: 1}\n",
    "empty.yml": "",
    "fine.yml": "p: {a: 1}\nq: {a: 2}\n",
    "merge.yml": "base: &b {x: 1, y: 2}\nuse:\n  <<: *b\n  x: 5\n",
    "odd.yml": "d: 2024-01-02\nn: .nan\n1: one\nnull: nothing\ns: !!set {u, v}\n",
    "broken.yml": "a: [1\n",
}


@pytest.fixture
def yaml_folder(tmp_path):
    for name, text in YAML.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def scanned(spark, folder, **options):
    rows = cd.scan_yaml(spark, folder, on_error="row", **options).collect()
    return {r.path.rsplit("/", 1)[1]: r for r in rows}


def test_yaml_strict(spark, yaml_folder):
    got = scanned(spark, yaml_folder)
    docs = {k: json.loads(r.doc) for k, r in got.items() if r.error is None}
    assert docs == {
        "empty.yml": {}, "fine.yml": {"p": {"a": 1}, "q": {"a": 2}},
        "merge.yml": {"base": {"x": 1, "y": 2}, "use": {"x": 5, "y": 2}},
        "odd.yml": {"d": "2024-01-02", "n": "nan", "1": "one", "null": "nothing", "s": ["u", "v"]},
    }
    assert got["twice.yml"].error == "key 'a' is given twice"
    assert got["nested.yml"].error == "key 'a' is given twice"
    assert got["listed.yml"].error == "key 'b' is given twice"
    assert got["broken.yml"].error and got["broken.yml"].doc is None


def test_yaml_lax(spark, yaml_folder):
    got = scanned(spark, yaml_folder, strict=False)
    assert json.loads(got["twice.yml"].doc) == {"a": 2}
    assert json.loads(got["nested.yml"].doc) == {"p": {"a": 2}}
    assert json.loads(got["empty.yml"].doc) is None


def test_yaml_failure_names_the_file(spark, yaml_folder):
    with pytest.raises(Exception, match="YAML document .*twice.yml: key 'a' is given twice"):
        cd.scan_yaml(spark, yaml_folder + "/twice.yml").collect()
    with pytest.raises(ValueError):
        cd.scan_yaml(spark, yaml_folder, on_error="ignore")


def test_yaml_column(spark):
    df = spark.createDataFrame([("a: 1",), ("a: 1\na: 2",), (None,)], "t string")
    rows = [r.y for r in df.select(cd.parse_yaml(F.col("t"), on_error="row").alias("y")).collect()]
    assert rows[0].doc == '{"a": 1}' and rows[1].doc is None and "twice" in rows[1].error
    assert rows[2].doc is None and rows[2].error is None


def test_yaml_documents_of_one_split_are_dealt_over_the_cores(spark):
    docs = QUERIES["yaml_documents"](spark, "/root/testdata/sf0.001")
    assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"b": i, "a": {"c": [i]}}, indent=4))
    typed = cd.scan_json(spark, str(tmp_path / "in"), "b int, a struct<c:array<int>>")
    assert sorted((r.b, r.a.c) for r in typed.collect()) == [(i, [i]) for i in range(3)]
    loose = cd.scan_json(spark, str(tmp_path / "in"))
    assert sorted(r[0] for r in loose.select(F.to_json("doc")).collect()) == [
        f'{{"a":{{"c":[{i}]}},"b":{i}}}' for i in range(3)]
    (tmp_path / "in" / "3.json").write_text('{"b": ')
    with pytest.raises(Exception):
        cd.scan_json(spark, str(tmp_path / "in"), "b int").collect()


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([(2, None, ("x", 1.5))], "z int, b string, a struct<d:string,c:double>")
    cd.sink_json(df, str(tmp_path / "lines"))
    value = {"z": 2, "b": None, "a": {"d": "x", "c": 1.5}}
    lines = "".join(p.read_text() for p in (tmp_path / "lines").glob("part-*"))
    assert lines == json.dumps(value, sort_keys=True, separators=(",", ":")) + "\n"
    cd.sink_json(df, str(tmp_path / "pretty"), pretty=True)
    text = "".join(p.read_text() for p in (tmp_path / "pretty").glob("part-*"))
    assert text.strip() == json.dumps(value, indent=4, sort_keys=True)
    assert cd.scan_json(spark, str(tmp_path / "pretty"), df.schema).collect() == df.collect()


def test_snapshots(spark, tmp_path):
    path, calls = str(tmp_path / "s"), []

    def build(n):
        calls.append(n)
        return spark.range(n)

    assert cd.compute_or_load(spark, path, build, 3).count() == 3
    assert cd.compute_or_load(spark, path, build, 9, silent=True).count() == 3
    assert calls == [3]
    (tmp_path / "s" / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="not known to be whole"):  # never overwritten
        cd.compute_or_load(spark, path, build, 5)
    with pytest.raises(ValueError, match="not known to be whole"):
        cd.read_first_available(spark, path)
    assert spark.read.parquet(path).count() == 3 and calls == [3]
    (tmp_path / "s" / "_temporary").mkdir()
    assert cd.stash(spark, path)(build, 5).count() == 5
    assert cd.stash(spark, path, active=False)(build, 7).count() == 7
    assert calls == [3, 5, 7]

    def fails():
        raise RuntimeError("no table")

    with pytest.raises(RuntimeError):
        cd.compute_or_load(spark, str(tmp_path / "new"), fails)
    assert not (tmp_path / "new").exists()


def test_append(spark, tmp_path):
    path = str(tmp_path / "chunks")
    for n in (3, 4):
        cd.append_results(spark.range(n), path)
    assert cd.read_snapshot(spark, path).count() == 7


def test_first_available(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    paths = {n: str(tmp_path / n) for n in ("none", "empty", "bad", "good")}
    cd.write_snapshot(spark.range(2), paths["good"])
    assert cd.read_first_available(spark, paths["none"], paths["empty"], paths["good"]).count() == 2
    with pytest.raises(FileNotFoundError):
        cd.read_first_available(spark, paths["none"], paths["empty"])
    with pytest.raises(Exception) as raised:
        cd.read_first_available(spark, paths["bad"], paths["good"])
    assert not isinstance(raised.value, FileNotFoundError)


def test_states(spark, tmp_path):
    root = str(tmp_path / "states")
    assert cd.read_latest_state(spark, root) == (-1, None)
    assert cd.latest_index(cd.list_states(spark, root)).first().latest == -1
    for version in (1, 2):
        cd.commit_state(spark.range(version), root, version, total=9)
    assert cd.prune_states(spark, root) == 0
    for version in (3, 4, 5, 10):
        cd.commit_state(spark.range(version), root, version, total=9)
    (tmp_path / "states" / "total=9" / "version=10" / "_SUCCESS").unlink()
    version, state = cd.read_latest_state(spark, root)
    assert (version, state.count()) == (5, 5)
    assert cd.prune_states(spark, root, keep=3) == 2
    states = cd.list_states(spark, root)
    assert sorted(tuple(r) for r in states.collect()) == [
        (3, 9, True), (4, 9, True), (5, 9, True), (10, 9, False)]
    assert cd.latest_index(states).first().latest == 5
    cd.commit_state(spark.range(1), root, 1, total=8)
    with pytest.raises(ValueError, match="different totals"):
        cd.list_states(spark, root)


def test_states_without_total_or_root(spark, tmp_path):
    root = str(tmp_path / "states")
    cd.commit_state(spark.range(4), root, 7)
    assert cd.read_latest_state(spark, root)[0] == 7
    cd.commit_state(spark.range(4), None, 7)
    assert cd.read_latest_state(spark, None) == (-1, None)
    assert cd.prune_states(spark, None) == 0


def test_staging_follows_the_session(spark):
    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir")
