import random
import re
from datetime import datetime

import pytest

import cadence as cd

WHEN = datetime(2024, 1, 1, 0, 0, 7)


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r.y for r in df.select(fn("x").alias("y")).collect()]


def test_levels(spark):
    names = ["CRITICAL", "FATAL", "ERROR", "WARN", "WARNING", "INFO", "DEBUG", "NOTSET"]
    assert column(spark, names, "string", cd.level_to_int) == [50, 50, 40, 30, 30, 20, 10, 0]
    assert column(spark, [20, 15, 30, 50, 0], "int", cd.level_to_name) == [
        "INFO", "Level 15", "WARNING", "CRITICAL", "NOTSET"]
    assert column(spark, ["30", " -4 ", "+1_0", "ERROR", None], "string", cd.parse_level) == [30, -4, 10, 40, None]
    for fn in (cd.level_to_int, cd.parse_level):
        for bad in ("info", "NOPE", "3.5"):
            with pytest.raises(Exception, match="Unknown level"):
                column(spark, [bad], "string", fn)
    assert column(spark, ["x"], "string", lambda c: cd.parse_level(c, strict=False)) == [None]


@pytest.mark.parametrize("layout, line, known", [
    ("extended", "2024-01-01 00:00:07 a.b run ERROR: boom: x", ("a.b", "run", "ERROR", 40)),
    ("short", "2024-01-01 00:00:07 a.b ERROR: boom: x", ("a.b", None, "ERROR", 40)),
    ("shorter", "2024-01-01 00:00:07 Level 15: boom: x", (None, None, "Level 15", 15)),
    ("shortest", "2024-01-01 00:00:07: boom: x", (None, None, None, None)),
])
def test_layouts(spark, tmp_path, layout, line, known):
    path = tmp_path / "log"
    path.write_text(line + "\nTraceback: none\n")
    first, second = cd.scan_log_lines(spark, str(path), layout).collect()
    assert tuple(first) == (WHEN, *known, "boom: x")
    assert tuple(second) == (None, None, None, None, None, "Traceback: none")


def test_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(WHEN, "a.b", "<lambda>", "Level 15", 15, "m: 1"), (WHEN, "r", "f", "INFO", 20, ""),
         (None, None, None, None, None, "  at line 3")],
        "ts timestamp_ntz, logger string, func string, level string, level_no int, message string",
    )
    path = str(tmp_path / "log")
    cd.sink_log_lines(df, path)
    assert set(cd.scan_log_lines(spark, path, "extended").collect()) == set(df.collect())


def test_times_in_a_clock_change_survive(spark, tmp_path):
    (tmp_path / "log").write_text("2024-03-10 02:30:00: x\n")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = cd.scan_log_lines(spark, str(tmp_path / "log"), "shortest")
        assert rows.first().ts == datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def passed(spark, rows, *args):
    logs = spark.createDataFrame(rows, "logger string, level_no int")
    return {tuple(r) for r in cd.logger_threshold_filter(logs, *args).collect()}


def test_thresholds(spark):
    rows = [("PIL.Image", 10), ("PILX", 10), ("PIL", 20), ("git", 20), ("app", 10), ("app", 5)]
    assert passed(spark, rows, 10) == {("PILX", 10), ("PIL", 20), ("git", 20), ("app", 10)}
    assert passed(spark, rows, 40) == set()
    own = {"app": 10, "app.x": 0, "app.x.y": 40}
    rows = [(n, v) for n in ("app", "app.x", "app.x.y", "app.x.y.z", "zz") for v in (5, 10, 40)]
    want = {("app", 10), ("app", 40), ("app.x", 10), ("app.x", 40), ("app.x.y", 40),
            ("app.x.y.z", 40), ("zz", 5), ("zz", 10), ("zz", 40)}
    assert passed(spark, rows, 0, own) == want
    table = spark.createDataFrame(list(own.items()), "logger string, level_no int")
    assert passed(spark, rows, 0, table) == want
    assert passed(spark, rows, 0, {}) == set(rows)


def test_level_filter(spark):
    df = spark.createDataFrame([(10,), (20,), (None,)], "level_no int")
    assert [r.level_no for r in df.where(cd.level_filter("level_no", "INFO")).collect()] == [20]


def python_records(files, layout="shorter"):
    """(file name, record, message, traceback) by reading line after line."""
    pattern = re.compile(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} (?:Level -?\d+|[^\s:]+): (.*)$")
    out = []
    for name, text in files.items():
        number, records = -1, {}
        for line in text.splitlines():
            found = pattern.match(line)
            if found:
                number += 1
                records[number] = (found[1], [])
            else:
                records.setdefault(number, (None, []))[1].append(line)
        out += [(name, n, m, "\n".join(t) if t else None) for n, (m, t) in records.items()]
    return sorted(out, key=str)


def log_texts():
    rng = random.Random(3)
    files = {"empty.log": "", "none.log": "only\ncontinuation\n", "head.log": "before\n\nall\n2024-01-01 00:00:07 INFO: a"}
    for k in range(5):
        lines = []
        for n in range(rng.choice([3, 60, 400])):
            lines.append(f"2024-01-01 00:00:0{n % 10} ERROR: message {n} of {k}")
            for j in range(rng.choice([0, 0, 1, 3, 40 if n % 50 == 0 else 0])):
                lines.append(rng.choice(["", "  File x", f"Error: {n} {j}", "2024-01-01 no record"]))
        files[f"f{k}.log"] = "\n".join(lines) + "\n"
    return files


@pytest.mark.parametrize("split", [None, 150, 4000])
def test_records_over_splits(spark, tmp_path, split):
    files = log_texts()
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes",
             "spark.sql.execution.arrow.maxRecordsPerBatch")
    if split:
        for name, value in zip(names, (split, 0, 7)):
            spark.conf.set(name, str(value))
    try:
        records = cd.scan_log_records(spark, str(tmp_path), "shorter")
        rows = records.select("file", "record", "message", "traceback", "level").collect()
    finally:
        for name in names:
            spark.conf.unset(name)
    got = sorted(((r.file.rsplit("/", 1)[1], r.record, r.message, r.traceback) for r in rows), key=str)
    assert got == python_records(files)
    assert {r.level for r in rows if r.record >= 0} == {"ERROR", "INFO"}


def test_records_of_a_layout_with_loggers(spark, tmp_path):
    (tmp_path / "log").write_text(
        "2024-01-01 00:00:07 a.b run ERROR: boom: x\nTraceback:\n  none\n2024-01-01 00:00:07 a.b run Level 7: y\n")
    first, second = cd.scan_log_records(spark, str(tmp_path / "log"), "extended").orderBy("record").collect()
    assert tuple(first)[1:] == (0, WHEN, "a.b", "run", "ERROR", 40, "boom: x", "Traceback:\n  none")
    assert tuple(second)[1:] == (1, WHEN, "a.b", "run", "Level 7", 7, "y", None)
