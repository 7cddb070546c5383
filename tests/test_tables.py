import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

import cadence as cd
from cadence.functions.text import formatter


def lines(table, *order):
    return [r.line for r in table.orderBy(F.col("is_header").desc(), *order).collect()]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("a", 1.5), ("bbb", 22.25)], "k string, v double")


def test_golden(rows):
    options = dict(names=["k", "v"], header=["k", "v"], formats=["{}", "{:.2f}"])
    keyed = rows.withColumn("o", F.col("k"))
    padded = cd.format_table(keyed, pad=2, keep=["o"], **options)
    assert lines(padded, "o") == ["| k   | v     |", "| a   | 1.50  |", "| bbb | 22.25 |"]
    tight = cd.format_table(keyed, keep=["o"], **options)
    assert lines(tight, "o") == ["|k  |v    |", "|a  |1.50 |", "|bbb|22.25|"]
    odd = cd.format_table(keyed, pad=1, keep=["o"], alignments=["^", ">"], **options)
    assert lines(odd, "o") == ["| k  |    v |", "| a  | 1.50 |", "|bbb |22.25 |"]


def test_missing_values(spark):
    df = spark.createDataFrame([(None, None), ("b", 1.0)], "k string, v double")
    table = cd.format_table(df, formats=["{}", "{:.1f}"], header=["k", "v"])
    assert lines(table, "line") == ["|k   |v  |", "|None|nan|", "|b   |1.0|"]


def test_no_header_and_no_rows(rows):
    assert lines(cd.format_table(rows), "line") == ["|a  |1.5  |", "|bbb|22.25|"]
    assert lines(cd.format_table(rows.where("false"))) == []
    assert lines(cd.format_table(rows.where("false"), header=["k", "vv"])) == ["|k|vv|"]
    with pytest.raises(ValueError):
        cd.format_table(rows, header=["k"])


def test_dataframe_form(spark):
    df = spark.createDataFrame([("n", 1, 0.125, True), ("m", 20, 2.675, None)], "a string, b int, c double, d boolean")
    got = lines(cd.format_dataframe(df, index_cols=["a"]), "line")
    assert got == ["| a | b  | c    | d    |", "| m | 20 | 2.67 | None |", "| n | 1  | 0.12 | True |"]
    assert lines(cd.format_dataframe(df.select("a", "b"), index_cols=1), "line")[0] == "| ix0 | b  |"


def test_numbers_print_as_in_python(spark):
    rng = random.Random(9)
    values = [0.125, 2.675, 1.005, -0.001, float("nan"), float("inf"), float("-inf"), 0.0, -0.0,
              1e15, 1e16, 123456789012345680.0, 9.9e15, 1e-4, 9.9e-5, 1.5e-7, 1e7, 12345678.9, 1e100,
              2.0**53 + 2, -(2.0**60), 2.0**63, -(2.0**64), 1e22, 1e23, 1e300, -1.7976931348623157e308]
    values += [2.0**n * f for n in range(62, 1023, 13) for f in (1, 1 + 2**-52, 2 - 2**-52)]
    values += [rng.uniform(-1e6, 1e6) for _ in range(2000)]
    values += [rng.randrange(-10**7, 10**7) / 1000 for _ in range(2000)]
    values += [rng.uniform(-1, 1) * 10 ** rng.uniform(-12, 18) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x", cd.fixed_text("x").alias("two"), cd.fixed_text("x", 0).alias("none"),
        cd.plain_text("x", DoubleType()).alias("plain"),
    )
    for r in df.collect():
        assert r.plain == str(r.x)
        assert r.none == f"{r.x:.0f}"
        assert r.two == f"{r.x:.2f}"


def test_other_types_print_as_in_python(spark):
    rows = [(datetime(2024, 1, 2, 3, 4, 5), date(2024, 1, 2), Decimal("1.50"), 7),
            (datetime(2024, 1, 2, 3, 4, 5, 120000), None, None, None)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b date, c decimal(5,2), d long")
    got = df.select(*(cd.plain_text(f.name, f.dataType).alias(f.name) for f in df.schema)).collect()
    assert [tuple(r) for r in got] == [tuple(str(v) for v in row) for row in rows]


def test_cell_formats_print_as_in_python(spark):
    rng = random.Random(2)
    values = [0.0, -0.5, 0.125, 999.995, -1234567.891, 1e23, float("nan"), float("-inf"), 12.0]
    values += [rng.uniform(-1, 1) * 10 ** rng.uniform(-3, 20) for _ in range(300)]
    numbers = [0, 7, -42, 999, -1000, 123456, -1234567890123, 2**62]
    reals = spark.createDataFrame([(v,) for v in values], "x double")
    wholes = spark.createDataFrame([(n,) for n in numbers], "x long")
    for df, specs in (
        (reals, ["{:.0f}", "{:f}", "{:,.2f}", "{:,f}", "{:.1%}", "{:%}", "{:,.0%}", "{:012.3f}", "{:09.1%}"]),
        (wholes, ["{:d}", "{:,d}", "{:05d}", "{:.2f}", "{:,.1f}"]),
    ):
        shown = [formatter(s)(F.col("x"), df.schema["x"].dataType).alias(f"f{i}") for i, s in enumerate(specs)]
        for r in df.select("x", *shown).collect():
            assert list(r[1:]) == [s.format(r.x) for s in specs], r.x


def test_cell_formats_that_are_refused(spark):
    for bad in ("{:.3e}", "{:>8}", "{:.2d}", "{:012,.2f}", "x"):
        with pytest.raises(ValueError):
            formatter(bad)
    with pytest.raises(ValueError):
        formatter("{:d}")(F.lit(1.5), DoubleType())
    df = spark.createDataFrame([(None, None)], "a long, b double")
    table = cd.format_table(df, formats=["{:05d}", "{:,.1f}"])
    assert lines(table, "line") == ["|None|nan|"]


def test_sink(spark, rows, tmp_path):
    path = str(tmp_path / "table")
    cd.sink_text_table(rows, path, ["v"], header=["k", "v"], formats=["{}", "{:.2f}"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "table").glob("part-*")))
    assert text == "|k  |v    |\n|a  |1.50 |\n|bbb|22.25|\n"
