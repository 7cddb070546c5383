"""Fixed-width text tables: measure the columns once, then a plain projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.text import Formatter, aligned, formatter
from cadence.operators.ordering import columns

IS_HEADER = "is_header"
LINE = "line"


def _per_column(given: Sequence | None, default, names: Sequence[str], what: str) -> list:
    if given is None:
        return [default] * len(names)
    if len(given) != len(names):
        raise ValueError(f"{len(given)} {what} for {len(names)} columns")
    return list(given)


def _cells(df: DataFrame, names: Sequence[str], formats: Sequence[str | Formatter]) -> list[Column]:
    # a NULL cell would make the whole line NULL
    return [
        F.coalesce(formatter(f)(columns(n)[0], df.schema[n].dataType), F.lit("None"))
        for n, f in zip(names, formats)
    ]


def column_widths(df: DataFrame, names: Sequence[str] | None = None,
                  formats: Sequence[str | Formatter] | None = None,
                  header: Sequence[str] | None = None) -> DataFrame:
    """One row: the widest formatted cell of every column, its header included."""
    names = list(names or df.columns)
    cells = _cells(df, names, _per_column(formats, "{}", names, "formats"))
    titles = _per_column(header, "", names, "header cells")
    return df.agg(*(
        F.greatest(F.coalesce(F.max(F.length(c)), F.lit(0)), F.lit(len(t))).alias(n)
        for c, t, n in zip(cells, titles, names)
    ))


def format_table(df: DataFrame, names: Sequence[str] | None = None,
                 header: Sequence[str] | None = None,
                 formats: Sequence[str | Formatter] | None = None,
                 alignments: Sequence[str] | None = None, pad: int = 0,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep..., is_header, line); the caller orders by what is in ``keep``.

    The header, if any, is a row of its own with NULL in the kept columns.
    """
    spark = df.sparkSession
    names = list(names or [n for n in df.columns if n not in keep])
    formats = _per_column(formats, "{}", names, "formats")
    alignments = _per_column(alignments, "<", names, "alignments")
    widths = column_widths(df, names, formats, header).first()
    left, right = " " * (pad // 2), " " * (pad - pad // 2)

    def line(cells: Sequence[Column]) -> Column:
        parts = [F.lit("|")]
        for cell, width, alignment in zip(cells, widths, alignments):
            parts += [F.lit(left), aligned(cell, F.lit(width), alignment), F.lit(right + "|")]
        return F.concat(*parts).alias(LINE)

    body = df.select(*columns(keep), F.lit(False).alias(IS_HEADER), line(_cells(df, names, formats)))
    if header is None:
        return body
    blanks = [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keep]
    titles = [F.lit(t) for t in header]
    return spark.range(1).select(*blanks, F.lit(True).alias(IS_HEADER), line(titles)).unionByName(body)


def format_dataframe(df: DataFrame, index_cols: Sequence[str] | int = (),
                     keep: Sequence[str] = ()) -> DataFrame:
    """``format_table`` with index columns first, floats at two decimals and pad 2.

    ``index_cols`` names the leading columns; a number takes that many first columns
    and titles them ix0, ix1, ...
    """
    free = [n for n in df.columns if n not in keep]
    if isinstance(index_cols, int):
        index, titles = free[:index_cols], [f"ix{i}" for i in range(index_cols)]
    else:
        index = titles = list(index_cols)
    data = [n for n in free if n not in index]
    floats = (T.FloatType, T.DoubleType)
    formats = ["{}"] * len(index) + [
        "{:.2f}" if isinstance(df.schema[n].dataType, floats) else "{}" for n in data
    ]
    return format_table(df, [*index, *data], [*titles, *data], formats, pad=2, keep=keep)
