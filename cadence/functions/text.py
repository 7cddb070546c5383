"""Cell formatting that prints numbers the way Python does, without leaving the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Formatter = Callable[[Column, T.DataType], Column]

_DIGITS = 16  # as many ``format_number`` prints exactly
_LONG_LIMIT = 2.0**63
_LIMB = 10**9  # longer numbers are kept nine digits to an array element, lowest first
_SHIFT = 29  # 2**29 times an element still fits a BIGINT, and its carry an element


def _special(value: Column, ordinary: Column) -> Column:
    return (
        F.when(F.isnan(value), "nan")
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .otherwise(ordinary)
    )


def _decimal_format(value: Column, pattern: str) -> Column:
    # the Python function takes a number of decimals only, and groups thousands
    return F.call_function("format_number", value, F.lit(pattern))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _times(limbs: Column, factor: Column) -> Column:
    def step(done: Column, limb: Column) -> Column:
        product = limb * factor + done["carry"]
        digits = F.concat(done["limbs"], F.array(product % _LIMB))
        return F.struct(digits.alias("limbs"), _div(product, _LIMB).alias("carry"))

    def finish(done: Column) -> Column:
        longer = F.concat(done["limbs"], F.array(done["carry"]))
        return F.when(done["carry"] > 0, longer).otherwise(done["limbs"])

    start = F.struct(
        F.array().cast("array<bigint>").alias("limbs"), F.lit(0).cast("bigint").alias("carry")
    )
    return F.aggregate(limbs, start, step, finish)


def _huge_digits(size: Column) -> Column:
    """All digits of a double from 2**63 on: a BIGINT times a power of two, both exact."""
    def power(n: Column) -> Column:
        return F.pow(F.lit(2.0), n)

    shift = F.floor(F.log2(size)) - 56  # one off either way would do as well
    number = (size / power(shift)).cast("bigint")
    limbs = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), _div(shift, _SHIFT)),
        F.array(number % _LIMB, _div(number, _LIMB)),
        lambda so_far, i: _times(
            so_far, power(F.least(F.lit(_SHIFT), shift - i * _SHIFT)).cast("bigint")
        ),
    )
    texts = F.transform(F.reverse(limbs), lambda limb: F.lpad(limb.cast("string"), 9, "0"))
    return F.ltrim(F.array_join(texts, ""), F.lit("0"))


def fixed_text(value: Column | str, digits: int = 2) -> Column:
    """``value`` with a fixed number of decimals, rounded on its exact binary value.

    ``format_number`` rounds the exact value half-even, unlike ``format_string``, so
    0.125 gives 0.12 and 1.005 gives 1.00.  It prints no more than 17 digits, though, so
    large numbers are split into a BIGINT and the exact rest.  From 2**63 on a number is
    whole, and its digits are multiplied out.
    """
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    pattern = "0." + "0" * digits if digits else "0"
    size = F.abs(value)
    in_long = (size >= min(2.0**40, 10.0 ** (_DIGITS - digits))) & (size < _LONG_LIMIT)
    sign = F.when(value < 0, "-").otherwise("")
    if digits:
        whole = F.when(in_long, size).cast("bigint")
        rest = _decimal_format(size - whole, pattern)
        carried = whole + F.when(rest.startswith("1"), 1).otherwise(0)
        large = F.concat(sign, carried.cast("string"), F.substring(rest, 2, digits + 1))
    else:
        large = F.concat(sign, F.when(in_long, F.rint(size)).cast("bigint").cast("string"))
    in_huge = (size >= _LONG_LIMIT) & (size < float("inf"))
    zeros = F.lit("." + "0" * digits if digits else "")
    huge = F.concat(sign, _huge_digits(F.when(in_huge, size)), zeros)
    text = F.when(in_long, large).when(in_huge, huge).otherwise(_decimal_format(value, pattern))
    return _special(value, text)


def plain_text(value: Column | str, dtype: T.DataType) -> Column:
    """``value`` as Python's ``str`` prints it; NULL prints as ``None``."""
    value = F.col(value) if isinstance(value, str) else value
    if isinstance(dtype, T.BooleanType):
        text = F.when(value, "True").otherwise("False")
    elif isinstance(dtype, T.DoubleType):
        text = _float_text(value)
    elif isinstance(dtype, T.FloatType):
        text = _float_text(value.cast("string").cast("double"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = value.cast("string")
        # a fraction always shows six digits
        text = F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "None").otherwise(text)


def _float_text(value: Column) -> Column:
    """Shortest digits; positional from 1e-4 up to 1e16, exponent form elsewhere."""
    short = value.cast("string")
    # up to 15 digits identify themselves; beyond, the JVM may print more than needed
    settled = ~short.contains("E") & (F.length(short) <= 15)

    def scientific(decimals: int) -> Column:
        return F.format_string(f"%.{decimals}e", value)

    def raised(text: Column) -> Column:
        """The next number of 16 digits: the JVM rounds digits that it has cut before."""
        parts = F.split(text, "e")
        digits = F.replace(parts[0], F.lit("."), F.lit("")).cast("bigint")
        up = (digits + F.signum(digits).cast("bigint")).cast("string")
        return F.concat(F.regexp_replace(up, r"^(-?\d)(\d{15})$", "$1.$2"), F.lit("e"), parts[1])

    best = scientific(16)
    ordinary = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), scientific(15))
    for fewer in (raised(ordinary), scientific(15), scientific(14)):
        best = F.when(fewer.try_cast("double") == value, fewer).otherwise(best)
    positional = F.regexp_replace(
        best.try_cast("decimal(38,22)").cast("string"), r"(\.\d+?)0+$", "$1"
    )
    exponent = F.regexp_replace(best, r"\.?0*e", "e")
    size = F.abs(value)
    in_range = (size >= 1e-4) & (size < 1e16)
    return _special(
        value, F.when(settled, short).when(in_range, positional).otherwise(exponent)
    )


def _grouped(text: Column) -> Column:
    """Commas between thousands of the whole part."""
    whole = F.regexp_extract(text, r"^-?\d*", 0)
    rest = F.substring(text, F.length(whole) + 1, F.length(text))
    return F.concat(F.regexp_replace(whole, r"\B(?=(?:\d{3})+$)", ","), rest)


def _zero_filled(text: Column, width: int) -> Column:
    """Zeros between sign and digits up to ``width`` characters; longer text stays."""
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.substring(text, F.length(sign) + 1, F.length(text))
    size = F.greatest(F.length(digits), F.lit(width) - F.length(sign))
    return F.concat(sign, F.lpad(digits, size, F.lit("0")))


_CELL = re.compile(r"\{:(?:0(?P<width>\d+))?(?P<comma>,?)(?:\.(?P<digits>\d+))?(?P<kind>[df%])\}")


def formatter(spec: str | Formatter) -> Formatter:
    """Python's ``{}``, ``{:d}``, ``{:.2f}`` and ``{:.1%}``, or a function (column, type) -> column.

    The last three take a comma (``{:,.2f}``) or zeros up to a width (``{:05d}``), not both.  A
    missing value prints as ``None``, in a column with decimals as ``nan``.
    """
    if callable(spec):
        return spec
    if spec == "{}":
        return plain_text
    cell = _CELL.fullmatch(spec)
    if cell is None or (cell["width"] and cell["comma"]) or (cell["kind"] == "d" and cell["digits"]):
        raise ValueError(f"Unsupported cell format {spec!r}; pass a function instead")
    digits = 6 if cell["digits"] is None else int(cell["digits"])

    def whole(value: Column, dtype: T.DataType) -> Column:
        if not isinstance(dtype, T.IntegralType):
            raise ValueError(f"{spec!r} is for whole numbers, not {dtype.simpleString()}")
        return value.cast("string")

    def decimal(value: Column, _dtype: T.DataType) -> Column:
        scaled = value.cast("double") * 100 if cell["kind"] == "%" else value
        return F.coalesce(fixed_text(scaled, digits), F.lit("nan"))

    def shown(value: Column, dtype: T.DataType) -> Column:
        text = (whole if cell["kind"] == "d" else decimal)(value, dtype)
        plain = text.rlike(r"^-?\d")  # not nan or inf
        if cell["comma"]:
            text = F.when(plain, _grouped(text)).otherwise(text)
        if cell["width"]:
            width = int(cell["width"]) - (cell["kind"] == "%")
            text = F.when(text.isNotNull(), _zero_filled(text, width))
        return F.concat(text, F.lit("%")) if cell["kind"] == "%" else text

    return shown


def aligned(text: Column, width: Column, alignment: str = "<") -> Column:
    """Pad ``text`` to ``width`` code points; centring puts the odd blank right."""
    blank = F.lit(" ")
    if alignment == "<":
        return F.rpad(text, width, blank)
    if alignment == ">":
        return F.lpad(text, width, blank)
    if alignment != "^":
        raise ValueError(f"Unknown alignment {alignment!r}")
    size = F.length(text)
    right = F.ceil((width - size) / 2).cast("int")
    return F.lpad(F.rpad(text, size + right, blank), width, blank)


def split_path(path: Column | str, sep: str = ".") -> Column:
    """Path text to its parts; the separator is literal and has no escape."""
    path = F.col(path) if isinstance(path, str) else path
    return F.split(path, re.escape(sep), -1)


def path_prefixes(path: Column | str, sep: str = ".") -> Column:
    """All leading parts of a path, shortest first, the path itself last."""
    parts = split_path(path, sep)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep),
    )
