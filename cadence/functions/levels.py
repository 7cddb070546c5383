"""Log level names and numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard level names and their numbers.
LEVELS = {
    "CRITICAL": 50,
    "FATAL": 50,
    "ERROR": 40,
    "WARN": 30,
    "WARNING": 30,
    "INFO": 20,
    "DEBUG": 10,
    "NOTSET": 0,
}
# The name shown for each number.
NAMES = {50: "CRITICAL", 40: "ERROR", 30: "WARNING", 20: "INFO", 10: "DEBUG", 0: "NOTSET"}


def _literal_map(entries: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def level_to_int(name: Column | str, strict: bool = True) -> Column:
    """Number of a level name; an unknown name raises, or gives NULL if not strict."""
    name = _col(name)
    number = F.element_at(_literal_map(LEVELS), name)
    if not strict:
        return number
    failure = F.raise_error(F.concat(F.lit("Unknown level: "), name)).cast("int")
    return F.when(name.isNull() | number.isNotNull(), number).otherwise(failure)


def level_to_name(number: Column | str) -> Column:
    """Name of a level number, ``Level <n>`` for numbers without one."""
    number = _col(number).cast("int")
    return F.coalesce(
        F.element_at(_literal_map(NAMES), number),
        F.concat(F.lit("Level "), number.cast("string")),
    )


def parse_level(text: Column | str, strict: bool = True) -> Column:
    """Accept either an integer text or a level name."""
    text = _col(text)
    digits = F.replace(F.trim(text), F.lit("_"), F.lit(""))
    number = F.when(
        text.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), digits.try_cast("int")
    )
    return F.when(number.isNotNull(), number).otherwise(level_to_int(text, strict))
