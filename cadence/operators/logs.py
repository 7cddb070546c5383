"""Filters over log records: by level, and by per-logger thresholds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.levels import LEVELS
from cadence.functions.text import path_prefixes
from cadence.operators.ordering import columns

# Packages that may not be more verbose than INFO.
NOISY_PACKAGES = (
    "PIL",
    "git",
    "tensorflow",
    "matplotlib",
    "selenium",
    "urllib3",
    "fiona",
    "rasterio",
)


def level_filter(level_no: Column | str, minimum: int | str) -> Column:
    """Records at or above a level, given as a number or a name."""
    least = LEVELS[minimum] if isinstance(minimum, str) else minimum
    return columns(level_no)[0] >= least


def noisy_thresholds(stream_level: int) -> dict[str, int]:
    return {name: max(LEVELS["INFO"], stream_level) for name in NOISY_PACKAGES}


def _nearest_literal(logger: Column, thresholds: Mapping[str, int]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in thresholds.items() for x in pair))
    nearest = F.try_element_at(
        F.filter(path_prefixes(logger), lambda p: F.map_contains_key(known, p)), F.lit(-1)
    )
    return F.element_at(known, nearest)


def logger_threshold_filter(logs: DataFrame, stream_level: int,
                            thresholds: Mapping[str, int] | DataFrame | None = None,
                            logger: str = "logger", level_no: str = "level_no") -> DataFrame:
    """Keep records at or above the stream level and their logger's own threshold.

    A logger's threshold is that of its nearest named ancestor, itself included; NOTSET
    (0) defers to the ancestor above.  ``thresholds`` is a mapping, looked up in place,
    or a DataFrame (logger, level_no), joined through the distinct logger names.
    """
    if thresholds is None:
        thresholds = noisy_thresholds(stream_level)
    name, level = columns(logger)[0], columns(level_no)[0]
    passes_stream = logs.where(level >= stream_level)
    if not isinstance(thresholds, DataFrame):
        own = {k: v for k, v in thresholds.items() if v}
        if not own:
            return passes_stream
        nearest = F.coalesce(_nearest_literal(name, own), F.lit(0))
        return passes_stream.where(level >= nearest)
    set_levels = thresholds.where("level_no <> 0").select(
        F.col("logger").alias("__prefix"), F.col("level_no").alias("__level")
    )
    names = passes_stream.select(name.alias("__logger")).distinct()
    resolved = (
        names.select("__logger", F.explode(path_prefixes("__logger")).alias("__prefix"))
        .join(set_levels, "__prefix")
        .groupBy("__logger")
        .agg(F.max_by("__level", F.length("__prefix")).alias("__level"))
    )
    joined = passes_stream.join(resolved, name == F.col("__logger"), "left")
    return joined.where(level >= F.coalesce("__level", F.lit(0))).drop("__logger", "__level")
