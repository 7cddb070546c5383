"""Weighted means: per group, and running along an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.ordering import PART, SLOT, columns, inside_key, lay_out, with_carries


def _pair(value: Column | str, weight: Column | str | float) -> tuple[Column, Column]:
    """(value * weight, weight) as doubles; a NULL value drops its weight too."""
    value = columns(value)[0].cast("double")
    weight = columns(weight)[0] if isinstance(weight, (str, Column)) else F.lit(weight)
    weight = F.when(value.isNotNull(), weight.cast("double"))
    return value * weight, weight


def weighted_mean(value: Column | str, weight: Column | str | float = 1) -> Column:
    """Aggregate: weighted mean; NULL for an empty group or zero total weight."""
    product, weight = _pair(value, weight)
    return F.try_divide(F.sum(product), F.sum(weight))


def last_value(value: Column | str, *order: Column | str) -> Column:
    """Aggregate: value of the last row in ``order`` (add ties to make it total).

    With one numeric order column and value it stays a hash aggregate.
    """
    by = columns(order)
    return F.max_by(columns(value)[0], by[0] if len(by) == 1 else F.struct(*by))


def weighted_summary(value: Column | str, weight: Column | str | float,
                     order: Sequence[Column | str]) -> Column:
    """Aggregate: struct of last, avg, sum and count (count is the total weight)."""
    product, weight_used = _pair(value, weight)
    return F.struct(
        last_value(columns(value)[0].cast("double"), *order).alias("last"),
        F.try_divide(F.sum(product), F.sum(weight_used)).alias("avg"),
        F.sum(product).alias("sum"),
        F.sum(weight_used).alias("count"),
    )


def running_weighted_mean(df: DataFrame, value: Column | str, weight: Column | str | float,
                          keys: Sequence[str], order: Sequence[Column | str],
                          name: str = "avg") -> DataFrame:
    """Add the weighted mean of all rows of the key up to this one.

    Rows are laid out by key over range partitions: each sums its own part, and what the
    key sums up to in the partitions before it is added.  Sums of doubles may differ in
    their last digits between layouts.
    """
    product, weight_used = _pair(value, weight)
    laid_out = lay_out(
        df.withColumn("__vw", product).withColumn("__w", weight_used),
        [*columns(keys), *columns(order)], "running",
    )
    carried = with_carries(laid_out, keys, c__vw=F.sum("__vw"), c__w=F.sum("__w"))
    so_far = inside_key(keys).rowsBetween(Window.unboundedPreceding, 0)

    def running(c: str) -> Column:
        zero = F.lit(0.0)
        return F.coalesce(F.sum(c).over(so_far), zero) + F.coalesce(F.col(f"c{c}_before"), zero)

    # the group mean is NULL while no value has been seen; 0/0 gives the same NULL
    return carried.withColumn(name, F.try_divide(running("__vw"), running("__w"))).drop(
        PART, SLOT, "__vw", "__w", "c__vw_before", "c__vw_all", "c__w_before", "c__w_all"
    )
