"""Step specs: a compact text for "which steps", compiled once into a Column.

A spec is a ``+``-separated union of clauses ``indices:limits:period``, each field
optional: ``0,1:10,:5+::25`` is 0, 1, every fifth step from 10 on, and every 25th.
Limits are inclusive and bind the period only, never the listed indices.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clause:
    indices: tuple[int, ...] = ()
    low: int | None = None
    high: int | None = None
    period: int | None = None


@dataclass(frozen=True)
class StepSpec:
    clauses: tuple[Clause, ...]

    @property
    def never(self) -> bool:
        return not any(c.indices or c.period for c in self.clauses)

    def fires_at(self, steps: np.ndarray) -> np.ndarray:
        """The spec over an array of steps; the DataFrame form is ``step_filter``."""
        steps = np.asarray(steps)
        fires = np.zeros(steps.shape, dtype=bool)
        for c in self.clauses:
            fires |= np.isin(steps, c.indices)
            if c.period:
                low = -np.inf if c.low is None else c.low
                high = np.inf if c.high is None else c.high
                fires |= (steps % c.period == 0) & (steps >= low) & (steps <= high)
        return fires


def _number(text: str, spec: str) -> int:
    if not text.isdecimal():
        raise ValueError(f"Invalid step spec {spec!r}: {text!r} is not a number")
    return int(text)


def _clause(text: str) -> Clause:
    if text == "":
        return Clause()
    fields = text.split(":")
    if len(fields) != 3:
        raise ValueError(f"Invalid step spec {text!r}: expected indices:limits:period")
    listed, limits, every = fields
    indices = tuple(_number(i, text) for i in listed.split(",")) if listed else ()
    low = high = None
    if limits:
        bounds = limits.split(",")
        if len(bounds) != 2:
            raise ValueError(f"Invalid step spec {text!r}: limits are MIN,MAX")
        low, high = (_number(b, text) if b else None for b in bounds)
    period = _number(every, text) if every else None
    if period == 0:
        raise ValueError(f"Invalid step spec {text!r}: period 0")
    return Clause(indices, low, high, period)


def step_spec(text: str) -> StepSpec:
    """Parse a spec; ``ValueError`` when it is malformed."""
    return StepSpec(tuple(_clause(part) for part in text.split("+")))


def _as_column(step: Column | str) -> Column:
    return F.col(step) if isinstance(step, str) else step


def _periodic(step: Column, clause: Clause) -> Column:
    hit = step % F.lit(clause.period) == 0
    if clause.low is not None:
        hit = (step >= clause.low) & hit
    if clause.high is not None:
        hit = (step <= clause.high) & hit
    return hit


def _clause_column(step: Column, clause: Clause) -> Column:
    parts = []
    if clause.indices:
        parts.append(step.isin(*clause.indices))
    if clause.period:
        parts.append(_periodic(step, clause))
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _envelope(step: Column, spec: StepSpec) -> Column | None:
    """Plain range around all hits; unlike ``%`` it reaches the Parquet reader."""
    lows: list[int | None] = []
    highs: list[int | None] = []
    for c in spec.clauses:
        lows += c.indices
        highs += c.indices
        if c.period:
            lows.append(c.low)
            highs.append(c.high)
    parts = []
    if lows and None not in lows:
        parts.append(step >= min(lows))
    if highs and None not in highs:
        parts.append(step <= max(highs))
    return reduce(lambda a, b: a & b, parts) if parts else None


def step_clause(step: Column | str, text: str) -> Column:
    """Boolean column for a single clause."""
    if "+" in text:
        raise ValueError(f"{text!r} is a union; use step_filter")
    return step_filter(step, text)


def step_filter(step: Column | str, spec: str | StepSpec) -> Column:
    """Boolean column: does the spec fire at ``step``?  NULL steps give NULL."""
    spec = step_spec(spec) if isinstance(spec, str) else spec
    step = _as_column(step)
    hit = reduce(lambda a, b: a | b, (_clause_column(step, c) for c in spec.clauses))
    bounds = _envelope(step, spec)
    return hit if bounds is None else bounds & hit


def _choose(found: list[Column], pick) -> Column:
    if not found:
        return F.lit(None).cast("bigint")
    return found[0] if len(found) == 1 else pick(*found)


def next_step(step: Column | str, spec: StepSpec) -> Column:
    """Smallest firing step strictly above ``step`` (steps >= -1), or NULL."""
    step = _as_column(step)
    found = []
    for c in spec.clauses:
        found += [F.when(step < i, F.lit(i).cast("bigint")) for i in set(c.indices)]
        if c.period:
            start = step + 1
            if c.low is not None:
                start = F.greatest(start, F.lit(c.low).cast("bigint"))
            multiple = start + F.pmod(-start, F.lit(c.period).cast("bigint"))
            if c.high is not None:
                multiple = F.when(multiple <= c.high, multiple)
            found.append(multiple)
    return _choose(found, F.least)


def previous_step(step: Column | str, spec: StepSpec) -> Column:
    """Largest non-negative firing step strictly below ``step``, or NULL."""
    step = _as_column(step)
    found = []
    for c in spec.clauses:
        found += [F.when(step > i, F.lit(i).cast("bigint")) for i in set(c.indices)]
        if c.period:
            start = step - 1
            if c.high is not None:
                start = F.least(start, F.lit(c.high).cast("bigint"))
            multiple = start - F.pmod(start, F.lit(c.period).cast("bigint"))
            found.append(F.when(multiple >= (c.low or 0), multiple))
    return _choose(found, F.greatest)
