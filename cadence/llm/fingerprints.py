"""Document fingerprints from Lempel-Ziv phrases, compared by minimum hashes."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIZE = 128
"""Minimum hashes kept: likeness has a standard error of at most 0.5 / sqrt(SIZE)."""

# odd multipliers of a 64-bit mixing function (fixed values)
_BASE = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def phrase_ends(text: str) -> list[int]:
    """Parse into phrases, each the shortest that the dictionary does not hold yet.

    Returns where the phrases end; what remains at the end of the text is a phrase known
    already and not listed.
    """
    known: set[str] = set()
    add, ends, phrase, end = known.add, [], "", 0
    for letter in text:
        phrase += letter
        end += 1
        if phrase not in known:
            add(phrase)
            ends.append(end)
            phrase = ""
    return ends


def phrase_hashes(text: str) -> np.ndarray:
    """Distinct 32-bit hashes of the text's phrases, ascending.

    A phrase's hash is that of its own code points wherever it stands: the difference of two
    prefix sums of a polynomial, scaled back to the phrase's place.
    """
    ends = np.array(phrase_ends(text), np.int64)
    if not len(ends):
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.arange(ends[-1]) - np.repeat(starts, ends - starts)
    powers = np.multiply.accumulate(
        np.concatenate([[1], np.full(int(inside.max()), _BASE)]).astype(np.uint64)
    )
    sums = np.add.reduceat((points[:ends[-1]] + np.uint64(1)) * powers[inside], starts)
    sums ^= (ends - starts).astype(np.uint64) << np.uint64(56)
    for factor in _MIX:
        sums ^= sums >> np.uint64(31)
        sums *= np.uint64(factor)
    return np.unique((sums >> np.uint64(32)).astype(np.uint32))


def fingerprint(text: str | None, size: int = SIZE) -> str:
    """The ``size`` smallest phrase hashes (all, if fewer) in base64; empty for no text."""
    return base64.b64encode(phrase_hashes(text or "")[:size].astype("<u4").tobytes()).decode()


def likeness(one: str, other: str, size: int = SIZE) -> float:
    """Share of common phrases, estimated from the smallest hashes of both sets together.

    Exact while both texts have at most ``size`` phrases; 1 for two empty fingerprints.
    """
    a, b = (np.frombuffer(base64.b64decode(x), "<u4") for x in (one, other))
    smallest = np.union1d(a, b)[:size]
    if not len(smallest):
        return 1.0
    return float(np.isin(smallest, np.intersect1d(a, b, True)).mean())


def _print_column(text: pa.Array, size: int) -> pa.Array:
    return pa.array([fingerprint(t.as_py(), size) for t in text], pa.string())


def fingerprints(
    docs: DataFrame, text_cols: dict[str, str], keep: tuple[str, ...], size: int = SIZE
) -> DataFrame:
    """The columns ``keep`` and a fingerprint column for each text column of ``text_cols``
    (text column: fingerprint column).  Rows are handled one by one: null and empty texts have
    the empty fingerprint, equal texts equal ones, and repeated rows stay."""
    texts, names = list(text_cols), [*keep, *text_cols.values()]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep] + ["string"] * len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                kept = [part.column(k) for k in range(len(keep))]
                made = [_print_column(part.column(len(keep) + k), size) for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays(kept + made, names)

    inner = [f"c{k}" for k in range(len(names))]
    schema = ", ".join(f"{c} {kind}" for c, kind in zip(inner, kinds))
    chosen = docs.select(*keep, *texts).toDF(*inner)
    return chosen.mapInArrow(run, schema).toDF(*names)
