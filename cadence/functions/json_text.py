"""Get, set, merge and canonicalise JSON text, all on VARIANT inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBJECT = "map<string,variant>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def variant_path(path: str, sep: str = ".") -> str:
    """Dotted path to the bracket form variant functions take."""
    def step(name: str) -> str:
        quote = '"' if "'" in name else "'"
        if quote in name:
            raise ValueError(f"both kinds of quotes in {name!r}")
        return f"[{quote}{name}{quote}]"

    return "$" + "".join(map(step, path.split(sep)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated a single time however often it occurs."""
    return F.transform(F.array(value), use)[0]


def as_object(value: Column) -> Column:
    """Variant object as a map of its members; NULL for anything else."""
    return F.try_variant_get(value, "$", OBJECT)


def json_get(doc: Column | str, path: str, dtype: str = "string", strict: bool = False,
             sep: str = ".") -> Column:
    """Value at ``path``.  A missing path gives NULL, or raises when ``strict``."""
    variant, where = F.parse_json(_col(doc)), variant_path(path, sep)
    if not strict:
        return F.try_variant_get(variant, where, dtype)

    def checked(value: Column) -> Column:
        found = F.try_variant_get(value, where, "variant").isNotNull()
        missing = F.raise_error(F.lit(f"no value at {path}")).cast(dtype)
        return F.when(value.isNull() | found, F.variant_get(value, where, dtype)).otherwise(missing)

    return once(variant, checked)


def with_member(members: Column, parts: list[str], value: Column, soft: bool,
                null_is_absent: bool = False) -> Column:
    """``members`` is a map of variants; gives the variant object with the path set."""
    name = F.lit(parts[0])
    known = F.map_contains_key(members, name)
    current = F.element_at(members, name)
    if null_is_absent:
        known &= ~F.is_variant_null(current)
    if len(parts) == 1:
        member = F.when(known, current).otherwise(value) if soft else value
    else:
        bad = F.raise_error(F.lit(f"parent of {parts[1]} is not an object")).cast(OBJECT)
        empty = F.from_json(F.lit("{}"), OBJECT)
        below = F.when(known, F.coalesce(as_object(current), bad)).otherwise(empty)
        member = once(below, lambda m: with_member(m, parts[1:], value, soft, null_is_absent))
    others = F.map_filter(members, lambda k, _: k != name)
    return F.to_variant_object(F.map_concat(others, F.create_map(name, member)))


def json_set(doc: Column | str, path: str, value: Any, soft: bool = False,
             sep: str = ".") -> Column:
    """Set ``path``, creating missing parents; ``soft`` leaves an existing value alone.

    ``value`` is a Python value or a Column of JSON text; the result is JSON text.  A NULL
    document stays NULL; one that is not an object is an error.
    """
    text = value if isinstance(value, Column) else F.lit(json.dumps(value))
    parsed, parts, new = F.parse_json(_col(doc)), path.split(sep), F.parse_json(text)
    bad = F.raise_error(F.lit("the document is not an object")).cast(OBJECT)
    root = F.when(parsed.isNotNull(), F.coalesce(as_object(parsed), bad))
    return F.to_json(once(root, lambda m: with_member(m, parts, new, soft)))


_TAG = r"\u0001"  # how a tag looks in JSON text; a plain control character is not allowed there
_SEGMENTS = r'"(?:[^"\\]|\\.)*+"|[^"]++'
_NUMBER = r"-?[0-9][0-9.eE+-]*"
# numbers that VARIANT may write in another way: fractions, exponents, very many digits, -0
_RISKY = r"[0-9][.eE]|[0-9]{18}|-0"


def _tagged(doc: Column) -> Column:
    """Numbers become strings that begin with a tag, other strings keep theirs doubled."""
    def segment(part: Column) -> Column:
        # an escaped backslash before u0001 is no tag
        doubled = F.regexp_replace(part, r"(?<!\\)((?:\\\\)*)\\u0001", r"$1\\u0001\\u0001")
        return F.when(part.startswith('"'), doubled).otherwise(
            F.regexp_replace(part, _NUMBER, r'"\\u0001$0"'))

    return F.array_join(F.transform(F.regexp_extract_all(doc, F.lit(_SEGMENTS), F.lit(0)), segment), "")


def _untagged(text: Column) -> Column:
    numbers = F.regexp_replace(text, r'"\\u0001(-?[0-9][^"]*)"', "$1")
    return F.regexp_replace(numbers, r"(?<!\\)((?:\\\\)*)\\u0001\\u0001", r"$1\\u0001")


def canonical_json(doc: Column | str) -> Column:
    """JSON text with keys sorted at every level; repeated keys are an error.

    Numbers stay as they are written, whatever their length: ``1.0``, ``1e5`` and integers of
    any number of digits.  They pass through VARIANT as tagged strings in documents that hold
    such numbers; others go the short way.
    """
    def written(text: Column) -> Column:
        exact = F.when(F.parse_json(text).isNotNull(), _untagged(F.to_json(F.parse_json(_tagged(text)))))
        return F.when(text.rlike(_RISKY), exact).otherwise(F.to_json(F.parse_json(text)))

    return once(_col(doc), written)


@F.pandas_udf(T.StringType())
def _indented(docs: pd.Series) -> pd.Series:
    return docs.map(
        lambda d: json.dumps(json.loads(d), indent=4, sort_keys=True), na_action="ignore"
    )


def pretty_json(doc: Column | str) -> Column:
    """Key-sorted JSON text indented by four blanks, for reading by eye."""
    return _indented(_col(doc))


def _merged(user: Column, defaults: dict[str, Any]) -> Column:
    nested = {k: v for k, v in defaults.items() if isinstance(v, dict) and v}
    given = F.map_from_arrays(
        F.array(*(F.lit(k) for k in defaults)),
        F.array(*(F.parse_json(F.lit(json.dumps(v))) for v in defaults.values())),
    )

    def merge_member(name: Column, value: Column) -> Column:
        out = value
        for key, below in nested.items():
            out = F.when(name == key, _merged(value, below)).otherwise(out)
        return out

    def fill(members: Column) -> Column:
        own = F.transform_values(members, merge_member) if nested else members
        missing = F.map_filter(given, lambda k, _: ~F.map_contains_key(members, k))
        return F.to_variant_object(F.map_concat(own, missing))

    return F.coalesce(once(as_object(user), fill), user)


def merge_json_defaults(doc: Column | str, defaults: dict[str, Any]) -> Column:
    """Fill what ``doc`` lacks from ``defaults``, at every depth.

    The document wins wherever it has a value, a JSON null included; where either side
    is not an object the document's value stays.
    """
    if not defaults:
        return canonical_json(doc)
    return F.to_json(once(F.parse_json(_col(doc)), lambda d: _merged(d, defaults)))
