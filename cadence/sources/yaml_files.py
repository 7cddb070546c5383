"""YAML documents from files or a text column, as JSON text."""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MERGE_TAG = "tag:yaml.org,2002:merge"
_PARSED = "struct<doc:string,error:string>"


def _repeated_key(loader, root):
    """First key given twice in one mapping of the node tree, or None."""
    waiting, seen = [root], set()
    while waiting:
        node = waiting.pop()
        if node is None or id(node) in seen or isinstance(node.value, str):
            continue
        seen.add(id(node))
        if node.id == "sequence":
            waiting += node.value
            continue
        known = set()
        for key, value in node.value:
            waiting.append(value)
            if key.tag == _MERGE_TAG:
                continue
            name = loader.construct_object(key, deep=True)
            if name in known:
                return name
            known.add(name)
    return None


def _plain(value):
    """YAML value to what JSON can hold: dates and non-finite numbers become text."""
    if isinstance(value, dict):
        return {k if isinstance(k, str) else _key_text(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, set):
        return sorted((_plain(v) for v in value), key=str)
    if isinstance(value, bytes):
        return base64.b64encode(value).decode("ascii")
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    return str(value)


def _key_text(key) -> str:
    return json.dumps(key) if key is None or isinstance(key, (bool, int, float)) else str(key)


def yaml_to_json(text: str, strict: bool) -> str:
    """One YAML document as JSON text; strict rejects repeated keys, null becomes {}."""
    import yaml  # optional dependency, needed on the executors only

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)(text)
    try:
        root = loader.get_single_node()
        if strict:
            name = _repeated_key(loader, root)
            if name is not None:
                raise ValueError(f"key {name!r} is given twice")
        value = None if root is None else loader.construct_document(root)
    finally:
        loader.dispose()
    if value is None and strict:
        value = {}
    return json.dumps(_plain(value), ensure_ascii=False)


def _parse_all(texts: pd.Series, strict: bool, on_error: str, paths: pd.Series) -> pd.DataFrame:
    docs, errors = [], []
    for text, path in zip(texts, paths):
        doc = error = None
        try:
            doc = None if text is None else yaml_to_json(text, strict)
        except Exception as problem:  # any parser failure is the document's error
            if on_error == "fail":
                raise ValueError(f"YAML document {path}: {problem}") from problem
            error = str(problem)
        docs.append(doc)
        errors.append(error)
    return pd.DataFrame({"doc": docs, "error": errors})


def _check(on_error: str) -> None:
    if on_error not in ("fail", "row"):
        raise ValueError("on_error is 'fail' or 'row'")


def parse_yaml(text: Column, strict: bool = True, on_error: str = "fail",
               label: Column | None = None) -> Column:
    """Struct (doc JSON text, error) for a column of YAML texts.

    The lax form keeps the last of repeated keys and leaves a null document null.
    ``label`` names the document in the error of a failed one.
    """
    _check(on_error)

    @F.pandas_udf(_PARSED)
    def parse(texts: pd.Series, labels: pd.Series) -> pd.DataFrame:
        return _parse_all(texts, strict, on_error, labels)

    return parse(text, F.lit("a row") if label is None else label.cast("string"))


def scan_yaml(spark: SparkSession, path: str, strict: bool = True, on_error: str = "fail",
              min_partitions: int | None = None) -> DataFrame:
    """One YAML document per file: (path, doc JSON text, error).

    The DataFrame file readers skip zero-byte files, which are valid empty documents
    here, hence ``wholeTextFiles``.
    """
    _check(on_error)
    context = spark.sparkContext
    tasks = min_partitions or context.defaultParallelism
    files = context.wholeTextFiles(path, tasks).toDF("path string, text string")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parsed = _parse_all(frame["text"], strict, on_error, frame["path"])
            parsed.insert(0, "path", frame["path"].to_numpy())
            yield parsed

    return files.mapInPandas(parse, "path string, doc string, error string")
