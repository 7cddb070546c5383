"""JSON documents from files, and JSON lines to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.json_text import canonical_json, pretty_json


def scan_json(spark: SparkSession, path: str,
              schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON document per file.

    With a schema the document's fields are the columns; without one the result is
    (path, doc VARIANT), for documents whose shape differs from file to file.
    """
    if schema is not None:
        return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("doc")
    )


def row_json(df: DataFrame):
    """Column of canonical JSON text of whole rows, NULL fields included."""
    return canonical_json(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))


def sink_json(df: DataFrame, path: str, pretty: bool = False, mode: str = "errorifexists") -> None:
    """Write each row as a JSON document with sorted keys, one per line.

    ``pretty`` indents by four blanks and leaves an empty line between documents; such
    files are for reading by eye unless a file holds a single row.
    """
    text = row_json(df)
    if pretty:
        df.select(pretty_json(text).alias("value")).write.mode(mode).text(path, lineSep="\n\n")
    else:
        df.select(text.alias("value")).write.mode(mode).text(path)
