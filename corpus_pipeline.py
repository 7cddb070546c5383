"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and
returns a DataFrame; its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.decontamination import decontaminate
from cadence.llm.language_id import held_out, identify
from cadence.llm.packing import pack
from cadence.llm.queries import TOKENIZER
from cadence.llm.simhash import near_duplicate_groups, text_print
from cadence.llm.toxicity import score_toxicity
from cadence.runtime import quoted, stage

TOXIC_FROM = 0.7
BATCH_ROWS = 500
BROADCAST_ROWS = 250_000
"""Rows to drop, of some 30 bytes, that every executor gets; more are joined by a shuffle."""


def modest_batches(spark: SparkSession) -> None:
    """Let tasks exchange ``BATCH_ROWS`` rows at a time with Python, for the rest of the session.

    Spark's 10,000 whole texts take tens of megabytes on both sides, in each task.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that one of the learned languages claims.

    Those without any letter go, and those whose text has evidence enough but whose best
    regression stays below the bound that labelled texts reach.  Very short texts stay; if no
    document outside the held-out part has a language, letters are enough.  Null and empty texts
    have no letter; repeated rows stay or go together; an empty table gives none.
    """
    modest_batches(spark)
    name = unused(docs, "language")
    named = identify(docs, ~held_out("doc_id", 4, 2), out_col=name)
    return named.where(F.col(f"{name}.known")).drop(name)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose restored text scores below ``TOXIC_FROM``.

    Null and empty texts score as texts without words do.  Without labels of both kinds all stay.
    """
    modest_batches(spark)
    name = unused(docs, "score")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, labels, ~held_out("doc_id", 3, 1), name)
    return scored.where(F.col(name) < TOXIC_FROM).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: that of the smallest id, if any has one.

    Groups are those of :func:`near_duplicate_groups`: SimHash fingerprints of 64 bits over shingles
    of four words, linked at up to 4 differing bits.  Texts without words, null ones too, are one
    group.  Rows are told apart by id and text, so rows without an id and rows that repeat one
    stay wherever their fingerprints differ; of rows that repeat both, one stays.
    """
    modest_batches(spark)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", text_print(F.col("text")).alias("print"))
    groups = stage(near_duplicate_groups(docs.select(key.alias("key"), "text"), "key"), "groups")
    dropped = groups.where(~F.col("id").eqNullSafe(F.col("component"))).select("id").distinct()
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("doc"), key.alias("id"))
    if not groups.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.any_value("doc").alias("doc"))
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, "id", "left_anti").select("doc.*")


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a window of ten words of a benchmark item, or all of a shorter one."""
    modest_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences; null texts are empty."""
    modest_batches(spark)
    pieces = pack(docs, TOKENIZER, capacity=2048, end_id=0)
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "sequence_id", "offset",
    )


STAGES = [
    ("language", known_language), ("toxicity", not_toxic), ("near_duplicates", one_of_each_group),
    ("decontamination", not_in_benchmark), ("packing", packed),
]

# Learned models and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
