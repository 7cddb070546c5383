"""Connected components of links between numbers, by shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.runtime import remove, staging_path


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component``: for each linked node, the smallest node it is connected with.

    ``links`` has columns ``a`` and ``b``.  Rounds of two steps, both a minimum per node
    (combined before the shuffle) and a join on the node: each node's larger neighbours move
    to its smallest neighbour, then its smaller ones do.  Every round's links are written to
    the staging folder, and the round before is dropped.  Rounds end when the links stay the
    same; their number grows with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    edges, path = _written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _digest(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m")
        )
        large = (
            both.where("b > a").join(smallest, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                    F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        edges, new_path = _written(small)
        remove(spark, path)
        path, before = new_path, state
        state = _digest(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _written(edges: DataFrame) -> tuple[DataFrame, str]:
    spark, path = edges.sparkSession, staging_path(edges.sparkSession, "links")
    edges.write.parquet(path)
    return spark.read.schema(edges.schema).parquet(path), path


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
