"""Snapshots, states, resumable and incremental jobs, streams."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import cadence as cd
from cadence.plans.registry import query, table
from cadence.plans.selection import SIX_HOURS
from cadence.runtime import staging_path


@query("""
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY o_orderpriority
""")
def snapshot_roundtrip(spark, folder):
    def by_priority():
        orders = table(spark, folder, "orders")
        return orders.groupBy("o_orderpriority").agg(
            F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
        )

    def not_again():
        raise RuntimeError("the snapshot should have been read")

    path = staging_path(spark, "snapshot")
    cached = cd.stash(spark, path)
    cached(by_priority)
    return cached(not_again)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def first_available(spark, folder):
    events = table(spark, folder, "events")
    path = staging_path(spark, "snapshot")
    cd.write_snapshot(events.groupBy("event_type").agg(F.count("*").alias("n")), path)
    return cd.read_first_available(spark, staging_path(spark, "nowhere"), path)


@query("""
SELECT event_type, count(*) AS n, CAST(4 AS BIGINT) AS latest, CAST(3 AS BIGINT) AS kept
FROM events GROUP BY event_type
""")
def state_history(spark, folder):
    """Five growing states, of which the three newest are kept and the last one read."""
    events = table(spark, folder, "events")
    root = staging_path(spark, "states")
    for version in range(5):
        part = events.where(F.dayofmonth("ts") <= 7 * (version + 1))
        state = part.groupBy("event_type").agg(F.count("*").alias("n"))
        cd.commit_state(state, root, version, total=5)
        cd.prune_states(spark, root, keep=3)
    _, newest = cd.read_latest_state(spark, root)
    states = cd.list_states(spark, root)
    latest = cd.latest_index(states).first()["latest"]
    return newest.withColumns({
        "latest": F.lit(latest).cast("bigint"),
        "kept": F.lit(states.where("complete").count()).cast("bigint"),
    })


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS size FROM documents")
def resumable_map(spark, folder):
    """Interrupted once in the middle, then continued over the rest."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    stats = documents.agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).first()
    root = staging_path(spark, "resumable")
    last = stats["last"]

    def run(size):
        fn = cd.per_item(size, ["doc_id", "text"], "size", ["doc_id"])
        return cd.resumable_map(
            documents, "doc_id", fn, "doc_id bigint, size bigint", root,
            batch_rows=-(-stats["n"] // 4),
        )

    def fails_at_last(doc_id, text):
        if doc_id == last:
            raise RuntimeError("interrupted")
        return len(text)

    try:
        run(fails_at_last)
    except PySparkException as problem:
        if "interrupted" not in str(problem):
            raise
    return cd.ordered_results(run(lambda doc_id, text: len(text)), "doc_id")


EVENTS = ["event_id", "user_id", "ts", "event_type", "value"]


def _drops(spark, folder, run):
    """Put the events into a folder in two drops, earlier half first; run after each."""
    events = table(spark, folder, "events").select(*EVENTS)
    drop = staging_path(spark, "drop")
    half_span = "timestampadd(SECOND, timestampdiff(SECOND, min(ts), max(ts)) div 2, min(ts))"
    middle = events.agg(F.expr(half_span).cast("string")).first()[0]
    middle = F.lit(middle).cast("timestamp_ntz")
    for half in (F.col("ts") < middle, F.col("ts") >= middle):
        cd.append_results(events.where(half), drop)
        stream = spark.readStream.schema(events.schema).parquet(drop)
        run(stream).awaitTermination()


@query("SELECT event_id, user_id, ts, event_type, value FROM events")
def incremental_job(spark, folder):
    out, checkpoint = staging_path(spark, "out"), staging_path(spark, "checkpoint")
    _drops(spark, folder, lambda stream: cd.incremental_job(stream, lambda b: b, checkpoint, out))
    return cd.read_batches(spark, out)


@query("""
WITH span AS (SELECT min(ts) AS lo, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events)
SELECT event_id, user_id, CASE WHEN ts < lo + to_seconds(us // 1000000 // 2) THEN 0 ELSE 1 END AS commit
FROM events, span
""")
def batch_cadence(spark, folder):
    """The spec commits at the first micro-batch; the second is committed when the job ends."""
    out, checkpoint = staging_path(spark, "out"), staging_path(spark, "checkpoint")

    def store(batch, number):
        rows = batch.select("event_id", "user_id", F.lit(number).alias("commit"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    act = cd.on_batches("::5", store, staging_path(spark, "pending"))

    def run(stream):
        return (
            stream.writeStream.foreachBatch(act)
            .option("checkpointLocation", checkpoint)
            .trigger(**cd.cadence()["trigger"]).start()
        )

    _drops(spark, folder, run)
    act.flush(spark)
    return cd.read_batches(spark, out)


@query("""
SELECT user_id, avg(round(value * 100)) AS avg, arg_max(round(value * 100), event_id) AS last
FROM events GROUP BY user_id
""")
def stream_mean(spark, folder):
    out, checkpoint = staging_path(spark, "out"), staging_path(spark, "checkpoint")

    def run(stream):
        cents = stream.withColumn("cents", F.round(F.col("value") * 100))
        means = cd.stream_weighted_mean(cents, "user_id", "cents", 1, ["event_id"])

        def store(batch, number):
            batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(
                f"{out}/batch={number}"
            )

        return (
            means.writeStream.outputMode("update").foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )

    _drops(spark, folder, run)
    newest = cd.latest_by_key(cd.read_batches(spark, out), "user_id", ["number"])
    return newest.select("user_id", "avg", "last")


@query(SIX_HOURS)
def stream_throttle(spark, folder):
    out, checkpoint = staging_path(spark, "out"), staging_path(spark, "checkpoint")

    def run(stream):
        fired = cd.stream_throttle(
            stream.select("event_id", "user_id", "ts", "value"), "user_id", "ts", ["event_id"],
            seconds=6 * 3600,
        )
        return cd.incremental_job(fired, lambda b: b, checkpoint, out)

    _drops(spark, folder, run)
    return cd.read_batches(spark, out).select("event_id", "user_id", "ts", "value")


@query(SIX_HOURS)
def throttle_job(spark, folder):
    """Keys above 30 rows in a micro-batch count as hot, so most users take the split path."""
    out, checkpoint = staging_path(spark, "out"), staging_path(spark, "checkpoint")
    states = staging_path(spark, "states")

    def run(stream):
        return cd.throttle_job(
            stream.select("event_id", "user_id", "ts", "value"), "user_id", "ts", checkpoint, out,
            states, ["event_id"], seconds=6 * 3600, max_key_rows=30,
        )

    _drops(spark, folder, run)
    return cd.read_batches(spark, out)
