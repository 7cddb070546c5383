"""Steps, means, positions, batches, key sets and throttles."""

from __future__ import annotations

from pyspark.sql import functions as F

import cadence as cd
from cadence.plans.registry import query, table


@query("""
SELECT event_id, user_id, event_type FROM events
WHERE event_id IN (0, 1) OR (event_id >= 10 AND event_id % 5 = 0) OR event_id % 25 = 0
""")
def step_filter(spark, folder):
    events = table(spark, folder, "events")
    fires = cd.step_filter("event_id", "0,1:10,:5+::25")
    return events.where(fires).select("event_id", "user_id", "event_type")


@query("""
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderkey IN (3, 50) OR (o_orderkey BETWEEN 10 AND 2000 AND o_orderkey % 7 = 0)
""")
def step_filter_bounded(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.where(cd.step_clause("o_orderkey", "3,50:10,2000:7")).select(
        "o_orderkey", "o_totalprice"
    )


@query("""
SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS avg_discount,
       count(*) AS n
FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_returnflag
""")
def step_sampled_discount(spark, folder):
    lineitem = table(spark, folder, "lineitem").where(cd.step_filter("l_orderkey", "::5"))
    return lineitem.groupBy("l_returnflag").agg(
        F.round(cd.weighted_mean("l_discount", "l_quantity"), 6).alias("avg_discount"),
        F.count("*").alias("n"),
    )


@query("""
SELECT l_returnflag, l_linestatus,
       round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS avg_discount,
       last(l_discount ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice,
            l_discount) AS last_discount
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def weighted_mean(spark, folder):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"]
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(cd.weighted_mean("l_discount", "l_quantity"), 6).alias("avg_discount"),
        cd.last_value("l_discount", *order).alias("last_discount"),
    )


@query("""
WITH e AS (SELECT *, CAST(props->>'$.k' AS DOUBLE) AS w FROM events)
SELECT user_id, user_id % 7 AS part, arg_max(value, event_id) AS last,
       round(sum(value * w) / nullif(sum(w), 0), 6) AS avg,
       round(sum(value * w), 4) AS sum, sum(w) AS count
FROM (SELECT * REPLACE (CASE WHEN user_id % 7 = 3 THEN 0 ELSE w END AS w) FROM e) GROUP BY user_id
""")
def weighted_summary(spark, folder):
    """A seventh of the users has no weight at all, so no mean either."""
    weight = F.when(F.col("user_id") % 7 == 3, 0.0).otherwise(cd.json_get("props", "k", "double"))
    events = table(spark, folder, "events").withColumn("w", weight)
    summary = cd.weighted_summary("value", "w", ["event_id"])
    rows = events.groupBy("user_id").agg(summary.alias("s"))
    return rows.select(
        "user_id", (F.col("user_id") % 7).alias("part"), "s.last", F.round("s.avg", 6).alias("avg"), F.round("s.sum", 4).alias("sum"),
        "s.count",
    )


# A key with a third of all rows and one that is NULL, beside the ordinary ones.
SKEWED = "CASE WHEN event_id % 3 = 0 THEN -1 WHEN user_id % 5 = 0 THEN NULL ELSE user_id END"


def _skewed(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return events.withColumn("user_id", F.expr(SKEWED))


def _running_mean(key, value, weight):
    return f"""
SELECT event_id, user_id, round(sum(v * w) OVER u / sum(w) OVER u, 6) AS avg
FROM (SELECT * REPLACE ({key} AS user_id), {value} AS v, {weight} AS w FROM events)
WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
"""


def _running(events, value, weight):
    out = cd.running_weighted_mean(events, value, weight, ["user_id"], ["ts", "event_id"])
    return out.select("event_id", "user_id", F.round("avg", 6).alias("avg"))


# cents are whole numbers, so their sums do not depend on the order of addition
@query(_running_mean("user_id", "round(value * 100)", "1.0::DOUBLE + event_id % 3"))
def running_mean(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return _running(events, F.round(F.col("value") * 100), 1.0 + F.col("event_id") % 3)


@query(_running_mean(SKEWED, "round(value * 100)", "1.0::DOUBLE + event_id % 3"))
def running_mean_split(spark, folder):
    return _running(
        _skewed(spark, folder), F.round(F.col("value") * 100), 1.0 + F.col("event_id") % 3
    )


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS idx
FROM orders
""")
def dense_index(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return cd.dense_index(orders, [F.col("o_totalprice").desc(), "o_orderkey"]).drop("o_totalprice")


def _key_index(key):
    return f"""
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i
FROM (SELECT * REPLACE ({key} AS user_id) FROM events)
"""


@query(_key_index("user_id"))
def key_index(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return cd.key_index(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(_key_index(SKEWED))
def key_index_split(spark, folder):
    events = _skewed(spark, folder).drop("value")
    return cd.key_index(events, ["user_id"], ["ts", "event_id"]).drop("ts")


BATCHES = """
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i,
                  count(*) OVER () AS n FROM orders),
     k AS (SELECT *, (n - 1) // 700 + 1 AS k FROM p),
     q AS (SELECT *, n // k AS q, n % k AS r FROM k),
     b AS (SELECT o_orderkey, CASE WHEN i < r * (q + 1) THEN i // (q + 1)
                                   ELSE r + (i - r * (q + 1)) // q END AS batch_id FROM q)
"""


def _batches(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return cd.balanced_batches(orders, "o_orderkey", 700)


@query(BATCHES + "SELECT o_orderkey, batch_id FROM b")
def balanced_batches(spark, folder):
    return _batches(spark, folder)


@query(BATCHES + "SELECT batch_id, count(*) AS n FROM b GROUP BY batch_id")
def batch_sizes(spark, folder):
    return _batches(spark, folder).groupBy("batch_id").agg(F.count("*").alias("n"))


def _key_batches(key):
    return f"""
WITH o AS (SELECT o_orderkey, {key} AS p FROM orders),
     p AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY o_orderkey) - 1 AS i,
                  count(*) OVER (PARTITION BY p) AS n FROM o),
     k AS (SELECT *, (n - 1) // 150 + 1 AS k FROM p),
     q AS (SELECT *, n // k AS q, n % k AS r FROM k)
SELECT o_orderkey, p AS o_orderpriority,
       CASE WHEN i < r * (q + 1) THEN i // (q + 1) ELSE r + (i - r * (q + 1)) // q END AS batch_id
FROM q
"""


@query(_key_batches("o_orderpriority"))
def key_batches(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return cd.key_batches(orders, ["o_orderpriority"], ["o_orderkey"], 150)


UNEVEN = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END"


@query(_key_batches(UNEVEN))
def key_batches_split(spark, folder):
    """The NULL priority holds a third of the rows."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.expr(UNEVEN).alias("o_orderpriority")
    )
    return cd.key_batches(orders, ["o_orderpriority"], ["o_orderkey"], 150)


@query("""
SELECT event_id, user_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3
""")
def keep_latest(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return cd.keep_latest(events, "user_id", ["ts", "event_id"], 3)


@query("""
SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id
FROM events GROUP BY user_id
""")
def latest_state(spark, folder):
    events = table(spark, folder, "events")
    return events.groupBy("user_id").agg(
        cd.last_value("event_type", "event_id").alias("event_type"),
        F.max("event_id").alias("event_id"),
    )


@query("""
SELECT doc_id, lang FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def remaining_items(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang")
    return cd.remaining_items(documents, table(spark, folder, "labels"), "doc_id")


@query("""
SELECT event_id, user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type
                           ORDER BY value >= 20 DESC, ts DESC, event_id DESC) = 1
""")
def upsert_latest(spark, folder):
    """Large events replace small ones, whichever came last."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", "value")
    keys = ["user_id", "event_type"]

    def newest(rows):
        return cd.latest_by_key(rows, keys, ["ts", "event_id"])

    large = F.col("value") >= 20
    return cd.upsert_results(newest(events.where(~large)), newest(events.where(large)), keys).drop("ts")


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def duplicate_keys(spark, folder):
    return cd.duplicate_keys(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT count(*) AS rows, count(*) - count(DISTINCT o_orderkey) AS repeated FROM orders")
def unique_keys_ok(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return cd.assert_unique(orders, "o_orderkey").agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("o_orderkey")).alias("repeated"),
    )


FIRED = ["event_id", "user_id", "ts", "value"]
POSITIONS = """
p AS (SELECT event_id, user_id, ts, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
"""
SIX_HOURS = f"""
WITH RECURSIVE {POSITIONS},
nx AS (SELECT user_id, i, min(i) OVER (PARTITION BY user_id ORDER BY ts
              RANGE BETWEEN INTERVAL 6 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS j FROM p),
f AS (SELECT user_id, i FROM p WHERE i = 0
      UNION ALL
      SELECT f.user_id, nx.j AS i FROM f JOIN nx ON f.user_id = nx.user_id AND f.i = nx.i
      WHERE nx.j IS NOT NULL)
SELECT p.event_id, p.user_id, p.ts, p.value FROM f JOIN p ON f.user_id = p.user_id AND f.i = p.i
"""
MIXED = f"""
WITH RECURSIVE {POSITIONS},
t AS (SELECT user_id, i, min(i) OVER (PARTITION BY user_id ORDER BY ts
              RANGE BETWEEN INTERVAL 12 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS j FROM p),
nx AS (SELECT user_id, i, least(coalesce(j, i + 4), i + 4, (i // 9 + 1) * 9) AS j FROM t),
f AS (SELECT user_id, i FROM p WHERE i = 0
      UNION ALL
      SELECT f.user_id, nx.j AS i FROM f JOIN nx ON f.user_id = nx.user_id AND f.i = nx.i)
SELECT p.event_id, p.user_id, p.ts, p.value FROM f JOIN p ON f.user_id = p.user_id AND f.i = p.i
"""


def _throttled(spark, folder, **options):
    events = table(spark, folder, "events").select(*FIRED)
    return cd.throttle(events, "user_id", "ts", ["event_id"], **options)


@query(SIX_HOURS)
def throttle_seconds(spark, folder):
    return _throttled(spark, folder, seconds=6 * 3600)


@query(SIX_HOURS)
def throttle_seconds_split(spark, folder):
    """Keys above 60 rows count as hot, so most users take the split path."""
    return _throttled(spark, folder, seconds=6 * 3600, max_key_rows=60)


@query(MIXED)
def throttle_mixed(spark, folder):
    return _throttled(spark, folder, seconds=12 * 3600, iters=4, step_spec="::9")


@query(MIXED)
def throttle_mixed_split(spark, folder):
    return _throttled(
        spark, folder, seconds=12 * 3600, iters=4, step_spec="::9", max_key_rows=60
    )


@query(f"WITH {POSITIONS} SELECT event_id, user_id, ts, value FROM p WHERE (i + 1) % 7 = 0")
def throttle_iters(spark, folder):
    return _throttled(spark, folder, iters=7)


@query(f"""
WITH {POSITIONS}
SELECT event_id, user_id, ts, value FROM p WHERE i % 10 = 0 OR i % 10 IN (3, 6, 9)
""")
def throttle_spec_iters(spark, folder):
    return _throttled(spark, folder, iters=3, step_spec="::10")
