"""Levels, log lines and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import cadence as cd
from cadence.functions.text import formatter as cell_text
from cadence.plans.registry import query, table
from cadence.runtime import staging_path


@query("""
WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 20 WHEN 'view' THEN 10
                  WHEN 'error' THEN 40 WHEN 'purchase' THEN 30 ELSE 25 END AS level_no FROM events)
SELECT event_id, CAST(level_no AS INTEGER) AS level_no,
       CASE level_no WHEN 20 THEN 'INFO' WHEN 10 THEN 'DEBUG' WHEN 40 THEN 'ERROR'
                     WHEN 30 THEN 'WARNING' ELSE 'Level 25' END AS level
FROM e
""")
def level_map(spark, folder):
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", "INFO").when(kind == "view", "DEBUG")
        .when(kind == "error", "ERROR").when(kind == "purchase", "WARN").otherwise(" 25")
    )
    events = table(spark, folder, "events").select("event_id", cd.parse_level(text).alias("level_no"))
    return events.withColumn("level", cd.level_to_name("level_no"))


LEVEL = """CASE event_id % 5 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING'
           WHEN 3 THEN 'ERROR' ELSE 'Level 15' END"""
LEVEL_NO = "CAST([10, 20, 30, 40, 15][event_id % 5 + 1] AS INTEGER)"


def _records(spark, folder):
    names = F.array(*(F.lit(n) for n in ("DEBUG", "INFO", "WARNING", "ERROR", "Level 15")))
    return table(spark, folder, "events").select(
        "event_id", "event_type", F.substring(F.col("ts").cast("string"), 1, 19).cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("app."), "event_type").alias("logger"),
        F.lit("<module>").alias("func"),
        F.get(names, (F.col("event_id") % 5).cast("int")).alias("level"),
        F.concat(
            F.lit("event: "), F.col("event_id").cast("string"), F.lit(" "), "props"
        ).alias("message"),
    )


@query(f"""
SELECT date_trunc('second', ts) AS ts, 'app.' || event_type AS logger, '<module>' AS func,
       {LEVEL} AS level, {LEVEL_NO} AS level_no,
       'event: ' || event_id || ' ' || props AS message
FROM events WHERE event_id % 5 IN (1, 2, 3)
""")
def log_scan(spark, folder):
    path = staging_path(spark, "log")
    cd.sink_log_lines(_records(spark, folder), path, "extended")
    return cd.scan_log_lines(spark, path, "extended").where(cd.level_filter("level_no", "INFO"))


@query(f"""
SELECT date_trunc('second', ts) AS ts, 'app.' || event_type AS logger, CAST(NULL AS VARCHAR) AS func,
       {LEVEL} AS level, {LEVEL_NO} AS level_no,
       'event: ' || event_id || ' ' || props AS message
FROM events
""")
def log_stream(spark, folder):
    """The lines read as a stream of text files."""
    path, out = staging_path(spark, "log"), staging_path(spark, "out")
    cd.sink_log_lines(_records(spark, folder), path, "short")
    lines = cd.stream_log_lines(spark, path, "short")
    cd.incremental_job(lines, lambda b: b, staging_path(spark, "checkpoint"), out).awaitTermination()
    return cd.read_batches(spark, out)


@query("""
WITH p AS (SELECT event_type AS a, event_type || '/' || user_id AS b,
                  event_type || '/' || user_id || '/' || event_id AS c FROM events)
SELECT prefix, count(*) AS n
FROM (SELECT unnest([a, b, c]) AS prefix FROM p) GROUP BY prefix
""")
def path_prefixes(spark, folder):
    path = F.concat_ws("/", "event_type", "user_id", "event_id")
    prefixes = table(spark, folder, "events").select(
        F.explode(cd.path_prefixes(path, "/")).alias("prefix")
    )
    return prefixes.groupBy("prefix").agg(F.count("*").alias("n"))


@query(f"""
SELECT date_trunc('second', ts) AS ts, {LEVEL} AS level, {LEVEL_NO} AS level_no,
       'event: ' || event_id || ' ' || props AS message
FROM events
UNION ALL SELECT NULL, NULL, NULL, unnest(['  at a', '  at b']) FROM events WHERE event_type = 'error'
""")
def log_tracebacks(spark, folder):
    """Errors span three lines; the two continuation lines have no level."""
    message = F.when(F.col("event_type") == "error", F.concat("message", F.lit("\n  at a\n  at b")))
    records = _records(spark, folder).withColumn("message", F.coalesce(message, "message"))
    path = staging_path(spark, "log")
    cd.sink_log_lines(records, path, "shorter")
    return cd.scan_log_lines(spark, path, "shorter").drop("logger", "func")


@query(f"""
SELECT row_number() OVER (ORDER BY event_id) - 1 AS n, date_trunc('second', ts) AS ts,
       'app.' || event_type AS logger, {LEVEL} AS level, {LEVEL_NO} AS level_no,
       'event: ' || event_id || ' ' || props AS message,
       CASE event_type
         WHEN 'error' THEN concat_ws(chr(10), 'Traceback (most recent call last):', '',
                                     '  File "' || user_id || '"', 'ValueError: ' || event_id)
         WHEN 'click' THEN '' END AS traceback
FROM events
""")
def log_records(spark, folder):
    """Records in order of the event, errors with tracebacks of four lines, clicks with a blank
    line; read back whole and numbered over all files."""
    trace = F.concat_ws(
        "\n", F.lit("\nTraceback (most recent call last):"), F.lit(""),
        F.concat(F.lit('  File "'), F.col("user_id").cast("string"), F.lit('"')),
        F.concat(F.lit("ValueError: "), F.col("event_id").cast("string")))
    kind = F.col("event_type")
    users = table(spark, folder, "events").select("event_id", "user_id")
    records = _records(spark, folder).join(users, "event_id").withColumn("message", F.concat(
        "message", F.when(kind == "error", trace).when(kind == "click", "\n").otherwise("")))
    path = staging_path(spark, "log")
    cd.sink_log_lines(records.orderBy("event_id"), path, "short")
    whole = cd.scan_log_records(spark, path, "short")
    return cd.dense_index(whole, ["file", "record"], "n").drop("file", "record", "func")


THRESHOLDS = f"""
WITH r AS (SELECT event_id, event_type, {LEVEL_NO} AS level_no,
                  CASE event_type WHEN 'click' THEN 'PIL.Image' WHEN 'view' THEN 'PILX'
                       WHEN 'error' THEN 'git' WHEN 'purchase' THEN 'urllib3.pool.x'
                       ELSE 'app' END AS logger FROM events)
SELECT event_id, logger, level_no FROM r
"""


def _levelled(spark, folder):
    kind = F.col("event_type")
    logger = (
        F.when(kind == "click", "PIL.Image").when(kind == "view", "PILX").when(kind == "error", "git")
        .when(kind == "purchase", "urllib3.pool.x").otherwise("app")
    )
    numbers = F.array(*(F.lit(n) for n in (10, 20, 30, 40, 15)))
    level_no = F.get(numbers, (F.col("event_id") % 5).cast("int"))
    return table(spark, folder, "events").select(
        "event_id", logger.alias("logger"), level_no.alias("level_no")
    )


@query(THRESHOLDS + "WHERE level_no >= CASE WHEN event_type IN ('view', 'signup') THEN 10 ELSE 20 END")
def log_thresholds(spark, folder):
    return cd.logger_threshold_filter(_levelled(spark, folder), 10)


@query(THRESHOLDS + """
WHERE level_no >= CASE event_type WHEN 'click' THEN 40 WHEN 'error' THEN 20
                                  WHEN 'purchase' THEN 30 ELSE 15 END
""")
def log_thresholds_joined(spark, folder):
    """Thresholds as a table; the one of urllib3.pool is unset and defers to urllib3."""
    rows = [("PIL", 30), ("PIL.Image", 40), ("git", 20), ("urllib3", 30), ("urllib3.pool", 0)]
    thresholds = spark.createDataFrame(rows, "logger string, level_no int")
    return cd.logger_threshold_filter(_levelled(spark, folder), 15, thresholds)


@query("""
SELECT CAST(greatest(max(length(CAST(p_partkey AS VARCHAR))), 3) AS INTEGER) AS p_partkey,
       CAST(greatest(max(length(p_name)), 4) AS INTEGER) AS p_name,
       CAST(greatest(max(length(printf('%.2f', p_retailprice))), 5) AS INTEGER) AS p_retailprice
FROM part
""")
def column_widths(spark, folder):
    return cd.column_widths(
        table(spark, folder, "part"), ["p_partkey", "p_name", "p_retailprice"],
        ["{}", "{}", "{:.2f}"], ["key", "name", "price"],
    )


@query("""
SELECT o_orderkey, printf('%.2f', o_totalprice * 1e15) AS huge,
       format('{:,.2f}', o_totalprice) AS grouped, format('{:,}', o_custkey) AS whole,
       printf('%08d', o_custkey) AS filled, printf('%.1f', o_totalprice * 100) || '%' AS share
FROM orders
""")
def number_cells(spark, folder):
    """Cells in the usual number formats; 1e15 prices need up to 21 digits before the point."""
    orders = table(spark, folder, "orders")
    cells = {
        "huge": (F.col("o_totalprice") * 1e15, "{:.2f}", "o_totalprice"),
        "grouped": (F.col("o_totalprice"), "{:,.2f}", "o_totalprice"),
        "whole": (F.col("o_custkey"), "{:,d}", "o_custkey"),
        "filled": (F.col("o_custkey"), "{:08d}", "o_custkey"),
        "share": (F.col("o_totalprice"), "{:.1%}", "o_totalprice"),
    }
    return orders.select(
        "o_orderkey",
        *(cell_text(spec)(value, orders.schema[like].dataType).alias(name)
          for name, (value, spec, like) in cells.items()),
    )


@query("""
WITH t AS (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS a, s_name AS b,
                  printf('%.2f', s_acctbal) AS c FROM supplier
           UNION ALL SELECT NULL, 'key', 'name', 'balance'),
     w AS (SELECT *, max(length(a)) OVER () AS wa, max(length(b)) OVER () AS wb,
                  max(length(c)) OVER () AS wc FROM t)
SELECT coalesce(s_suppkey, -1) AS s_suppkey, s_suppkey IS NULL AS is_header,
       '|' || lpad(a, CAST(wa AS INTEGER), ' ') || ' |' ||
       repeat(' ', CAST((wb - length(b)) // 2 AS INTEGER)) || b ||
       repeat(' ', CAST(wb - length(b) - (wb - length(b)) // 2 AS INTEGER)) || ' |' ||
       rpad(c, CAST(wc AS INTEGER), ' ') || ' |' AS line
FROM w
""")
def text_table(spark, folder):
    suppliers = table(spark, folder, "supplier").withColumn("id", F.col("s_suppkey"))
    lines = cd.format_table(
        suppliers, ["id", "s_name", "s_acctbal"], ["key", "name", "balance"],
        ["{}", "{}", "{:.2f}"], [">", "^", "<"], pad=1, keep=["s_suppkey"],
    )
    return lines.fillna(-1, ["s_suppkey"])


@query("""
WITH t AS (SELECT n_nationkey, n_name AS a, CAST(count(c_custkey) AS VARCHAR) AS b,
                  printf('%.2f', round(sum(c_acctbal), 2)) AS c
           FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL
           UNION ALL SELECT NULL, 'ix0', 'customers', 'total'),
     w AS (SELECT *, CAST(max(length(a)) OVER () AS INTEGER) AS wa,
                  CAST(max(length(b)) OVER () AS INTEGER) AS wb,
                  CAST(max(length(c)) OVER () AS INTEGER) AS wc FROM t)
SELECT coalesce(n_nationkey, -1) AS n_nationkey, n_nationkey IS NULL AS is_header,
       '| ' || rpad(a, wa, ' ') || ' | ' || rpad(b, wb, ' ') || ' | ' || rpad(c, wc, ' ') || ' |' AS line
FROM w
""")
def dataframe_table(spark, folder):
    customers = table(spark, folder, "customer")
    nations = table(spark, folder, "nation")
    totals = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        "n_nationkey", "n_name"
    ).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    lines = cd.format_dataframe(totals, index_cols=1, keep=["n_nationkey"])
    return lines.fillna(-1, ["n_nationkey"])


@query("""
WITH t AS (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS a, s_name AS b FROM supplier
           UNION ALL SELECT NULL, 'key', 'name')
SELECT '|' || rpad(a, CAST(max(length(a)) OVER () AS INTEGER), ' ') || '|' ||
       rpad(b, CAST(max(length(b)) OVER () AS INTEGER), ' ') || '|' AS line
FROM t
""")
def text_table_file(spark, folder):
    path = staging_path(spark, "text-table")
    suppliers = table(spark, folder, "supplier")
    cd.sink_text_table(
        suppliers, path, ["s_suppkey"], names=["s_suppkey", "s_name"], header=["key", "name"]
    )
    return spark.read.text(path).withColumnRenamed("value", "line")
