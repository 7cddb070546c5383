"""Nested records, JSON and YAML documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

import cadence as cd
from cadence.plans.registry import query, table
from cadence.runtime import spread, staging_path


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_get(spark, folder):
    events = table(spark, folder, "events")
    return events.select("event_id", cd.json_get("props", "k", "bigint", strict=True).alias("k"))


@query("""
SELECT event_id,
       '{"k":' || (props->>'$.k') || ',"user":{"id":' || user_id || '}}' AS added,
       '{"k":' || event_id || '}' AS replaced,
       '{"k":' || (props->>'$.k') || '}' AS kept
FROM events
""")
def json_set(spark, folder):
    number = {c: F.col(c).cast("string") for c in ("user_id", "event_id")}
    return table(spark, folder, "events").select(
        "event_id",
        cd.json_set("props", "user.id", number["user_id"]).alias("added"),
        cd.json_set("props", "k", number["event_id"]).alias("replaced"),
        cd.json_set("props", "k", number["event_id"], soft=True).alias("kept"),
    )


@query("""
SELECT e.event_id, j.key AS path, CAST(j.value AS VARCHAR) AS value
FROM events e, json_each(e.props) j
""")
def json_flatten(spark, folder):
    return cd.flatten_json(table(spark, folder, "events"), "event_id", "props")


NESTED = """
WITH c AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment, n_name, r_name
           FROM customer JOIN nation ON c_nationkey = n_nationkey
                         JOIN region ON n_regionkey = r_regionkey)
"""


def _nested_customers(spark, folder):
    """(c_custkey, c struct<name, acct struct<bal, seg>, geo struct<nation, region>>)"""
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = table(spark, folder, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return customers.select(
        "c_custkey",
        F.struct(
            F.col("c_name").alias("name"),
            F.struct(F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")).alias("acct"),
            F.struct(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).alias("geo"),
        ).alias("c"),
    )


@query(NESTED + """
SELECT c_custkey, 'name' AS path, c_name AS txt, CAST(NULL AS DOUBLE) AS num FROM c
UNION ALL SELECT c_custkey, 'acct.bal', NULL, c_acctbal FROM c
UNION ALL SELECT c_custkey, 'acct.seg', c_mktsegment, NULL FROM c
UNION ALL SELECT c_custkey, 'geo.nation', n_name, NULL FROM c
UNION ALL SELECT c_custkey, 'geo.region', r_name, NULL FROM c
""")
def json_flatten_nested(spark, folder):
    docs = _nested_customers(spark, folder).withColumn("doc", F.to_json("c"))
    leaves = cd.flatten_json(docs, "c_custkey", "doc")
    quoted = F.col("value").startswith('"')
    return leaves.select(
        "c_custkey", "path",
        F.when(quoted, F.btrim("value", F.lit('"'))).alias("txt"),
        F.when(~quoted, F.col("value").try_cast("double")).alias("num"),
    )


@query(NESTED + """
SELECT c_custkey, 'name' AS path, '"' || c_name || '"' AS txt, CAST(NULL AS DOUBLE) AS num FROM c
UNION ALL SELECT c_custkey, 'geo',
       '{"nation":"' || n_name || '","region":"' || r_name || '"}', NULL FROM c
UNION ALL SELECT c_custkey, 'acct.seg', '"' || c_mktsegment || '"', NULL FROM c
UNION ALL SELECT c_custkey, 'acct.bal', NULL, c_acctbal FROM c
""")
def json_flatten_keep(spark, folder):
    docs = _nested_customers(spark, folder).withColumn("doc", F.to_json("c"))
    leaves = cd.flatten_json(docs, "c_custkey", "doc", keep=["geo"])
    number = F.col("value").try_cast("double")
    return leaves.select(
        "c_custkey", "path", F.when(number.isNull(), F.col("value")).alias("txt"), number.alias("num")
    )


def _varied_documents(spark, folder):
    """Event documents in the shapes the merge rules tell apart."""
    kind, k = F.col("event_type"), cd.json_get("props", "k")
    doc = (
        F.when(kind == "click", '{"a":5}')
        .when(kind == "error", '{"a":{}}')
        .when(kind == "view", F.concat(F.lit('{"src":null,"k":'), k, F.lit("}")))
        .when(kind == "signup", "{}")
        .otherwise(F.col("props"))
    )
    return table(spark, folder, "events").select("event_id", doc.alias("doc"))


DEFAULTS = {"k": 0, "src": "web", "a": {"b": 1}}


@query("""
SELECT event_id, 'k' AS path,
       CASE WHEN event_type IN ('click', 'error', 'signup') THEN '0' ELSE props->>'$.k' END AS value
FROM events
UNION ALL
SELECT event_id, 'src', CASE event_type WHEN 'view' THEN 'null' ELSE '"web"' END FROM events
UNION ALL
SELECT event_id, CASE event_type WHEN 'click' THEN 'a' ELSE 'a.b' END,
       CASE event_type WHEN 'click' THEN '5' ELSE '1' END FROM events
""")
def json_defaults(spark, folder):
    rows = cd.flatten_json(_varied_documents(spark, folder), "event_id", "doc", keep_empty=True)
    config = [("k", "0"), ("src", '"web"'), ("a.b", "1")]
    defaults = spark.createDataFrame(config, "path string, value string")
    return cd.merge_defaults_long(rows, defaults, "event_id")


@query("""
SELECT event_id, 'k' AS path,
       CASE WHEN event_type IN ('click', 'error', 'signup') THEN CAST(user_id AS VARCHAR)
            ELSE props->>'$.k' END AS value
FROM events
UNION ALL
SELECT event_id, 'src', 'null' FROM events WHERE event_type = 'view'
UNION ALL
SELECT event_id, CASE event_type WHEN 'click' THEN 'a' ELSE 'a.b' END,
       CASE event_type WHEN 'click' THEN '5' ELSE CAST(event_id AS VARCHAR) END FROM events
""")
def json_own_defaults(spark, folder):
    rows = cd.flatten_json(_varied_documents(spark, folder), "event_id", "doc", keep_empty=True)
    default = F.explode(F.create_map(
        F.lit("k"), F.col("user_id").cast("string"), F.lit("a.b"), F.col("event_id").cast("string")
    )).alias("path", "value")
    own = table(spark, folder, "events").select("event_id", default)
    return cd.merge_defaults_long(rows, own, "event_id")


@query("""
SELECT event_id,
       '{"a":' || CASE event_type WHEN 'click' THEN '5' ELSE '{"b":1}' END ||
       ',"k":' || CASE WHEN event_type IN ('click', 'error', 'signup') THEN '0'
                       ELSE props->>'$.k' END ||
       ',"src":' || CASE event_type WHEN 'view' THEN 'null' ELSE '"web"' END || '}' AS doc
FROM events
""")
def json_merge(spark, folder):
    docs = _varied_documents(spark, folder)
    return docs.select("event_id", cd.merge_json_defaults("doc", DEFAULTS).alias("doc"))


@query("""
SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, CAST(event_id % 10 AS INTEGER) AS z,
       CAST(2 AS INTEGER) AS n
FROM events
""")
def map_defaults(spark, folder):
    given = F.create_map(F.lit("k"), F.lit(0), F.lit("z"), (F.col("event_id") % 10).cast("int"))
    docs = table(spark, folder, "events").select(
        "event_id", F.from_json("props", "map<string,int>").alias("own"), given.alias("given")
    )
    merged = docs.select("event_id", cd.merge_defaults(docs, "own", "given").alias("m"))
    return merged.select(
        "event_id", cd.get_path(merged, "m.k").alias("k"), cd.get_path(merged, "m.z").alias("z"),
        F.size("m").alias("n"),
    )


@query(NESTED + """
SELECT c_custkey, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg, n_name AS nation,
       r_name AS region, 'basic' AS tier, 'none' AS note
FROM c
""")
def struct_defaults(spark, folder):
    customers = _nested_customers(spark, folder)
    given = F.struct(
        F.struct(F.lit("none").alias("note"), F.lit(0.0).alias("bal")).alias("acct"),
        F.lit("basic").alias("tier"),
    )
    docs = customers.withColumn("given", given)
    merged = docs.select("c_custkey", cd.merge_defaults(docs, "c", "given").alias("m"))
    return merged.select("c_custkey", "m.name", "m.acct.*", "m.geo.*", "m.tier")


@query(NESTED + """
SELECT c_custkey, c_name AS "c.name", c_acctbal AS "c.acct.bal", c_mktsegment AS "c.acct.seg",
       n_name AS "c.geo.nation", r_name AS "c.geo.region"
FROM c
""")
def struct_flatten(spark, folder):
    return cd.flatten_struct(_nested_customers(spark, folder))


@query(NESTED + """
SELECT c_custkey, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg, n_name AS nation,
       r_name AS region
FROM c
""")
def struct_unflatten(spark, folder):
    """Flatten, rebuild, and read through the rebuilt structs."""
    rebuilt = cd.unflatten_struct(cd.flatten_struct(_nested_customers(spark, folder)))
    leaves = ("c.name", "c.acct.bal", "c.acct.seg", "c.geo.nation", "c.geo.region")
    return rebuilt.select("c_custkey", *(cd.get_path(rebuilt, p) for p in leaves)).toDF(
        "c_custkey", *(p.split(".")[-1] for p in leaves)
    )


@query(NESTED + """
SELECT c_custkey, c_name AS name, c_acctbal * 2 AS bal, c_mktsegment AS seg, n_name AS nation,
       r_name AS region, n_name AS zone
FROM c
""")
def set_path(spark, folder):
    docs = _nested_customers(spark, folder)
    docs = cd.set_path(docs, "c.acct.bal", F.col("c.acct.bal") * 2)
    docs = cd.set_path(docs, "c.acct.seg", F.lit("unused"), soft=True)
    docs = cd.set_path(docs, "c.extra.zone", F.col("c.geo.nation"))
    return docs.select("c_custkey", "c.name", "c.acct.*", "c.geo.*", "c.extra.*")


@query("""
SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, 'tag' AS tag, user_id AS seen, event_type AS kind,
       CAST(event_id % 3 AS INTEGER) AS old_hits, CAST(NULL AS INTEGER) AS old_rank,
       CAST(7 AS INTEGER) AS new_hits, CAST(event_id % 5 AS INTEGER) AS new_rank, 'low' AS level
FROM events
""")
def set_path_mixed(spark, folder):
    """Paths into a variant, and into structs held by a map, whose type grows on the way."""
    docs = table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", F.parse_json("props").alias("v"),
        F.create_map(F.lit("old"), F.struct((F.col("event_id") % 3).cast("int").alias("hits"))).alias("m"))
    docs = cd.set_path(docs, "v.user.seen", F.col("user_id"))
    docs = cd.set_path(docs, "v.user.note", F.struct(F.lit("tag").alias("tag"), F.col("event_type").alias("kind")))
    docs = cd.set_path(docs, "v.k", F.lit(-1), soft=True)
    docs = cd.set_path(docs, "m.new.hits", F.lit("7"))
    docs = cd.set_path(docs, "m.new.rank", (F.col("event_id") % 5).cast("int"))
    docs = cd.set_path(docs, "m.old.info.level", F.lit("low"))

    def at(path, dtype="string"):
        return cd.get_path(docs, path, strict=False, dtype=dtype)

    return docs.select(
        "event_id", at("v.k", "int").alias("k"), at("v.user.note.tag").alias("tag"),
        at("v.user.seen", "bigint").alias("seen"), at("v.user.note.kind").alias("kind"),
        at("m.old.hits").alias("old_hits"), at("m.old.rank").alias("old_rank"),
        at("m.new.hits").alias("new_hits"), at("m.new.rank").alias("new_rank"),
        at("m.old.info.level").alias("level"))


@query("""
SELECT event_id,
       CASE event_type
         WHEN 'click' THEN '{"a":5,"k":' || user_id || ',"src":"web"}'
         WHEN 'error' THEN '{"a":{"b":' || event_id || ',"c":{"d":[1]}},"k":' || user_id || ',"src":"web"}'
         WHEN 'view' THEN '{"a":{"b":' || event_id || ',"c":{"d":[1]}},"k":' || (props->>'$.k') || ',"src":null}'
         WHEN 'signup' THEN '{"a":{"b":' || event_id || ',"c":{"d":[1]}},"k":' || user_id || ',"src":"web"}'
         ELSE '{"a":{"b":' || event_id || ',"c":{"d":[1]}},"k":' || (props->>'$.k') || ',"src":"web"}' END AS doc
FROM events
""")
def variant_defaults(spark, folder):
    """Each document's own defaults, held in a struct, merged into its variant."""
    inner = F.struct(F.struct(F.array(F.lit(1)).alias("d")).alias("c"), F.col("event_id").alias("b"))
    given = table(spark, folder, "events").select("event_id", F.struct(
        F.col("user_id").alias("k"), F.lit("web").alias("src"), inner.alias("a")).alias("given"))
    docs = _varied_documents(spark, folder).join(given, "event_id").withColumn("doc", F.parse_json("doc"))
    return docs.select("event_id", F.to_json(cd.merge_defaults(docs, "doc", "given")).alias("doc"))


@query("""
SELECT event_id, CAST(event_id % 3 AS INTEGER) AS own_hits, event_type AS own_kind, 5.0::DOUBLE AS own_rate,
       CAST(9 AS INTEGER) AS only_hits, 'none' AS only_kind, 2.0::DOUBLE AS only_rate,
       CAST(event_id % 4 AS INTEGER) AS alone_hits, CAST(NULL AS VARCHAR) AS alone_rate
FROM events
""")
def map_struct_defaults(spark, folder):
    """Structs held by maps of both sides; fields and keys come from either."""
    def entry(hits, **more):
        return F.struct(hits.alias("hits"), *(v.alias(k) for k, v in more.items()))

    kind = F.col("event_type")
    docs = table(spark, folder, "events").select(
        "event_id",
        F.create_map(
            F.lit("own"), entry((F.col("event_id") % 3).cast("int"), kind=kind),
            F.lit("alone"), entry((F.col("event_id") % 4).cast("int"), kind=kind)).alias("own"),
        F.create_map(
            F.lit("own"), entry(F.lit("8"), kind=F.lit("none"), rate=F.lit(5.0)),
            F.lit("only"), entry(F.lit("9"), kind=F.lit("none"), rate=F.lit(2.0))).alias("given"))
    merged = docs.select("event_id", cd.merge_defaults(docs, "own", "given").alias("m"))

    def at(path):
        return cd.get_path(merged, f"m.{path}").alias(path.replace(".", "_"))

    return merged.select(
        "event_id", *map(at, ("own.hits", "own.kind", "own.rate", "only.hits", "only.kind", "only.rate",
                              "alone.hits")), at("alone.rate").cast("string").alias("alone_rate"))


@query("""
SELECT event_id, '{"a":' || event_id || '.0,"b":[1e5,-0,' || repeat('9', 30) || (100000000000 + event_id) ||
       '],"c":"1.0"}' AS doc
FROM events
""")
def canonical_numbers(spark, folder):
    """Numbers that stay as they are written, among sorted keys."""
    ident = F.col("event_id")
    doc = F.concat(
        F.lit('{"c": "1.0", "b": [1e5, -0, '), F.lit("9" * 30), (ident + 100000000000).cast("string"),
        F.lit('], "a": '), ident.cast("string"), F.lit(".0}"))
    return table(spark, folder, "events").select("event_id", cd.canonical_json(doc).alias("doc"))


@query("""
SELECT event_id,
       '{"a":{"x":' || user_id || ',"y":"' || event_type || '"},"z":' || event_id || '}' AS doc
FROM events
""")
def canonical_json(spark, folder):
    inner = F.struct(F.col("event_type").alias("y"), F.col("user_id").alias("x"))
    doc = F.to_json(F.struct(F.col("event_id").alias("z"), inner.alias("a")))
    return table(spark, folder, "events").select("event_id", cd.canonical_json(doc).alias("doc"))


@query("""
SELECT o_orderkey, '{' || chr(10) || '    "a": {' || chr(10) || '        "key": ' || o_orderkey || ',' ||
       chr(10) || '        "status": "' || o_orderstatus || '"' || chr(10) || '    },' || chr(10) ||
       '    "z": ' || o_custkey || chr(10) || '}' AS doc
FROM orders
""")
def pretty_json(spark, folder):
    inner = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"))
    doc = F.to_json(F.struct(F.col("o_custkey").alias("z"), inner.alias("a")))
    return table(spark, folder, "orders").select("o_orderkey", cd.pretty_json(doc).alias("doc"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def json_lines(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"
    )
    path = staging_path(spark, "json-lines")
    cd.sink_json(orders, path)
    return spark.read.schema(orders.schema).json(path)


CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal FROM customer"
FILE_ROWS = 5_000  # customers per document file


def _customer_files(spark, folder, options=None):
    """Folder of JSON documents, one per file, each holding up to FILE_ROWS customers."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    # c_custkey is unique, so a group holds at most FILE_ROWS rows
    docs = customers.groupBy(F.expr(f"c_custkey div {FILE_ROWS}").alias("part")).agg(
        F.collect_list(F.struct(*customers.columns)).alias("rows")
    )
    path = staging_path(spark, "json")
    text = docs.select(F.to_json(F.struct("*"), options or {}))
    text.write.option("maxRecordsPerFile", 1).text(path)
    return path, customers.schema


@query(CUSTOMERS)
def json_scan(spark, folder):
    path, row = _customer_files(spark, folder, {"pretty": "true"})
    schema = T.StructType().add("part", T.LongType()).add("rows", T.ArrayType(row))
    return cd.scan_json(spark, path, schema).select(F.inline("rows"))


@query(CUSTOMERS)
def json_scan_variant(spark, folder):
    path, row = _customer_files(spark, folder)
    docs = cd.scan_json(spark, path)
    rows = cd.get_path(docs, "doc.rows", dtype=f"array<{row.simpleString()}>")
    return docs.select(F.inline(rows))


@query(CUSTOMERS)
def yaml_scan(spark, folder):
    """Each file is one YAML mapping from customer to record, a line per customer."""
    line = F.concat(
        F.col("c_custkey").cast("string"), F.lit(': {name: "'), F.col("c_name"),
        F.lit('", balances: ['), F.col("c_acctbal").cast("string"), F.lit(", null]}"),
    )
    path = staging_path(spark, "yaml")
    customers = table(spark, folder, "customer").select(line)
    customers.write.option("maxRecordsPerFile", FILE_ROWS).text(path)
    docs = cd.scan_yaml(spark, path)
    records = F.from_json("doc", "map<string,struct<name:string,balances:array<double>>>")
    return docs.select(F.explode(records).alias("key", "r")).select(
        F.col("key").cast("bigint").alias("c_custkey"), F.col("r.name").alias("c_name"),
        F.get("r.balances", F.lit(0)).alias("c_acctbal"),
    )


def _yaml_text(key, name, balance):
    return F.concat(
        F.lit("key: "), F.col(key).cast("string"), F.lit('\nwho: {name: "'), F.col(name),
        F.lit('"}\nbalances:\n- '), F.col(balance).cast("string"), F.lit("\n- null\n"),
    )


@query("""
SELECT c_custkey, c_name AS name, c_acctbal AS balance, c_mktsegment = 'BUILDING' AS repeated
FROM customer
""")
def yaml_documents(spark, folder):
    """Some documents repeat a key, which the strict form reports as their error."""
    text = _yaml_text("c_custkey", "c_name", "c_acctbal")
    repeated = F.concat(text, F.lit("key: again\n"))
    text = F.when(F.col("c_mktsegment") == "BUILDING", repeated).otherwise(text)
    customers = spread(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    docs = customers.select(
        "c_custkey",
        cd.parse_yaml(text, on_error="row")["error"].contains("'key'").alias("hit"),
        cd.parse_yaml(text, strict=False)["doc"].alias("doc"),
    )
    return docs.select(
        "c_custkey",
        cd.json_get("doc", "who.name").alias("name"),
        F.expr("variant_get(parse_json(doc), '$.balances[0]', 'double')").alias("balance"),
        F.coalesce("hit", F.lit(False)).alias("repeated"),
    )
