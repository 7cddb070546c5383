"""JSON documents as rows of (path, value): flatten, and merge with defaults."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.json_text import OBJECT, as_object
from cadence.functions.text import path_prefixes
from cadence.operators.ordering import columns

# Defaults of a configuration that stand in one array.
CONFIG_BLOCK = 256


def flattened(doc: Column, sep: str = ".", keep: Collection[str] = (),
              keep_empty: bool = False) -> Column:
    """JSON text to an array of (path, value variant) leaves, any depth, one pass.

    After the top level it goes on in rounds, each opening the objects the round before
    found.  A document has no more levels than opening braces, and rounds after its last
    level do nothing.
    """
    def node(path: Column, value: Column) -> Column:
        """Entry with the members to open; they are NULL for a leaf."""
        members = as_object(value)
        if keep:
            members = F.when(~path.isin(*keep), members)
        return F.struct(path.alias("path"), value.alias("value"), members.alias("members"))

    def leaf(path: Column, value: Column) -> Column:
        return F.struct(path.alias("path"), value.alias("value"))

    def is_leaf(entry: Column) -> Column:
        members = entry["members"]
        return members.isNull() | (F.size(members) == 0) if keep_empty else members.isNull()

    def opened(parent: Column) -> Column:
        def child(member: Column) -> Column:
            above, name = parent["path"], member["key"]
            # an empty parent name counts as no parent
            path = F.when(above == "", name).otherwise(F.concat(above, F.lit(sep), name))
            return node(path, member["value"])

        return F.transform(F.map_entries(parent["members"]), child)

    def one_level(state: Column, _: Column) -> Column:
        leaves = F.transform(
            F.filter(state["open"], is_leaf), lambda n: leaf(n["path"], n["value"])
        )
        deeper = F.flatten(F.transform(F.filter(state["open"], lambda n: ~is_leaf(n)), opened))
        advanced = F.struct(F.concat(state["done"], leaves).alias("done"), deeper.alias("open"))
        return F.when(F.size(state["open"]) == 0, state).otherwise(advanced)

    bad = F.raise_error(F.lit("the document is not a JSON object")).cast(OBJECT)
    top = F.map_entries(F.coalesce(as_object(F.parse_json(doc)), bad))
    start = F.struct(
        F.array().cast("array<struct<path:string,value:variant>>").alias("done"),
        F.transform(top, lambda m: node(m["key"], m["value"])).alias("open"),
    )
    braces = F.length(doc) - F.length(F.replace(doc, F.lit("{"), F.lit("")))
    nested = F.aggregate(
        F.sequence(F.lit(1), braces), start, one_level, lambda s: _last_of_each_path(s["done"])
    )
    flat = F.transform(top, lambda m: leaf(m["key"], m["value"]))
    return F.when(braces == 1, flat).when(doc.isNotNull(), nested)


def _last_of_each_path(entries: Column) -> Column:
    """Different keys may spell one path (``{"a.b":..}`` and ``{"a":{"b":..}}``)."""
    def later(entry: Column, i: Column) -> Column:
        rest = F.slice(entries, i + 2, F.size(entries))
        return ~F.exists(rest, lambda other: other["path"] == entry["path"])

    paths = F.transform(entries, lambda e: e["path"])
    unique = F.size(F.array_distinct(paths)) == F.size(entries)
    return F.when(unique, entries).otherwise(F.filter(entries, later))


def flatten_json(df: DataFrame, key: str | Sequence[str], doc: str, sep: str = ".",
                 keep: Collection[str] = (), keep_empty: bool = False) -> DataFrame:
    """Rows (key..., path, value) for every leaf; ``value`` is JSON text.

    Arrays and nulls are leaves, paths in ``keep`` stay whole, and empty objects vanish
    unless ``keep_empty``, in which case an empty document gives a row with NULL path.
    """
    key = [key] if isinstance(key, str) else list(key)
    entries = flattened(columns(doc)[0], sep, keep, keep_empty)
    # the plain explode would add a filter that parses every document a second time
    opened = df.select(*columns(key), F.explode_outer(entries).alias("__e"))
    value = F.to_json("__e.value")
    if keep_empty:
        value = F.coalesce(value, F.lit("{}"))
    else:
        opened = opened.where("__e is not null")
    return opened.select(*columns(key), F.col("__e.path").alias("path"), value.alias("value"))


def merge_defaults_long(user_rows: DataFrame, defaults: DataFrame,
                        row_id: str | Sequence[str], sep: str = ".") -> DataFrame:
    """Merge (row_id..., path, value) documents with ``defaults``.

    A default leaf is added unless the document has something at that path, below it,
    or a leaf above it.  An empty object ``{}`` is a node, not a leaf, and its row goes
    away once something lies below it.  A document without any content is a row with
    NULL path, as ``flatten_json(keep_empty=True)`` writes it.

    ``defaults`` with the ``row_id`` columns holds each document's own defaults and is
    joined; without them it is a configuration (path, value) every document receives,
    of any size: it stays a table, and is counted to be dealt into blocks.
    """
    row_id = [row_id] if isinstance(row_id, str) else list(row_id)
    if set(row_id) <= set(defaults.columns):
        return _merge_own_defaults(user_rows, defaults, row_id, sep)
    return _merge_config(user_rows, defaults, row_id, sep)


def _config_blocks(defaults: DataFrame, sep: str) -> tuple[DataFrame, int]:
    """Defaults (path, value, the paths above it, block), and the number of blocks.

    A block holds about ``CONFIG_BLOCK`` defaults and is what one array of a row holds.
    """
    given = defaults.select("path", "value").where("path is not null")
    blocks = max(1, -(-given.count() // CONFIG_BLOCK))
    prefixes = path_prefixes("path", sep)
    return given.select(
        F.pmod(F.xxhash64("path"), F.lit(blocks)).alias("__block"), "path", "value",
        F.slice(prefixes, F.lit(1), F.size(prefixes) - 1).alias("above"),
    ), blocks


def _merge_config(user_rows: DataFrame, defaults: DataFrame, row_id: list[str],
                  sep: str) -> DataFrame:
    """Paths of both sides meet by their prefixes; one shuffle on the row id brings together
    what a document has at paths that matter, which is at most its own paths and prefixes."""
    given, blocks = _config_blocks(defaults, sep)
    user_rows = user_rows.select(*columns([*row_id, "path", "value"]))
    path, is_node = F.col("path"), F.col("value") == "{}"
    # places where a document's content decides on defaults: at them, or below them
    at_default = given.select("__block", F.col("path").alias("__at"), F.lit(True).alias("__is"))
    above = given.select(
        "__block", F.explode("above").alias("__at"), F.lit(False).alias("__is")
    ).distinct()
    places = at_default.unionByName(above).groupBy("__at").agg(
        F.collect_set(F.struct("__block", "__is")).alias("__of"))
    met = (
        user_rows.select(
            *columns(row_id), F.explode_outer(path_prefixes("path", sep)).alias("__at"),
            path.alias("__path"), is_node.alias("__node"))
        .withColumn("__leaf", (F.col("__at") == F.col("__path")) & ~F.col("__node"))
        .join(places.select(F.col("__at").alias("__place"), "__of"), F.col("__at") == F.col("__place"), "left")
    )
    # a default is blocked by anything at its path, and by leaves above it
    blocking = F.filter("__of", lambda o: o["__is"] | F.col("__leaf"))
    marks = met.groupBy(*columns(row_id)).agg(F.collect_set(
        F.when(F.size(blocking) > 0, F.struct("__at", blocking.alias("of")))).alias("__marks"))
    block = given.groupBy("__block").agg(
        F.collect_list(F.struct("path", "value", "above")).alias("__given"))
    dealt = marks.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1))))

    def marked(is_default: bool) -> Column:
        def here(mark: Column) -> Column:
            return F.exists(mark["of"], lambda o: (o["__block"] == F.col("__b")) & (o["__is"] == is_default))

        return F.transform(F.filter("__marks", here), lambda m: m["__at"])

    sides = dealt.join(block, F.col("__b") == F.col("__block")).select(
        *columns(row_id), "__given", marked(True).alias("__own"), marked(False).alias("__leaves"))

    def free(default: Column) -> Column:
        return ~F.array_contains(F.col("__own"), default["path"]) & ~F.arrays_overlap(
            default["above"], F.col("__leaves"))

    added = sides.select(*columns(row_id), F.explode(F.filter("__given", free)).alias("__d")).select(
        *columns(row_id), "__d.path", "__d.value")
    # a document with a {} has nothing below it that could block such a default
    filled = above.select(F.col("__at").alias("__filled")).distinct()
    kept = user_rows.where(path.isNotNull()).join(filled, (path == F.col("__filled")) & is_node, "left_anti")
    return kept.unionByName(added)


def _merge_own_defaults(user_rows: DataFrame, defaults: DataFrame, row_id: list[str],
                        sep: str) -> DataFrame:
    """Rows of both sides meet at their places (row id, prefix of a path), then come together again.

    Both are sorted windows, so no side of a join is held, whatever the planner takes its size for.
    """
    ids, given, is_node = columns(row_id), F.col("__given"), F.col("value") == "{}"

    def side(df: DataFrame, is_default: bool) -> DataFrame:
        return df.select(*ids, "path", "value", F.lit(is_default).alias("__given")).where("path is not null")

    rows = side(user_rows, False).unionByName(side(defaults, True))
    no_id = reduce(Column.__or__, [c.isNull() for c in ids])  # NULL is no document to be met
    apart = rows.where(no_id).where(given | F.col("value").isNotNull())

    at_end = F.col("path") == F.col("__at")
    place = Window.partitionBy(*ids, "__at")
    met = (
        rows.where(~no_id).withColumn("__at", F.explode(path_prefixes("path", sep)))
        .withColumn("__used", F.max(~given).over(place))
        .withColumn("__leaf", F.coalesce(F.max(~given & at_end & ~is_node).over(place), F.lit(False)))
        .withColumn("__filled", F.max(given & ~at_end).over(place))
    )
    # a default is blocked by anything at its path, and by leaves above it
    blocked = F.max(F.col("__used") & (at_end | F.col("__leaf"))).over(
        Window.partitionBy(*ids, "path", "__given"))
    # a document with a {} has nothing around it that could block a default below it
    own = F.col("value").isNotNull() & ~(is_node & F.col("__filled"))
    merged = met.withColumn("__blocked", blocked).where(at_end).where(
        F.when(given, ~F.col("__blocked")).otherwise(own))
    return merged.unionByName(apart, allowMissingColumns=True).select(*ids, "path", "value")
