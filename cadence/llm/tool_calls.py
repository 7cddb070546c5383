"""Linking of tool calls and results, in DataFrame functions throughout.

``schemas`` maps a tool's name to its parameters: ``{"query": "string", "limit?": "integer"}``,
with a question mark after optional ones.  Types are those of JSON Schema: string, integer,
number, boolean, object, array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.runtime import stage

Schemas = dict[str, dict[str, str]]
KEY = ["conv_id", "call_id"]

# What a JSON value's type is called in a variant (fixed values).
_TYPES = {
    "string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "boolean": "^BOOLEAN$",
    "number": r"^(BIGINT|DECIMAL\(.*|DOUBLE)$", "object": "^OBJECT<", "array": "^ARRAY<",
}


def argument_errors(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments (JSON text): sorted messages, none if valid."""
    parsed = F.try_parse_json(arguments)
    known = F.json_object_keys(arguments)
    by_tool = F.array(F.concat(F.lit("unknown tool "), F.coalesce(tool, F.lit(""))))
    for name, parameters in sorted(schemas.items()):
        found = []
        for written, kind in sorted(parameters.items()):
            parameter = written.rstrip("?")
            value = F.try_variant_get(parsed, f"$['{parameter}']", "variant")
            shape = F.schema_of_variant(value)
            missing = F.lit(None if written.endswith("?") else f"missing {parameter}")
            found.append(
                F.when(~F.array_contains(known, parameter), missing)
                .when(~F.coalesce(shape, F.lit("VOID")).rlike(_TYPES[kind]),
                      f"{parameter} is not {kind}")
            )
        names = [F.lit(p.rstrip("?")) for p in parameters]
        extra = F.transform(
            F.array_except(known, F.array(*names).cast("array<string>")),
            lambda k: F.concat(F.lit("unexpected "), k),
        )
        errors = F.array_sort(F.concat(F.array_compact(F.array(*found).cast("array<string>")), extra))
        by_tool = F.when(tool == name, errors).otherwise(by_tool)
    not_json = F.array(F.lit("arguments are not JSON"))
    not_object = F.array(F.lit("arguments are not an object"))
    return (
        F.when(parsed.isNull(), not_json).when(known.isNull(), not_object).otherwise(by_tool)
    )


def call_levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: the longest chain of calls that a call depends on.

    ``calls`` has ``conv_id, call_id`` (unique together) and ``after``, the ids of calls of the
    conversation that come first; unknown ids are ignored here.  Sorting by level is a
    topological order.  Calls on a cycle, or behind one, get no level.

    ``steps[k]`` leads from a call to those that 2**k dependencies in a row reach, found from the
    table before joined with itself, so the tables are as many as the logarithm of the longest
    chain.  A level is put together from the greatest power of two downward: whoever can still
    go that many steps does.  On a cycle one can go as far as one likes, so whoever goes as many
    steps as the conversation has calls stands on or behind one.
    """
    wanted = calls.select(*KEY, F.explode(F.array_distinct("after")).alias("parent"))
    edges = wanted.join(calls.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"])
    sizes = edges.groupBy("conv_id").agg(F.count_distinct("call_id").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    steps = [stage(edges.select(*KEY, "parent"), "steps")] if most else []
    # all steps together go further than any chain without a cycle
    while steps and (1 << len(steps)) - 1 <= most:
        further = steps[-1].select(
            "conv_id", F.col("call_id").alias("parent"), F.col("parent").alias("far"))
        reached = stage(
            steps[-1].join(further, ["conv_id", "parent"])
            .select(*KEY, F.col("far").alias("parent")).distinct(), "steps")
        if reached.isEmpty():
            break
        steps.append(reached)
    own = Window.partitionBy(*KEY)
    at = calls.select(*KEY, F.col("call_id").alias("at"), F.lit(0).cast("bigint").alias("level"))
    for k in range(len(steps) - 1, -1, -1):
        onward = steps[k].select("conv_id", F.col("call_id").alias("at"), F.col("parent").alias("next"))
        at = (
            at.join(onward, ["conv_id", "at"], "left")
            .withColumn("goes", F.max(F.col("next").isNotNull()).over(own))
            .where(F.col("next").isNotNull() | ~F.col("goes"))
            .select(*KEY, F.coalesce("next", "at").alias("at"),
                    (F.col("level") + F.when(F.col("goes"), 1 << k).otherwise(0)).alias("level"))
            .distinct()
        )
    reached = at.groupBy(*KEY).agg(F.max("level").alias("level"))
    # a chain of n calls that wait has n steps at most
    endless = F.col("level") > F.coalesce("n", F.lit(0))
    return stage(
        reached.join(sizes, "conv_id", "left")
        .select(*KEY, F.when(~endless, F.col("level").cast("int")).alias("level")), "levels")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, and per result id without a call, with the message as canonical JSON.

    ``calls`` needs ``conv_id, call_id, turn, tool, arguments, after`` and ``results``
    ``conv_id, call_id, turn, content``; other columns are ignored.  Returns ``conv_id,
    call_id, status`` (``linked``, ``unanswered`` or ``orphan``), ``level`` (see
    :func:`call_levels`), ``tool, errors, valid, n_results, message``.  The message has sorted
    keys and no blanks; arguments that are not JSON are kept as text.

    Of calls with one id in a conversation the first holds (by turn, tool, arguments), of
    results the first (by turn, content) and their number is told; both are partial
    aggregates, so repeated rows never gather in one task.  Calls or results without a
    conversation or id cannot be linked and come back as unanswered or orphans of a null id,
    one row for each such key.  Null arguments are not JSON; a null ``after`` is none.
    """
    first_call = calls.groupBy(*KEY).agg(
        F.min(F.struct("turn", "tool", "arguments", F.coalesce("after", F.array().cast(
            "array<string>")).alias("after"))).alias("c")
    ).select(*KEY, F.col("c.turn").alias("turn"), "c.tool", "c.arguments", "c.after",
             F.lit(True).alias("called"))
    first_call = stage(first_call, "calls")
    answers = results.groupBy(*KEY).agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results")
    ).select(*KEY, F.col("r.content").alias("content"), "n_results")
    named = first_call.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    known = named.select("conv_id", F.col("call_id").alias("parent"))
    unknown = (
        named.select(*KEY, F.explode("after").alias("parent"))
        .join(known, ["conv_id", "parent"], "left_anti")
        .groupBy(*KEY).agg(F.array_sort(F.collect_set(
            F.concat(F.lit("unknown call "), "parent"))).alias("unknown"))
    )
    linked = (
        first_call.join(call_levels(named), KEY, "left").join(unknown, KEY, "left")
        .join(answers.hint("shuffle_hash"), KEY, "full_outer")
    )
    called = F.coalesce("called", F.lit(False))
    cycle = F.when(
        F.col("level").isNull() & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull(),
        F.array(F.lit("cycle")),
    )
    none = F.array().cast("array<string>")
    errors = F.when(called, F.concat(
        argument_errors(F.col("tool"), F.col("arguments"), schemas),
        F.coalesce("unknown", none), F.coalesce(cycle, none),
    )).otherwise(F.array(F.lit("no call")))
    parsed = F.try_parse_json("arguments")
    message = F.concat(
        F.lit('{"arguments":'),
        F.coalesce(F.to_json(parsed), _quoted("arguments"), F.lit("null")),
        F.lit(',"id":'), F.coalesce(_quoted("call_id"), F.lit("null")),
        F.lit(',"name":'), F.coalesce(_quoted("tool"), F.lit("null")),
        F.lit(',"result":'), F.coalesce(_quoted("content"), F.lit("null")), F.lit("}"),
    )
    return linked.select(
        *KEY,
        F.when(~called, "orphan").when(F.col("n_results").isNull(), "unanswered")
        .otherwise("linked").alias("status"),
        "level", "tool", errors.alias("errors"), (F.size(errors) == 0).alias("valid"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), message.alias("message"),
    )


def _quoted(column: str) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(F.col(column).cast("string")))
    return F.when(F.col(column).isNotNull(), F.substring(array, F.lit(2), F.length(array) - 2))
