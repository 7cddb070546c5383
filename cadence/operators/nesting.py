"""Nested columns addressed by dotted paths: get, set, flatten, rebuild, merge."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.json_text import OBJECT, as_object, once, variant_path, with_member
from cadence.operators.documents import flattened
from cadence.runtime import quoted

_SEP = "\x1f"  # between the names of a path into a variant; names seldom hold control characters


def _fail(message: str, dtype: T.DataType) -> Column:
    return F.raise_error(F.lit(message)).cast(dtype)


def get_path(df: DataFrame, path: str, strict: bool = True, dtype: str = "string",
             sep: str = ".") -> Column:
    """Value at ``path``, through structs, maps and variants (read as ``dtype``).

    An unknown struct field is an error now, an unknown map key or variant member one
    at run time; with ``strict=False`` all of them are NULL.
    """
    parts = path.split(sep)
    if parts[0] not in df.schema.names:
        raise KeyError(f"{parts[0]!r} (in {path!r})")
    column, current = F.col(quoted(parts[0])), df.schema[parts[0]].dataType
    for depth, part in enumerate(parts[1:], start=1):
        if isinstance(current, T.StructType):
            if part not in current.names:
                if strict:
                    raise KeyError(f"{part!r} (in {path!r})")
                return F.lit(None)
            column, current = column.getField(part), current[part].dataType
        elif isinstance(current, T.MapType):
            parent, current = column, current.valueType
            column = F.element_at(parent, F.lit(part))
            if strict:
                missing = parent.isNotNull() & ~F.map_contains_key(parent, F.lit(part))
                column = F.when(missing, _fail(f"no key at {path}", current)).otherwise(column)
        elif isinstance(current, T.VariantType):
            where = variant_path(sep.join(parts[depth:]), sep)
            value = F.try_variant_get(column, where, dtype)
            if not strict:
                return value
            found = F.try_variant_get(column, where, "variant").isNotNull()
            missing = F.raise_error(F.lit(f"no value at {path}")).cast(dtype)
            return F.when(column.isNull() | found, F.variant_get(column, where, dtype)).otherwise(missing)
        else:
            raise TypeError(f"{sep.join(parts[:depth])!r} is {current.simpleString()}, not nested")
    return column


def _nest(parts: list[str], value: Column) -> Column:
    for part in reversed(parts):
        value = F.struct(value.alias(part))
    return value


def as_variant(value: Column, dtype: T.DataType) -> Column:
    """Any value as a variant; a SQL NULL becomes a JSON null."""
    if isinstance(dtype, T.VariantType):
        found = value
    elif isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
        found = F.to_variant_object(value)
    else:
        found = value.cast("variant")
    return F.coalesce(found, F.parse_json(F.lit("null")))


def _reached(dtype: T.DataType, parts: list[str]) -> T.DataType | None:
    """Type at a path through structs; None if a field on the way is missing."""
    for part in parts:
        if not isinstance(dtype, T.StructType) or part not in dtype.names:
            return None
        dtype = dtype[part].dataType
    return dtype


def _with_path(column: Column, dtype: T.DataType, parts: list[str], value: Column,
               kind: T.DataType, soft: bool, null_is_absent: bool) -> Column:
    """``column`` of ``dtype`` with ``value`` of type ``kind`` at the path, whatever the parents are."""
    name, rest = parts[0], parts[1:]
    if isinstance(dtype, T.StructType):
        if name not in dtype.names:
            return column.withField(quoted(name), _nest(rest, value))
        child = column.getField(name)
        if rest:
            value = _with_path(child, dtype[name].dataType, rest, value, kind, soft, null_is_absent)
        elif soft:
            value = F.coalesce(child, value) if null_is_absent else child
        return column.withField(quoted(name), value)
    if isinstance(dtype, T.MapType):
        return _with_key(column, dtype, name, rest, value, kind, soft, null_is_absent)
    if isinstance(dtype, T.VariantType):
        bad = F.raise_error(F.lit(f"parent of {name} is not an object")).cast(OBJECT)
        members = F.when(column.isNotNull(), F.coalesce(as_object(column), bad))
        new = as_variant(value, kind)
        return once(members, lambda m: F.when(
            m.isNotNull(), with_member(m, parts, new, soft, null_is_absent)))
    raise TypeError(f"parent of {name!r} is {dtype.simpleString()}, not nested")


def _with_key(column: Column, dtype: T.MapType, name: str, rest: list[str], value: Column,
              kind: T.DataType, soft: bool, null_is_absent: bool) -> Column:
    """A map with the path set below one key.

    All values of a map have one type.  A field that is new to its structs is added to all of
    them, NULL in the others, and a value takes the type that its place has already.
    """
    key, below = F.lit(name), dtype.valueType
    child, absent = F.element_at(column, key), ~F.map_contains_key(column, key)
    others = F.map_filter(column, lambda k, _: k != key)
    if not rest:
        kept = ~absent & child.isNotNull() if null_is_absent else ~absent
        new = as_variant(value, kind) if isinstance(below, T.VariantType) else value.cast(below)
        new = F.when(kept, child).otherwise(new) if soft else new
    elif isinstance(below, T.MapType):
        parent = F.when(absent, F.create_map().cast(below)).otherwise(child)
        new = _with_path(parent, below, rest, value, kind, soft, null_is_absent)
    elif isinstance(below, T.VariantType):
        parent = F.when(absent, F.parse_json(F.lit("{}"))).otherwise(child)
        new = _with_path(parent, below, rest, value, kind, soft, null_is_absent)
    elif isinstance(below, T.StructType):
        there = _reached(below, rest)
        if there is not None:
            value, kind = value.cast(there), there
        # NULL fields of a new struct are absent, so that soft sets them as well
        empty = F.from_json(F.lit("{}"), below)
        into = F.when(absent, _with_path(empty, below, rest, value, kind, False, null_is_absent))
        new = into.otherwise(_with_path(child, below, rest, value, kind, soft, null_is_absent))
        if there is None:
            nothing = F.lit(None).cast(kind)
            others = F.transform_values(others, lambda _, v: _with_path(
                v, below, rest, nothing, kind, True, False))
    else:
        raise TypeError(f"{name!r} holds {below.simpleString()}, which is not nested")
    return F.map_concat(others, F.create_map(key, new))


def set_path(df: DataFrame, path: str, value: Column, soft: bool = False,
             null_is_absent: bool = False, sep: str = ".") -> DataFrame:
    """Set ``path`` to ``value``, creating missing parents.

    The path may lead through structs, maps and variants in any order.  ``soft`` sets only
    what is absent.  A struct field always exists, so a NULL in it counts as present unless
    ``null_is_absent``.  A map's values have one type: a field new to its structs is added to
    all, and a value is cast to the type its place has.  In a variant a scalar or array parent
    is an error at run time; a NULL parent stays NULL.
    """
    top, *rest = path.split(sep)
    if top not in df.schema.names:
        return df.withColumn(top, _nest(rest, value))
    column = F.col(quoted(top))
    if rest:
        kind = df.select(value).schema[0].dataType
        changed = _with_path(column, df.schema[top].dataType, rest, value, kind, soft, null_is_absent)
    elif soft:
        changed = F.coalesce(column, value) if null_is_absent else column
    else:
        changed = value
    return df.withColumn(top, changed)


def _leaves(schema: T.StructType, parent: Column | None, path: str, sep: str,
            keep: Collection[str]):
    for field in schema.fields:
        here = F.col(quoted(field.name)) if parent is None else parent.getField(field.name)
        name = path + sep + field.name if path else field.name
        if isinstance(field.dataType, T.StructType) and name not in keep:
            yield from _leaves(field.dataType, here, name, sep, keep)
        else:
            yield name, here


def flatten_struct(df: DataFrame, sep: str = ".", keep: Collection[str] = ()) -> DataFrame:
    """One column per leaf, named by its path; paths in ``keep`` stay nested.

    Arrays and maps are leaves, and empty structs vanish.  It is a projection, so only
    the leaves used later are read.
    """
    found = dict(_leaves(df.schema, None, "", sep, keep))
    return df.select(*(column.alias(name) for name, column in found.items()))


def unflatten_struct(df: DataFrame, sep: str = ".", soft: bool = False) -> DataFrame:
    """Rebuild structs from columns named by paths; the inverse of flatten_struct.

    Of repeated names the last wins, or the first if ``soft``.  A path that is also the
    parent of another is rejected.
    """
    names = df.columns
    numbered = df.toDF(*(f"c{i}" for i in range(len(names))))
    tree: dict = {}
    for i, name in enumerate(names):
        *parents, leaf = name.split(sep)
        node = tree
        for part in parents:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise ValueError(f"{name!r} lies below a column that is a leaf")
        if isinstance(node.get(leaf), dict):
            raise ValueError(f"{name!r} is both a leaf and a parent")
        if not (soft and leaf in node):
            node[leaf] = F.col(f"c{i}")

    def build(node: dict) -> list[Column]:
        return [
            (F.struct(*build(sub)) if isinstance(sub, dict) else sub).alias(name)
            for name, sub in node.items()
        ]

    return numbered.select(*build(tree))


def _is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.MapType, T.VariantType))


def _merged_type(user: T.DataType, default: T.DataType) -> T.DataType:
    """Type of a user's value merged with a default's."""
    if isinstance(user, T.StructType) and isinstance(default, T.StructType):
        fields = [
            T.StructField(f.name, _merged_type(f.dataType, default[f.name].dataType)
                          if f.name in default.names else f.dataType)
            for f in user.fields
        ]
        return T.StructType(fields + [f for f in default.fields if f.name not in user.names])
    if isinstance(user, T.MapType) and isinstance(default, T.MapType):
        return T.MapType(user.keyType, _merged_type(user.valueType, default.valueType))
    if _is_nested(user) and _is_nested(default) and type(user) is not type(default):
        return T.VariantType()
    return user


def _fitted(value: Column, dtype: T.DataType, target: T.DataType) -> Column:
    """A value in the type of what it stands beside: fields it lacks are NULL."""
    if dtype == target:
        return value
    if isinstance(target, T.VariantType):
        return F.when(value.isNotNull(), as_variant(value, dtype))
    if isinstance(dtype, T.StructType) and isinstance(target, T.StructType):
        fields = [
            (_fitted(value.getField(f.name), dtype[f.name].dataType, f.dataType)
             if f.name in dtype.names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in target.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType) and isinstance(target, T.MapType):
        return F.transform_values(value, lambda _, v: _fitted(v, dtype.valueType, target.valueType))
    if _is_nested(dtype) or _is_nested(target):
        raise TypeError(f"a default of type {dtype.simpleString()} has no place among values of type "
                        f"{target.simpleString()}")
    return value.cast(target)


def _entries(value: Column) -> Column:
    """Leaves of a variant object: path as an array of names, and JSON text."""
    leaf = flattened(F.to_json(value), _SEP, keep_empty=True)
    return F.transform(leaf, lambda e: F.struct(
        e["path"].alias("path"), F.coalesce(F.to_json(e["value"]), F.lit("{}")).alias("text")))


def _from_entries(entries: Column) -> Column:
    """JSON text of an object from its leaves: sorted by path, each leaf closes the objects that
    the one before has open beyond their common names, and opens its own."""
    def named(name: Column) -> Column:
        return F.concat(F.to_json(name.cast("variant")), F.lit(":"))

    paths = F.array_sort(F.transform(entries, lambda e: F.struct(
        F.split(e["path"], _SEP, -1).alias("names"), e["text"].alias("text"))))

    def text(leaves: Column) -> Column:
        def shared(a: Column, b: Column) -> Column:
            differ = F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1),
                              lambda i: F.get(a, i) != F.get(b, i))
            return F.coalesce(F.get(differ, F.lit(0)), F.lit(0))

        def piece(leaf: Column, i: Column) -> Column:
            names, before = leaf["names"], F.get(leaves, i - 1)["names"]
            depth = F.size(names)
            common = F.when(i == 0, F.lit(0)).otherwise(shared(names, before))
            closed = F.when(i == 0, F.lit("")).otherwise(
                F.concat(F.repeat(F.lit("}"), F.size(before) - 1 - common), F.lit(",")))
            opened = F.array_join(F.transform(
                F.slice(names, common + 1, depth - 1 - common), lambda n: F.concat(named(n), F.lit("{"))), "")
            return F.concat(closed, opened, named(F.element_at(names, -1)), leaf["text"])

        last = F.size(F.element_at(leaves, -1)["names"]) - 1
        return F.when(F.size(leaves) == 0, F.lit("{}")).otherwise(F.concat(
            F.lit("{"), F.array_join(F.transform(leaves, piece), ""), F.repeat(F.lit("}"), last + 1)))

    return once(paths, text)


def _merge_leaves(user: Column, default: Column) -> Column:
    """Two variant objects of any depth, taken apart to leaves and put together again."""
    def merged(sides: Column) -> Column:
        own, given = sides["own"], sides["given"]

        def below(path: Column, above: Column) -> Column:
            return path.startswith(F.concat(above, F.lit(_SEP)))

        def blocks(mine: Column, theirs: Column) -> Column:
            at_or_below = (mine["path"] == theirs["path"]) | below(mine["path"], theirs["path"])
            return at_or_below | ((mine["text"] != "{}") & below(theirs["path"], mine["path"]))

        added = F.filter(given, lambda g: ~F.exists(own, lambda o: blocks(o, g)))
        # an empty object goes once something stands below it
        kept = F.filter(own, lambda o: (o["text"] != "{}") | ~F.exists(
            given, lambda g: below(g["path"], o["path"])))
        return F.parse_json(_from_entries(F.concat(kept, added)))

    return once(F.struct(_entries(user).alias("own"), _entries(default).alias("given")), merged)


def merge_variants(user: Column, default: Column, levels: int = 4) -> Column:
    """Variant ``user`` with what it lacks taken from the variant ``default``, at any depth.

    Members are merged level by level through maps; what lies deeper than ``levels`` is taken
    apart to leaves.  Where either is not an object the user's value stays.
    """
    def merged(own: Column, given: Column) -> Column:
        if not levels:
            return _merge_leaves(user, default)

        def member(key: Column, value: Column) -> Column:
            below = merge_variants(value, F.element_at(given, key), levels - 1)
            return F.when(F.map_contains_key(given, key), below).otherwise(value)

        missing = F.map_filter(given, lambda k, _: ~F.map_contains_key(own, k))
        return F.to_variant_object(F.map_concat(F.transform_values(own, member), missing))

    both = F.struct(as_object(user).alias("own"), as_object(default).alias("given"))
    return once(both, lambda m: F.when(
        m["own"].isNotNull() & m["given"].isNotNull(), merged(m["own"], m["given"])).otherwise(user))


def _merge(user: Column, user_type: T.DataType, default: Column, default_type: T.DataType,
           null_is_absent: bool) -> Column:
    if not (_is_nested(user_type) and _is_nested(default_type)):
        if null_is_absent and user_type == default_type:
            return F.coalesce(user, default)
        return user
    if isinstance(user_type, T.StructType) and isinstance(default_type, T.StructType):
        fields = []
        for f in user_type.fields:
            value = user.getField(f.name)
            if f.name in default_type.names:
                other = default_type[f.name].dataType
                value = _merge(value, f.dataType, default.getField(f.name), other, null_is_absent)
            fields.append(value.alias(f.name))
        fields += [
            default.getField(f.name).alias(f.name)
            for f in default_type.fields if f.name not in user_type.names
        ]
        merged = F.struct(*fields)
        return merged if null_is_absent else F.when(user.isNotNull(), merged)
    if isinstance(user_type, T.MapType) and isinstance(default_type, T.MapType):
        return _merge_maps(user, user_type, default, default_type, null_is_absent)
    # a variant on either side, or a struct beside a map
    own, given = (F.when(c.isNotNull(), as_variant(c, t)) for c, t in ((user, user_type), (default, default_type)))
    merged = merge_variants(own, given)
    if not null_is_absent:
        return merged
    return F.when(own.isNull() | F.is_variant_null(own), F.coalesce(given, own)).otherwise(merged)


def _merge_maps(user: Column, user_type: T.MapType, default: Column, default_type: T.MapType,
                null_is_absent: bool) -> Column:
    below, other = user_type.valueType, default_type.valueType
    target = _merged_type(below, other)

    def own_value(key: Column, value: Column) -> Column:
        fitted = _fitted(value, below, target)
        if not (_is_nested(below) and _is_nested(other)):
            return fitted
        merged = _merge(value, below, F.element_at(default, key), other, null_is_absent)
        return F.when(F.map_contains_key(default, key), merged).otherwise(fitted)

    own = user
    if target != below or _is_nested(below) and _is_nested(other):
        own = F.transform_values(user, own_value)
    given = default
    if target != other:
        given = F.transform_values(default, lambda _, v: _fitted(v, other, target))
    missing = F.map_filter(given, lambda k, _: ~F.map_contains_key(user, k))
    alone = user if target == below else F.transform_values(user, lambda _, v: _fitted(v, below, target))
    merged = F.when(default.isNull(), alone).otherwise(F.map_concat(own, missing))
    return F.when(user.isNull(), given).otherwise(merged) if null_is_absent else merged


def merge_defaults(df: DataFrame, user: str, default: str,
                   null_is_absent: bool = False) -> Column:
    """Column ``user`` with what it lacks taken from column ``default``, recursively.

    The user's value wins where both have one; where either is not nested the user's
    stays.  In structs a NULL counts as a value unless ``null_is_absent``.  Structs, maps and
    variants may hold each other in any order; where two of them meet that differ, the result
    is a variant.  Structs inside a map have one type: fields that only some of them have are
    NULL in the others, and a default is cast to the type that the user's values have.
    """
    kinds = df.schema[user].dataType, df.schema[default].dataType
    return _merge(F.col(quoted(user)), kinds[0], F.col(quoted(default)), kinds[1], null_is_absent)
