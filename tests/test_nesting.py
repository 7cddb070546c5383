import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import cadence as cd

NESTED = "a struct<b:int, c:struct<d:string>>, e string, f array<int>"


@pytest.fixture
def doc(spark):
    return spark.createDataFrame([((1, ("x",)), None, [1, 2])], NESTED)


def test_flatten(doc):
    flat = cd.flatten_struct(doc)
    assert flat.columns == ["a.b", "a.c.d", "e", "f"]
    assert tuple(flat.first()) == (1, "x", None, [1, 2])
    kept = cd.flatten_struct(doc, keep=["a.c"])
    assert kept.columns == ["a.b", "a.c", "e", "f"]
    assert kept.first()["a.c"].d == "x"
    assert cd.flatten_struct(doc, sep="/").columns[1] == "a/c/d"


def test_flatten_reads_only_the_leaves_used(spark, doc, tmp_path):
    path = str(tmp_path / "t")
    doc.write.parquet(path)
    used = cd.flatten_struct(spark.read.parquet(path)).select("`a.c.d`")
    plan = used._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:struct<c:struct<d:string>>>" in plan


def test_unflatten(doc):
    flat = cd.flatten_struct(doc)
    assert cd.unflatten_struct(flat).first().asDict(True) == doc.first().asDict(True)


def test_unflatten_conflicts(spark):
    one = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("a.b"))
    for columns in (["a", "`a.b`"], ["`a.b`", "a"]):
        with pytest.raises(ValueError):
            cd.unflatten_struct(one.select(*columns))


def test_unflatten_repeated_names(spark):
    two = spark.range(1).select(F.lit(1).alias("a.b"), F.lit(2).alias("a.b"))
    assert cd.unflatten_struct(two).first().a.b == 2
    assert cd.unflatten_struct(two, soft=True).first().a.b == 1


def test_get(spark, doc):
    assert doc.select(cd.get_path(doc, "a.c.d").alias("v")).first().v == "x"
    with pytest.raises(KeyError):
        cd.get_path(doc, "a.z")
    assert doc.select(cd.get_path(doc, "a.z", strict=False).alias("v")).first().v is None
    with pytest.raises(TypeError):
        cd.get_path(doc, "e.z")


def test_get_through_maps_and_variants(spark):
    df = spark.createDataFrame([({"p": {"q": 5}}, '{"x":{"y":7,"n":null}}')], "m map<string,map<string,int>>, j string")
    df = df.withColumn("v", F.parse_json("j"))
    got = df.select(
        cd.get_path(df, "m.p.q").alias("a"), cd.get_path(df, "v.x.y", dtype="int").alias("b"),
        cd.get_path(df, "v.x.z", strict=False).alias("c"), cd.get_path(df, "v.x.n").alias("d"),
    ).first()
    assert tuple(got) == (5, 7, None, None)
    for path in ("m.p.z", "v.x.z"):
        with pytest.raises(PySparkException, match="no (key|value) at"):
            df.select(cd.get_path(df, path)).collect()


def test_set(doc):
    assert cd.set_path(doc, "a.b", F.lit(9)).first().a.b == 9
    assert cd.set_path(doc, "a.b", F.lit(9), soft=True).first().a.b == 1
    created = cd.set_path(doc, "x.y", F.lit(1)).first()
    assert (created.x.y, created.a.b) == (1, 1)
    assert cd.set_path(doc, "a.c.n.m", F.lit(4)).first().a.c.n.m == 4
    assert cd.set_path(doc, "a.c.n.m", F.lit(4)).first().a.c.d == "x"
    with pytest.raises(TypeError):
        cd.set_path(doc, "e.z", F.lit(1))
    assert cd.set_path(doc, "e", F.lit("n"), soft=True).first().e is None
    assert cd.set_path(doc, "e", F.lit("n"), soft=True, null_is_absent=True).first().e == "n"


def test_set_in_a_map(spark):
    df = spark.createDataFrame([({"p": {"q": 5}},)], "m map<string,map<string,int>>")
    assert cd.set_path(df, "m.p.q", F.lit(6)).first().m == {"p": {"q": 6}}
    assert cd.set_path(df, "m.p.q", F.lit(6), soft=True).first().m == {"p": {"q": 5}}
    assert cd.set_path(df, "m.r.s", F.lit(6)).first().m == {"p": {"q": 5}, "r": {"s": 6}}


def merged(spark, user, user_type, default, default_type, **options):
    df = spark.createDataFrame([(user, default)], f"u {user_type}, d {default_type}")
    value = df.select(cd.merge_defaults(df, "u", "d", **options).alias("m")).first().m
    return value.asDict(True) if hasattr(value, "asDict") else value


def test_merge_structs(spark):
    assert merged(spark, (1,), "struct<a:int>", ((2,),), "struct<a:struct<b:int>>") == {"a": 1}
    assert merged(spark, ((7,),), "struct<e:struct<f:int>>", (9,), "struct<e:int>") == {"e": {"f": 7}}
    assert merged(
        spark, ((5,),), "struct<c:struct<x:int>>", ((6, 8),), "struct<c:struct<x:int,y:int>>"
    ) == {"c": {"x": 5, "y": 8}}
    null = (None,), "struct<n:int>", (3,), "struct<n:int>"
    assert merged(spark, *null) == {"n": None}
    assert merged(spark, *null, null_is_absent=True) == {"n": 3}


def test_merge_maps(spark):
    kind = "map<string,int>"
    assert merged(spark, {"a": 1, "n": None}, kind, {"a": 2, "n": 5, "q": 4}, kind) == {"a": 1, "n": None, "q": 4}
    kind = "map<string,map<string,int>>"
    assert merged(spark, {"c": {"x": 5}}, kind, {"c": {"x": 6, "y": 8}, "z": {}}, kind) == {
        "c": {"x": 5, "y": 8}, "z": {}}


def variant_of(spark, doc, path, value, **options):
    df = spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.parse_json("j").alias("v"))
    return json.loads(cd.set_path(df, path, value, **options).select(F.to_json("v")).first()[0])


def test_set_in_a_variant(spark):
    doc = {"a": {"b": 1, "n": None}, "l": [1]}
    assert variant_of(spark, doc, "v.a.b", F.lit(2)) == {**doc, "a": {"b": 2, "n": None}}
    assert variant_of(spark, doc, "v.a.b", F.lit(2), soft=True) == doc
    assert variant_of(spark, doc, "v.a.n", F.lit(2), soft=True) == doc
    assert variant_of(spark, doc, "v.a.n", F.lit(2), soft=True, null_is_absent=True)["a"]["n"] == 2
    assert variant_of(spark, doc, "v.x.y.z", F.array(F.lit("p"))) == {**doc, "x": {"y": {"z": ["p"]}}}
    assert variant_of(spark, doc, "v.x", F.struct(F.lit(1.5).alias("q"))) == {**doc, "x": {"q": 1.5}}
    assert variant_of(spark, doc, "v.x", F.lit(None).cast("int")) == {**doc, "x": None}
    with pytest.raises(PySparkException, match="not an object"):
        variant_of(spark, doc, "v.l.x", F.lit(1))
    null = spark.range(1).select(F.lit(None).cast("variant").alias("v"))
    assert cd.set_path(null, "v.a", F.lit(1)).first().v is None
    held = spark.range(1).select(F.struct(F.parse_json(F.lit("{}")).alias("v")).alias("s"))
    assert cd.set_path(held, "s.v.a.b", F.lit(1)).select(F.to_json("s.v")).first()[0] == '{"a":{"b":1}}'


def test_set_in_structs_of_a_map(spark):
    df = spark.createDataFrame([({"p": (1, None), "q": None},)], "m map<string,struct<a:int,b:struct<c:string>>>")

    def after(path, value, **options):
        found = cd.set_path(df, path, value, **options).first().m
        return {k: v and v.asDict(True) for k, v in found.items()}

    assert after("m.p.a", F.lit("5")) == {"p": {"a": 5, "b": None}, "q": None}
    assert after("m.p.a", F.lit(5), soft=True)["p"]["a"] == 1
    assert after("m.r.a", F.lit(5), soft=True) == {"p": {"a": 1, "b": None}, "q": None, "r": {"a": 5, "b": None}}
    grown = after("m.r.n.o", F.lit("x"))
    assert grown == {"p": {"a": 1, "b": None, "n": {"o": None}}, "q": None, "r": {"a": None, "b": None, "n": {"o": "x"}}}
    with pytest.raises(TypeError):
        cd.set_path(df, "m.p.a.z", F.lit(1))
    variants = df.select(F.create_map(F.lit("k"), F.parse_json(F.lit('{"x":1}'))).alias("m"))
    got = cd.set_path(cd.set_path(variants, "m.k.y", F.lit(2)), "m.new.z", F.lit(3))
    assert got.select(F.to_json(got.m["k"]), F.to_json(got.m["new"])).first()[:] == ('{"x":1,"y":2}', '{"z":3}')


def random_doc(rng, depth=4):
    names = ["a", "b", "c", 'q"\\', "ä.x", ""]
    doc = {}
    for name in rng.sample(names, rng.randrange(5)):
        deeper = depth > 1 and rng.random() < 0.6
        doc[name] = random_doc(rng, depth - 1) if deeper else rng.choice([1, 2.5, None, "s{", [1, {"z": 2}], True])
    return doc


def merged_dicts(user, default):
    if not (isinstance(user, dict) and isinstance(default, dict)):
        return user
    out = dict(user)
    for k in default:
        out[k] = merged_dicts(user[k], default[k]) if k in user else default[k]
    return out


def test_merge_variants_of_any_depth(spark):
    rng = random.Random(6)
    pairs = [(random_doc(rng), random_doc(rng)) for _ in range(300)]
    pairs += [(1, {"a": 1}), ({"a": 1}, [1]), (None, {"a": 1}), ({}, {}), ({}, {"a": {}}), ({"a": {}}, {"a": {"b": {}}})]
    deep = {"end": 1}
    for _ in range(40):
        deep = {"k": deep}
    pairs.append(({"k": {"k": {}}}, deep))
    # an empty name with something below is one of the names that flattening leaves out
    pairs = [p for p in pairs if '"": {"' not in json.dumps(p)]
    df = spark.createDataFrame([(i, json.dumps(u), json.dumps(d)) for i, (u, d) in enumerate(pairs)], "i int, u string, d string")
    df = df.select("i", F.parse_json("u").alias("u"), F.parse_json("d").alias("d"))
    ways = [cd.merge_defaults(df, "u", "d")] + [cd.merge_variants(df.u, df.d, levels=n) for n in (0, 2)]
    rows = sorted(df.select("i", *(F.to_json(w).alias(f"m{k}") for k, w in enumerate(ways))).collect())
    for k in range(len(ways)):
        assert [json.loads(r[f"m{k}"]) for r in rows] == [merged_dicts(u, d) for u, d in pairs]


def test_merge_structs_inside_maps(spark):
    user = {"p": (1, "x"), "n": None}
    default = {"p": ("8", 0.5), "q": ("9", 1.5), "n": ("7", 2.5)}
    got = merged(spark, user, "map<string,struct<a:int,b:string>>", default, "map<string,struct<a:string,r:double>>")
    assert {k: v and v.asDict() for k, v in got.items()} == {
        "p": {"a": 1, "b": "x", "r": 0.5}, "n": None, "q": {"a": 9, "b": None, "r": 1.5}}
    only = merged(spark, user, "map<string,struct<a:int,b:string>>", None, "map<string,struct<a:int,r:double>>")
    assert only["p"].asDict() == {"a": 1, "b": "x", "r": None}
    with pytest.raises(TypeError):
        merged(spark, {"p": 1}, "map<string,int>", {"p": (1,)}, "map<string,struct<a:int>>")


def test_merge_what_differs_in_kind_gives_a_variant(spark):
    df = spark.createDataFrame([((1, None), {"a": 5, "c": 6}, '{"b":{"x":1},"d":2}')], "s struct<a:int,b:int>, m map<string,int>, j string")
    df = df.withColumn("v", F.parse_json("j"))

    def text(user, default):
        return json.loads(df.select(F.to_json(cd.merge_defaults(df, user, default))).first()[0])

    assert text("s", "m") == {"a": 1, "c": 6} or text("s", "m") == {"a": 1, "b": None, "c": 6}
    assert text("v", "m") == {"a": 5, "b": {"x": 1}, "c": 6, "d": 2}
    assert text("v", "s")["b"] == {"x": 1} and text("v", "s")["a"] == 1
    assert text("m", "v") == {"a": 5, "b": {"x": 1}, "c": 6, "d": 2}
