import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import cadence as cd

DOC = {"a": {"b": 1, "c": {"d": "x"}}, "e": None, "f": [1, 2], "g": {}}


def flatten(spark, doc, **options):
    df = spark.createDataFrame([(1, json.dumps(doc))], "id long, doc string")
    rows = cd.flatten_json(df, "id", "doc", **options).collect()
    return {r.path: json.loads(r.value) for r in rows}


def test_flatten_golden(spark):
    assert flatten(spark, DOC) == {"a.b": 1, "a.c.d": "x", "e": None, "f": [1, 2]}
    assert flatten(spark, DOC, keep=["a.c"]) == {"a.b": 1, "a.c": {"d": "x"}, "e": None, "f": [1, 2]}
    assert flatten(spark, DOC, keep_empty=True)["g"] == {}
    assert flatten(spark, {"": {"b": 1}}) == {"b": 1}
    assert flatten(spark, {}) == {}
    assert flatten(spark, {}, keep_empty=True) == {None: {}}
    assert flatten(spark, {"s": "{{{"}) == {"s": "{{{"}
    assert flatten(spark, DOC, sep="/")["a/c/d"] == "x"


def test_flatten_deep(spark):
    doc = leaf = {}
    for _ in range(60):
        leaf["k"] = {}
        leaf = leaf["k"]
    leaf["end"] = True
    assert flatten(spark, doc) == {".".join(["k"] * 60) + ".end": True}


def test_flatten_two_spellings_of_one_path(spark):
    assert len(flatten(spark, {"a.b": 1, "a": {"b": 2}, "c": 3})) == 2


def test_flatten_rejects_what_is_not_an_object(spark):
    with pytest.raises(Exception, match="not a JSON object"):
        flatten(spark, [1])
    df = spark.createDataFrame([(1, '{"a":1,"a":2}')], "id long, doc string")
    with pytest.raises(Exception, match="DUPLICATE"):
        cd.flatten_json(df, "id", "doc").collect()


def merge(user, default):
    """The rule, on Python dicts."""
    if not (isinstance(user, dict) and isinstance(default, dict)):
        return user
    out = dict(user)
    for k in default:
        out[k] = merge(user[k], default[k]) if k in user else default[k]
    return out


def leaves(doc, above=""):
    out = {}
    for k, v in doc.items():
        path = f"{above}.{k}" if above else k
        out |= leaves(v, path) if isinstance(v, dict) and v else {path: v}
    return out


def random_doc(rng, depth=3):
    doc = {}
    for k in rng.sample("abc", rng.randrange(4)):
        deeper = depth > 1 and rng.random() < 0.6
        doc[k] = random_doc(rng, depth - 1) if deeper else rng.choice([1, 2, None, "s"])
    return doc


GOLDEN = [
    ({"a": 1}, {"a": {"b": 2}}, {"a": 1}),
    ({"e": {"f": 7}}, {"e": 9}, {"e": {"f": 7}}),
    ({"c": {"x": 5}}, {"c": {"x": 6, "y": 8}}, {"c": {"x": 5, "y": 8}}),
    ({"n": None}, {"n": {"z": 3}}, {"n": None}),
    ({"a": {}}, {"a": {"b": 1}}, {"a": {"b": 1}}),
    ({"a": {}}, {"a": 1}, {"a": {}}),
    ({}, {"q": 4}, {"q": 4}),
]


def as_rows(spark, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id long, doc string")
    return cd.flatten_json(df, "id", "doc", keep_empty=True)


def collected(rows, n):
    out = {i: {} for i in range(n)}
    for r in rows.collect():
        assert r.path not in out[r.id], "repeated path"
        if r.path is not None:
            out[r.id][r.path] = json.loads(r.value)
    return list(out.values())


def test_merge_each_documents_own_defaults(spark):
    rng = random.Random(1)
    pairs = [(u, d) for u, d, _ in GOLDEN] + [(random_doc(rng), random_doc(rng)) for _ in range(400)]
    users, defaults = zip(*pairs)
    got = cd.merge_defaults_long(as_rows(spark, users), as_rows(spark, defaults), "id")
    assert collected(got, len(pairs)) == [leaves(merge(u, d)) for u, d in pairs]
    for user, default, want in GOLDEN:
        assert merge(user, default) == want


def test_own_defaults_hold_no_side_of_a_join(spark):
    users = spark.createDataFrame(
        [(1, "a", "5"), (2, "a", "{}"), (3, "k", "1"), (3, "k", "1"), (4, "a.b", None), (None, "k", "{}")],
        "id long, path string, value string")
    own = [(i, p, "d") for i in (1, 2, 3, 4, None) for p in ("a.b", "k.x", "k.x")]
    got = cd.merge_defaults_long(users, spark.createDataFrame(own, users.schema), "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    kx = [(i, "k.x", "d") for i in (1, 2, 4, None) for _ in range(2)]
    want = [(1, "a", "5"), (2, "a.b", "d"), (3, "a.b", "d"), (3, "k", "1"), (3, "k", "1"),
            (None, "k", "{}"), (None, "a.b", "d"), *kx]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", [2, 3, 4])
def test_merge_one_configuration(spark, seed, monkeypatch):
    monkeypatch.setattr("cadence.operators.documents.CONFIG_BLOCK", 2)
    rng = random.Random(seed)
    default, users = {}, [random_doc(rng) for _ in range(150)]
    while len(leaves(default)) < 5:
        default = random_doc(rng)
    config = as_rows(spark, [default]).select("path", "value")
    got = cd.merge_defaults_long(as_rows(spark, users), config, "id")
    assert collected(got, len(users)) == [leaves(merge(u, default)) for u in users]

    df = spark.createDataFrame([(i, json.dumps(u)) for i, u in enumerate(users)], "id long, doc string")
    docs = df.select("id", cd.merge_json_defaults("doc", default).alias("doc")).collect()
    assert {r.id: json.loads(r.doc) for r in docs} == {i: merge(u, default) for i, u in enumerate(users)}


def test_merge_a_large_configuration(spark):
    """Fifty thousand defaults, of which documents block some by leaves, nodes and subtrees."""
    config = spark.range(50_000).selectExpr(
        "concat('g', id div 500, '.s', id % 500 div 10, '.k', id) as path", "cast(id as string) as value")
    users = [
        {}, {"g3": 1}, {"g3": {}}, {"g4": {"s7": None, "s8": {"k2080": 5, "k2081": {}}}},
        {"g5": {"s0": {"k2500": {"below": 1}}}, "other": {}}, {"g99": {"s49": [1]}, "g0": {"s0": {"k0": "x"}}},
    ]
    # none, a group, none ({}), a subgroup and two, one, a subgroup and one
    blocked = [0, 500, 0, 10 + 2, 1, 10 + 1]
    got = cd.merge_defaults_long(as_rows(spark, users), config, "id").cache()
    counts = {r.id: r.n for r in got.groupBy("id").agg(F.count("*").alias("n")).collect()}
    own = [len(leaves(u)) for u in users]
    own[2] = 0  # its {} is filled
    assert counts == {i: 50_000 - blocked[i] + own[i] for i in range(len(users))}
    rows = {(r.id, r.path): r.value for r in got.where("path rlike '^(g3|g4|g5|other)([.]|$)'").collect()}
    assert rows[1, "g3"] == "1" and (1, "g3.s0.k1500") not in rows
    assert (2, "g3") not in rows and rows[2, "g3.s0.k1500"] == "1500"
    assert rows[3, "g4.s7"] == "null" and rows[3, "g4.s8.k2080"] == "5" and rows[3, "g4.s8.k2081"] == "{}"
    assert rows[3, "g4.s8.k2082"] == "2082" and rows[4, "g5.s0.k2500.below"] == "1" and rows[4, "other"] == "{}"
    got.unpersist()


def test_the_plan_does_not_grow_with_the_configuration(spark):
    def plan(n):
        config = spark.range(n).selectExpr("concat('a.k', id) as path", "'1' as value")
        merged = cd.merge_defaults_long(as_rows(spark, [{"a": 1}]), config, "id")
        return merged._jdf.queryExecution().optimizedPlan().toString()

    assert abs(len(plan(3)) - len(plan(20_000))) < 100


def text(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_json_get_and_set(spark):
    doc = F.lit('{"a":{"b":1}}')
    assert text(spark, cd.json_get(doc, "a.b", "int")) == 1
    assert text(spark, cd.json_get(doc, "a.z", "int")) is None
    assert text(spark, cd.json_get(F.lit('{"it\'s":{"a.b":2}}'), "it's/a.b", "int", sep="/")) == 2
    with pytest.raises(PySparkException, match="no value at a.z"):
        text(spark, cd.json_get(doc, "a.z", "int", strict=True))
    assert json.loads(text(spark, cd.json_set(doc, "a.b", 9))) == {"a": {"b": 9}}
    assert json.loads(text(spark, cd.json_set(doc, "a.b", 9, soft=True))) == {"a": {"b": 1}}
    assert json.loads(text(spark, cd.json_set(doc, "x.y.z", [1]))) == {"a": {"b": 1}, "x": {"y": {"z": [1]}}}
    with pytest.raises(PySparkException, match="not an object"):
        text(spark, cd.json_set(doc, "a.b.c", 1))


def test_canonical_and_pretty(spark):
    value = {"z": [{"y": 1, "x": "ü"}], "a": {"c": None, "b": 2.5}}
    assert text(spark, cd.canonical_json(F.lit(json.dumps(value)))) == json.dumps(
        value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert text(spark, cd.pretty_json(F.lit(json.dumps(value)))) == json.dumps(value, indent=4, sort_keys=True)


@pytest.mark.parametrize(("given", "want"), [
    ('{"b": 1.0, "a": [1e5, -0, -0.0, 1E+7]}', '{"a":[1e5,-0,-0.0,1E+7],"b":1.0}'),
    ('{"n": ' + "1234567890" * 4 + "1" + "}", '{"n":' + "1234567890" * 4 + "1}"),
    ('{"t": "\\u00011.0", "s": "1.0 \\\\u0001 \\" 2.50 \\u0001\\u00013.5"}',
     '{"s":"1.0 \\\\u0001 \\" 2.50 \\u0001\\u00013.5","t":"\\u00011.0"}'),
    (" 2.50 ", "2.50"), ('"2.50"', '"2.50"'), ('{"a\\"1.0": {"1.0": 1.0}}', '{"a\\"1.0":{"1.0":1.0}}'),
    ("[0.1, 123456789012345678.5, 1.10]", "[0.1,123456789012345678.5,1.10]"),
])
def test_canonical_numbers_stay_as_written(spark, given, want):
    assert text(spark, cd.canonical_json(F.lit(given))) == want


def test_canonical_json_still_rejects(spark):
    for bad in ('{"a": 1.0, "a": 2}', '{"a": 1.2.3}', '{"a": 1.0'):
        with pytest.raises(Exception):
            rows = spark.createDataFrame([(bad,)], "d string")
            rows.select(cd.canonical_json("d")).collect()


@pytest.mark.parametrize("doc", ["[1,2]", "5", "null"])
def test_json_set_needs_an_object(spark, doc):
    rows = spark.createDataFrame([(doc,)], "doc string")
    with pytest.raises(Exception, match="not an object"):
        rows.select(cd.json_set("doc", "a", 1)).collect()
    assert spark.createDataFrame([(None,)], "doc string").select(cd.json_set("doc", "a", 1)).first()[0] is None
