"""Registered queries against their SQL, and the pipeline's stages against plain versions."""

import contextlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadence import llm
from cadence.llm.simhash import near_duplicate_groups
from check import connect, differences
from tests.llm.test_operators import brute_contamination

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", llm.ORACLES)
def test_query_equals_sql(spark, name):
    got = llm.QUERIES[name](spark, FOLDER).toPandas()
    assert differences(got, connect(FOLDER).execute(llm.ORACLES[name]).df()) is None


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in llm.QUERIES) == list(range(1, 14))


def test_tool_calls_stay_in_the_jvm(spark):
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        llm.QUERIES["op4_tool_calls"](spark, FOLDER).explain()
    assert not any(word in plan.getvalue() for word in ("Python", "Arrow", "Pandas"))


def test_language_of_held_out_documents(spark):
    rows = {r.doc_id: r for r in llm.QUERIES["op5_language_id"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in held) >= 0.97 * len(held)


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in llm.QUERIES["op8_toxicity"](spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [i for i in labels if rows[i].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    clean = [rows[i].predicted for i in held if labels[i] == 0]
    toxic = [rows[i].predicted for i in held if labels[i] == 1]
    assert sum(clean) <= 0.02 * len(clean) and sum(toxic) >= 0.6 * len(toxic)


def stage_input(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    item = " ".join(rng.choices(words, k=14))
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(30)]
    texts[4] = texts[2]
    texts[9] += " " + item
    texts[12] = texts[3] + " more"
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    rows += [(90, None, None, None, None), (91, "", "en", "s", 0), (92, "?! 12", "en", "s", 5),
             (0, texts[0], "en", "s", 1), (None, texts[5] + " twice", "en", "s", 1)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.createDataFrame(rows, kind), item


def test_stages(spark, tmp_path):
    docs, item = stage_input(spark)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    def kept(name):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        return out.collect()

    every = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in kept("language")} == every - {90, 91, 92}
    assert len(kept("toxicity")) == docs.count()
    unique = sorted((r.doc_id for r in kept("near_duplicates")), key=str)
    assert unique == sorted(every - {4, 12, None, 91}, key=str)
    hit = {r.doc_id for r in docs.collect() if brute_contamination(r.text, [(1, item)])[1]}
    assert hit == {9} and {r.doc_id for r in kept("decontamination")} == every - hit
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == every


CLASHING = ("language", "score", "found", "row", "__row", "__language", "__score", "__found", "id", "doc",
            "label", "key", "component", "a.b")


def test_stages_keep_clashing_columns_and_long_texts(spark, tmp_path):
    """Columns with the names that stages use, a text of 300,000 words, repeated and null rows."""
    rng = random.Random(13)
    texts = [" ".join(rng.choices("the thing that was there with some other words of it".split(), k=60))
             for _ in range(12)]
    texts += [" ".join(f"the thing number {k} was there" for k in range(60_000)), None, "", texts[0], None]
    rows = [(k if k % 5 else None, t, "en", "s", 1) for k, t in enumerate(texts)]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, kind).withColumns(
        {f"c{k}": F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id"), F.lit(-1))) for k, c in enumerate(CLASHING)}
    ).toDF(*names)
    spark.createDataFrame([(1, "nothing of it")], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == names, name
        out = kept.collect()
        assert {r.text for r in out} - {None, ""} >= set(texts[1:13]) - {None}, name
        for r in out:
            assert [r[c] for c in CLASHING] == [f"{c}-{-1 if r.doc_id is None else r.doc_id}" for c in CLASHING]
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
    packed = dict(corpus_pipeline.STAGES)["packing"]
    assert packed(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == len({r[0] for r in rows})
    assert packed(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_near_duplicates_keep_rows_without_or_with_repeated_ids(spark, tmp_path):
    rng = random.Random(12)
    one, two, three, four, five = (
        " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(5))
    rows = [(1, one), (None, one), (None, two), (None, two), (None, three),
            (7, four), (7, one), (7, five), (8, four), (7, four)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(1, one), (None, two), (None, three), (7, four), (7, five)], key=str)


def test_near_duplicates_are_those_of_the_fingerprint_operator(spark, tmp_path):
    """Texts with one long repeated part and different ends have few shingles in common as sets."""
    rng = random.Random(14)
    line = "the same line of seven words again "
    texts = [line * 200 + " ".join(f"w{k}-{j}" for j in range(12)) for k in range(6)]
    texts += [" ".join(f"v{rng.randint(0, 10**6)}" for _ in range(200)) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {r.component for r in near_duplicate_groups(docs).collect()}
    assert len(want) == 5
    kept = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == want


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = [r.doc_id for r in rows.collect()]
    assert 0 < len(set(ids)) < docs.count()
