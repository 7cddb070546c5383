"""Each operator against a brute-force version, with awkward rows."""

import hashlib
import io
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadence.llm import simhash as sh
from cadence.llm import language_id as lid
from cadence.llm import encoding, token_files, tool_calls
from cadence.llm import toxicity as toxicity_module
from cadence.llm.components import connected_components
from cadence.llm.decontamination import contamination, decontaminate
from cadence.llm.encoding import encoder, tokenizer_json
from cadence.llm.fingerprints import fingerprint, fingerprints, likeness, phrase_ends
from cadence.llm.language_id import identify
from cadence.llm.neighbours import map_with_next
from cadence.llm.packing import pack, plan
from cadence.llm.token_counts import context_totals, length_histogram, quantiles, truncated_total
from cadence.llm.token_files import build_grammar, read_token_files, read_tokens, write_token_files
from cadence.llm.tool_calls import call_levels, link_tool_calls
from cadence.llm.toxicity import (
    Restorer, count_letters, letter_costs, score_toxicity, toxicity, ToxicityModel,
)
from cadence.llm.warc import (
    gzip_member, mark_revisits, read_records, read_warc, record_bytes, sha1_base32, write_warc,
)

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, piece string, start string, score string"
WORDS = "the of that ery thon wher ing tion, Est. Ände çon 漢字 x1 a'b ok".split()


def corpus(n=40, seed=5):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(n)]
    return [*texts, None, "", "  \n\t", texts[0], texts[0], texts[1] + " x", "word " * 5000, "!?"]


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "p", "s", "c") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def library_ids(text):
    tok = Tokenizer.from_file(PATH)
    return tok.encode(text or "", add_special_tokens=False).ids


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def test_encoder_equals_library():
    encode = encoder(tokenizer_json(PATH))
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    letters = "aAéÉßΣς İı'́​ \x1c\x85\n\t\r01½漢!?.,\x00s're<|endoftext|>"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(500)]
    texts += ["<|endoftext|> a", "Re. re.. x.y,", "İ,"] + [t for t in corpus() if t]
    for text in texts:
        assert encode(text) == as_bytes(tok.encode(text, add_special_tokens=False).ids), text


def test_encoder_of_arrays_equals_library(monkeypatch):
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    letters = "aAéÉßªµÿ×÷Σς İı'́​ \x0b\x0c\x1c\x85\xa0\n\t\r01½漢!?.,`$<>|\x00s're<|endoftext|>"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(2000)]
    texts += ["<|endoftext|> a", "abc<|endoftext|>!", "it's its' its'. x'd", "ÉTÉ!!", "a,\u0301b", *corpus()]
    monkeypatch.setattr(encoding, "SLICE_BYTES", 300)
    rows = pa.array([None, *texts, None])
    for plain in (True, False):
        got = list(encoder(tokenizer_json(PATH), letters=plain).each(rows))
        assert len(got) == len(rows)
        for text, ids in zip(rows.to_pylist(), got):
            assert ids == as_bytes(library_ids_of(tok, text)), text
        assert got[5:40] == list(encoder(tokenizer_json(PATH), letters=plain).each(rows.slice(5, 35)))
        assert list(encoder(tokenizer_json(PATH), letters=plain).each(rows.slice(0, 0))) == []


def library_ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


# 1


def test_phrases_are_new_and_extend_known_ones():
    for text in ("", "a", "aaaa", "abracadabra abracadabra"):
        known, start = {""}, 0
        for end in phrase_ends(text):
            phrase = text[start:end]
            assert phrase not in known and phrase[:-1] in known
            known.add(phrase)
            start = end
        assert text[start:] in known


def test_likeness_is_exact_for_small_sets():
    def phrases(text):
        ends = phrase_ends(text)
        return {text[a:b] for a, b in zip([0, *ends], ends)}

    texts = ["", "a", "the other thing", "the other thong", "entirely different"]
    for a in texts:
        for b in texts:
            x, y = phrases(a), phrases(b)
            want = len(x & y) / len(x | y) if x | y else 1.0
            assert likeness(fingerprint(a), fingerprint(b)) == pytest.approx(want)


def test_fingerprint_column(spark):
    docs = frame(spark, corpus())
    got = fingerprints(docs, {"text": "print"}, ("doc_id",)).collect()
    assert {(r.doc_id, r["print"]) for r in got} == {
        (i, fingerprint(t)) for i, t in enumerate(corpus())
    }


def next_order(row):
    """By id, null ids first, then by the hash of the text."""
    return row[0] is not None, row[0] or 0, np.uint64(xxhash.xxh64_intdigest(row[1], 42)).astype(np.int64)


def test_next_rows_of_hot_ids_lie_in_many_ranges(spark):
    """A third of the rows has one id and a third has none."""
    ids = [7] * 400 + [None] * 400 + [3 * k for k in range(400)]
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    order = sorted(rows, key=next_order)

    def join(pairs):
        from pyspark import TaskContext

        for (i, text), (_, following) in pairs:
            yield i, text, following, TaskContext.get().partitionId()

    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        data = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        got = map_with_next(data, "doc_id", join, "a bigint, b string, c string, part int").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = [(i, text, order[(k + 1) % len(order)][1]) for k, (i, text) in enumerate(order)]
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(want, key=str)
    sizes = Counter(r.part for r in got)
    assert len(sizes) >= 10 and max(sizes.values()) <= 2.5 * len(rows) / 12


@pytest.mark.parametrize("ids", [[], [7], [3, 3], [None, 5, None, -2, 9], [5 * k for k in range(50)]])
def test_next_rows(spark, ids):
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    order = sorted(rows, key=next_order)
    want = [(a, b, order[(k + 1) % len(order)][1]) for k, (a, b) in enumerate(order)]

    def join(pairs):
        for (i, text), (_, following) in pairs:
            yield i, text, following

    data = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = map_with_next(data, "doc_id", join, "a bigint, b string, c string").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# 2


def brute_contamination(text, items):
    def words(t):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    own, hit, met = words(text), set(), set()
    for item, item_text in items:
        item_words = words(item_text)
        n = min(10, len(item_words))
        for k in range(len(item_words) - n + 1 if n else 0):
            for at in range(len(own) - n + 1):
                if own[at:at + n] == item_words[k:k + n]:
                    hit |= set(range(at, at + n))
                    met.add(item)
    return len(own), len(hit), sorted(i for i in met if i is not None)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_contamination(spark, limit):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("ab Cd, e9 ü".split(), k=rng.randint(0, 60))) for _ in range(30)]
    texts += [None, "", "--", texts[3]]
    items = [(1, texts[0]), (2, "ab cd, e9"), (2, texts[1]), (None, texts[2]), (4, None), (5, "..")]
    docs = frame(spark, texts).withColumn("found", F.lit("clash"))
    docs = docs.withColumns({"__row": F.lit(7), "__hits": F.lit("h"), "row": F.lit("r"), "a.b": F.lit(1)})
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination(docs, bench, broadcast_bytes=limit)
    assert found.columns == [c for c in docs.columns if c != "found"] + ["found"]
    got = found.collect()
    assert len(got) == len(texts)
    assert {(r["__row"], r["__hits"], r.row, r["a.b"]) for r in got} == {(7, "h", "r", 1)}
    for r in got:
        want = brute_contamination(texts[r.doc_id], items)
        assert (r.found.n_words, r.found.n_hit, r.found.items) == want


def test_removed_spans_leave_nothing(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [f"Before, {item.title()}! after é", "clean text", None, item]
    docs, bench = frame(spark, texts), spark.createDataFrame([(1, item)], "item_id int, text string")
    cleaned = {r.doc_id: r.text for r in decontaminate(docs, bench, remove="spans").collect()}
    assert cleaned == {0: "Before, ! after é", 1: "clean text", 2: None, 3: ""}
    assert {r.doc_id for r in decontaminate(docs, bench).collect()} == {1, 2}
    empty = bench.limit(0)
    assert decontaminate(docs, empty).count() == 4 and decontaminate(docs.limit(0), bench).count() == 0


# 3


def test_context_totals(spark):
    texts = corpus()
    lengths = [len(library_ids(t)) for t in texts]
    totals = context_totals(length_histogram(frame(spark, texts), PATH)).cache()
    for r in totals.collect():
        limit = r.context_limit
        assert r.docs == lengths.count(limit)
        assert r.docs_longer == sum(n > limit for n in lengths)
        assert r.tokens == sum(n for n in lengths if n <= limit)
        assert r.truncated_tokens == sum(min(n, limit) for n in lengths)
        assert r.lost_tokens == sum(lengths) - r.truncated_tokens
    for limit in (0, 1, 17, 10**6):
        assert truncated_total(totals, limit) == sum(min(n, limit) for n in lengths)
    ordered = sorted(lengths)
    assert quantiles(totals, [0.5, 1.0]) == [ordered[-(-len(ordered) // 2) - 1], ordered[-1]]
    assert context_totals(length_histogram(frame(spark, []), PATH)).count() == 0


# 4


def test_levels_and_cycles(spark):
    calls = [("c", "a", None), ("c", "b", ["a", "x"]), ("c", "d", ["b", "a", "a"]), ("c", "e", ["f"]),
             ("c", "f", ["e"]), ("c", "g", ["f"]), ("k", "a", []), ("k", "h", ["h"])]
    data = spark.createDataFrame(calls, "conv_id string, call_id string, after array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in call_levels(data).collect()}
    assert got == {("c", "a"): 0, ("c", "b"): 1, ("c", "d"): 2, ("c", "e"): None, ("c", "f"): None,
                   ("c", "g"): None, ("k", "a"): 0, ("k", "h"): None}


def brute_levels(calls):
    """Longest chains by settling calls one after the other."""
    known = {(c, i) for c, i, _ in calls}
    waits = {(c, i): {(c, p) for p in after or [] if (c, p) in known} for c, i, after in calls}
    levels = {}
    while True:
        now = {k: 1 + max((levels[p] for p in ps), default=-1)
               for k, ps in waits.items() if k not in levels and all(p in levels for p in ps)}
        if not now:
            return {k: levels.get(k) for k in waits}
        levels |= now


def test_levels_of_random_graphs_and_a_long_chain(spark, monkeypatch):
    rng = random.Random(4)
    calls = [("chain", f"c{k}", [f"c{k - 1}"] if k else None) for k in range(1000)]
    for conv in range(40):
        n = rng.randint(1, 12)
        for k in range(n):
            backward = rng.random() < 0.8  # the others may close cycles
            after = [f"c{rng.randrange(k if backward else n)}" for _ in range(rng.randrange(3)) if k or not backward]
            calls.append((f"v{conv}", f"c{k}", after))
    staged, write = [], tool_calls.stage
    monkeypatch.setattr(tool_calls, "stage", lambda df, label: staged.append(label) or write(df, label))
    data = spark.createDataFrame(calls, "conv_id string, call_id string, after array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in call_levels(data).collect()}
    assert got == brute_levels(calls)
    assert any(v is None for v in got.values()) and got["chain", "c999"] == 999
    assert len(staged) <= 12


def test_link_tool_calls(spark):
    schemas = {"get": {"n": "integer", "q?": "string", "o?": "object", "a?": "array", "x?": "number"}}
    cases = {
        '{"q":"é\\n","n":1}': [], '{"n":1.5}': ["n is not integer"], "{}": ["missing n"],
        '{"n":2,"z":0}': ["unexpected z"], "[1]": ["arguments are not an object"],
        "{": ["arguments are not JSON"], None: ["arguments are not JSON"],
        '{"n":1,"o":{"b":1,"a":[]},"a":[1],"x":2.5}': [], '{"n":null}': ["n is not integer"],
    }
    calls = [("c", f"i{k}", k, "get", a, None, "e") for k, a in enumerate(cases)]
    calls += [("c", "i0", 9, "get", "{", None, "e"), ("c", "u", 1, "put", "{}", ["nope"], "e"),
              (None, None, 1, "get", '{"n":1}', None, "e")] + calls[:1]
    results = [("c", "i0", 5, "late", 1), ("c", "i0", 4, 'say "hi"', 1), ("c", "o", 1, None, 1)]
    got = link_tool_calls(
        spark.createDataFrame(calls, "conv_id string, call_id string, turn int, tool string, "
                              "arguments string, after array<string>, errors string"),
        spark.createDataFrame(results, "conv_id string, call_id string, turn int, content string, "
                              "message int"), schemas,
    ).collect()
    by_id = {r.call_id: r for r in got}
    assert len(got) == len(cases) + 3
    for k, errors in enumerate(cases.values()):
        assert by_id[f"i{k}"].errors == errors and by_id[f"i{k}"].valid == (not errors)
    assert by_id["u"].errors == ["unknown tool put", "unknown call nope"]
    assert (by_id["i0"].status, by_id["i0"].n_results) == ("linked", 2)
    assert by_id["o"].status == "orphan" and by_id[None].status == "unanswered"
    assert by_id["i0"].message == (
        '{"arguments":{"n":1,"q":"é\\n"},"id":"i0","name":"get","result":"say \\"hi\\""}'
    )
    for r in got:
        assert json.dumps(json.loads(r.message), ensure_ascii=False, sort_keys=True,
                          separators=(",", ":")) == r.message
    assert link_tool_calls(
        spark.createDataFrame([], "conv_id int, call_id int, turn int, tool string, "
                              "arguments string, after array<string>"),
        spark.createDataFrame([], "conv_id int, call_id int, turn int, content string"), schemas,
    ).count() == 0


# 5


def test_language(spark):
    rng = random.Random(3)
    words = {"aa": "the thing with whom".split(), "bb": "der nicht über schön".split()}
    rows = [(k, " ".join(rng.choices(words[lang], k=20)), lang, "x")
            for k in range(60) for lang in words]
    rows += [(500, None, "aa", "x"), (501, "12 !?", "bb", "x"), (502, "THE THING", None, "x"),
             (None, "schön", None, "x"), (503, "über " * 30000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, language string")
    got = identify(docs, F.lit(True)).collect()
    assert len(got) == len(rows)
    want = {500: "und", 501: "und", 502: "aa", None: "bb", 503: "bb"}
    for r in got:
        assert r.language.lang_pred == want.get(r.doc_id, r.lang)
        assert 0 <= r.language.score <= 1
    unlearned = identify(docs, F.lit(False)).select("language.lang_pred").distinct().collect()
    assert [r.lang_pred for r in unlearned] == ["und"]


def letter_grams(text):
    """Distinct n-grams of one to four letters of each word between blanks, as texts."""
    words = re.split(r"[^\w]|[\d_]", (text or "").lower())
    joined = "".join(f" {w}" for w in words if w) + " "
    return {joined[k:k + n] for n in range(1, 5) for k in range(len(joined) - n + 1)} if joined != " " else set()


def test_grams_are_those_of_letters_between_blanks():
    grams = lid.Grams()
    for text in ("The thing's 12 w1th   ÜBER-whom", "a", "  b  ", "漢字 x", "ab ab ab"):
        assert len(grams(text)) == len(letter_grams(text))
    assert len(grams("12 !?")) == len(grams(None)) == 0


def test_scores_are_those_of_a_dense_kernel_ridge():
    """All texts are landmarks, so the approximation is the kernel regression itself."""
    rng = random.Random(2)
    words = {"aa": "the thing with whom they went there".split(), "bb": "der nicht über schön und wir gehen".split(),
             "cc": "el niño que está con nosotros hoy".split()}
    pairs = [(" ".join(rng.choices(words[lang], k=rng.randint(1, 9))), lang) for _ in range(12) for lang in words]
    texts, labels = [t for t, _ in pairs], [lang for _, lang in pairs]
    model = lid.fit(texts, labels, landmarks=3 * len(texts))
    sets = [letter_grams(t) for t in texts]

    def kernel(a, b):
        return len(a & b) / np.sqrt(len(a) * len(b))

    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    target = np.array([[1.0 if lang == n else -1.0 for n in sorted(words)] for lang in labels])
    # the ridge weighs the norm in the kernel's space, as it does that of the features
    dual = np.linalg.solve(k + lid.RIDGE * len(texts) * np.eye(len(texts)), target)
    grams = lid.Grams()
    for text in ("the thing went", "schön und der", "que está", "wir went con", "zzz the"):
        own = np.array([kernel(letter_grams(text), s) for s in sets])
        assert np.allclose(model.scores([grams(text)])[0], own @ dual, atol=2e-3)
    # the bound follows from regressions that leave one text out each
    left_out = []
    for i in range(len(texts)):
        rest = [j for j in range(len(texts)) if j != i]
        part = np.linalg.solve(k[np.ix_(rest, rest)] + lid.RIDGE * len(texts) * np.eye(len(rest)), target[rest])
        left_out.append((k[i, rest] @ part).max())
    enough = [v for v, s in zip(left_out, sets) if len(s) >= lid.EVIDENCE]
    assert model.least == pytest.approx(min(lid.CLAIMED, np.quantile(enough, lid.MISSED)), abs=5e-3)


def test_texts_that_no_language_claims(spark):
    """Other scripts, other languages and gibberish are foreign; nearly all documents are not."""
    foreign = [
        "Это русский текст о погоде в Москве и о том, как мы живём", "これは日本語の文章です。今日は天気がいいですね。明日は雨。",
        "Ζούμε στην Αθήνα και ο καιρός είναι καλός σήμερα", "To jest polskie zdanie o pogodzie i o życiu w mieście",
        "Tämä on suomenkielinen lause säästä ja elämästä kaupungissa", "asdf qwer zxcv hjkl uiop bnmm tyui",
        "Bu bir Türkçe cümledir ve hava hakkında",
    ]
    rows = [(-1 - k, t, None) for k, t in enumerate(foreign)]
    rows += [(-100, "ok", None), (-101, "12 !", None), (-102, None, None)]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    docs = given.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    known = {r.doc_id: r.language.known for r in identify(docs, F.lit(True)).collect()}
    assert not any(known[-1 - k] for k in range(len(foreign)))
    assert (known[-100], known[-101], known[-102]) == (True, False, False)
    letters = [r.doc_id for r in given.where("text rlike '\\\\p{L}'").collect()]
    assert sum(known[k] for k in letters) >= 0.995 * len(letters) and len(letters) > 900
    unlearned = {r.doc_id: r.language.known for r in identify(docs, F.lit(False)).collect()}
    assert all(unlearned[k] for k in letters) and not unlearned[-101] and not unlearned[-102]


def test_one_repeated_text_leaves_other_languages_to_be_learned(spark):
    rows = [(7, "der nicht über schön", "bb")] * 400 + [(k, f"the thing with whom {k}", "aa") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert lid.learn(docs, rows=20).languages == ["aa", "bb"]


# 6


def brute_simhash(text, size):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("crowd", [1024, 2])
def test_simhash_groups(spark, monkeypatch, crowd):
    monkeypatch.setattr(sh, "CROWD", crowd)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 50)}" for _ in range(300)]
    texts = corpus(20)
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(300)] = "edit"
        texts.append(" ".join(copy))
    want_print = [brute_simhash(t, 4) for t in texts]
    want = brute_components(
        range(len(texts)), lambda a, b: (want_print[a] ^ want_print[b]).bit_count() <= 4
    )
    got = sh.near_duplicate_groups(frame(spark, texts))
    got = got.select("id", sh.hex_digits(F.col("fp")).alias("fp"), "component").collect()
    assert {tuple(r) for r in got} == {
        (k, f"{want_print[k]:016x}", want[k]) for k in range(len(texts))
    }
    assert len(set(want.values())) < len(texts) - 10


@pytest.mark.parametrize("fingerprints_given", [[], [5], [0, (1 << 64) - 1, 15, 31, 1 << 63]])
def test_simhash_links(spark, fingerprints_given):
    data = [(int(np.uint64(x).astype(np.int64)),) for x in fingerprints_given]
    links = sh.similar_links(spark.createDataFrame(data, "fp bigint"))
    comps = {r.node: r.component for r in connected_components(links).collect()}
    close = [x for x, in data if any(
        0 < ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 4 for y, in data)]
    assert set(comps) == set(close)


def test_simhash_entries_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sh, "CROWD", 2)
    plans, stage = [], sh.stage

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label)

    monkeypatch.setattr(sh, "stage", seen)
    links = sh.similar_links(spark.createDataFrame([(k,) for k in range(12)], "fp bigint"))
    plans.append(links._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and not any("BroadcastHashJoin" in p for p in plans)
    comps = {r.node: r.component for r in connected_components(links).collect()}
    assert comps == {k: 0 for k in range(12)}


def test_components_of_chains(spark):
    rng = random.Random(6)
    chain = list(range(0, 60))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(100, k) for k in range(101, 140)] + [(7, 7)]
    data = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(data).collect()}
    assert got == {k: 0 for k in range(60)} | {k: 100 for k in range(100, 140)}


def test_similar_groups(spark):
    rng = random.Random(8)
    texts, family = [], []
    for f in range(6):
        base = [f"v{rng.randint(0, 900)}" for _ in range(400)]
        for edits in (0, 1, 2, 4, 6):  # each edit changes five shingles: 0.86 alike and more
            copy = list(base)
            for at in rng.sample(range(400), edits):
                copy[at] = f"edit{rng.randint(0, 900)}"
            texts.append(" ".join(copy))
            family.append(f)
    texts += [None, "", texts[0]]
    family += ["none", "none", 0]
    got = {r.id: r.component for r in sh.similar_groups(frame(spark, texts)).collect()}
    assert got == {k: family.index(f) for k, f in enumerate(family)}


def test_similar_groups_join_no_pair_below_the_similarity(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):  # chains of five, whose neighbours are about 0.74, 0.78, 0.82 and 0.9 alike
        words = [f"v{rng.randint(0, 10**6)}" for _ in range(400)]
        texts.append(" ".join(words))
        for edits in (12, 10, 8, 4):
            words = list(words)
            for at in range(0, edits * 30, 30):
                words[at + rng.randint(0, 20)] = f"edit{rng.randint(0, 10**6)}"
            texts.append(" ".join(words))
    sets = [{tuple(t.split()[k:k + 5]) for k in range(396)} for t in texts]
    root = list(range(len(texts)))
    for y in range(len(texts)):
        for x in range(y - y % 5, y):
            if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.8 and root[x] != root[y]:
                old, new = max(root[x], root[y]), min(root[x], root[y])
                root = [new if r == old else r for r in root]
    assert 45 < len(set(root)) < 190
    got = {r.id: r.component for r in sh.similar_groups(frame(spark, texts)).collect()}
    assert got == dict(enumerate(root))


def test_similar_groups_leave_out_finished_buckets(spark, monkeypatch):
    rng = random.Random(12)
    texts = []
    for family in range(3):  # pairs of a family are 0.3 to 0.95 alike, so most buckets stay apart
        base = [f"v{family}-{rng.randint(0, 10**6)}" for _ in range(200)]
        for _ in range(30):
            words = list(base)
            for at in rng.sample(range(200), rng.randint(1, 12)):
                words[at] = f"edit{rng.randint(0, 10**6)}"
            texts.append(" ".join(words))
    monkeypatch.setattr(sh, "NEAREST", 1)
    monkeypatch.setattr(sh, "LEAST_LINKED", 0)
    keys_of, rounds = sh._Candidates.keys_of, []

    def seen(self, nodes):
        rounds.append(nodes.count())
        return keys_of(self, nodes)

    monkeypatch.setattr(sh._Candidates, "keys_of", seen)
    got = {r.id: r.component for r in sh.similar_groups(frame(spark, texts)).collect()}
    sets = [{tuple(t.split()[k:k + 5]) for k in range(196)} for t in texts]
    want = brute_components(
        range(len(texts)), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    assert got == want
    assert len(rounds) >= 2 and rounds[-1] < rounds[0] <= len(texts)


def test_similar_groups_deal_a_crowd_into_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"v{rng.randint(0, 10**6)}" for _ in range(200)]
    texts = []
    for _ in range(300):
        words = list(base)
        for at in rng.sample(range(200), 2):
            words[at] = f"edit{rng.randint(0, 10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.randint(0, 10**6)}" for _ in range(50)) + " " + " ".join(base[:60])
              for _ in range(20)]
    monkeypatch.setattr(sh, "BLOCK", 50)
    dealt, largest = sh._Candidates._dealt, []

    def seen(shared):
        others, members = dealt(shared)
        largest.append(members.groupBy("key", "block").count().agg(F.max("count")).first()[0])
        return others, members

    monkeypatch.setattr(sh._Candidates, "_dealt", staticmethod(seen))
    got = {r.id: r.component for r in sh.similar_groups(frame(spark, texts)).collect()}
    sets = [{tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for y in range(len(texts)):
        for x in range(y):
            if root[x] != root[y] and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.8:
                old, new = max(root[x], root[y]), min(root[x], root[y])
                root = [new if r == old else r for r in root]
    assert got == dict(enumerate(root))
    assert largest and max(filter(None, largest), default=0) <= 100


# 7


class Archive(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("wrap", [gzip_member, bytes, __import__("gzip").compress])
def test_records_round_trip(wrap):
    rows = [{"record_type": "response", "record_id": f"<urn:page:{k}>", "date": None,
             "target_uri": "http://x/\r\ny", "refers_to": None, "payload": b"a\r\n\r\n" * k * 200,
             "payload_digest": None, "payload_bytes": None} for k in range(20)]
    data = b"".join(wrap(record_bytes(r)) for r in rows)
    got = list(read_records(Archive(data), lambda r: True))
    assert [g["payload"] for g in got] == [r["payload"] for r in rows]
    assert {g["target_uri"] for g in got} == {"http://x/%0D%0Ay"}
    some = list(read_records(Archive(data), lambda r: r["record_id"].endswith("7>"), payload=False))
    assert [(s["payload"], s["payload_bytes"]) for s in some] == [(None, 7000), (None, 17000)]
    broken = data.replace(b"a\r\n", b"b\r\n", 1) if wrap is bytes else None
    if broken:
        with pytest.raises(ValueError, match="differs from its digest"):
            list(read_records(Archive(broken), lambda r: True))


def test_warc_source(spark, tmp_path):
    pages = [(3, "u3", "same"), (1, "u1", "same"), (1, "u1", "same"), (2, None, None), (9, "u9", ""),
             (4, "u4", "é" * 70000), (None, "n", "same")]
    data = spark.createDataFrame(pages, "page_id int, url string, html string").withColumn(
        "record_type", F.lit("clash"))
    marked = mark_revisits(data, "page_id", "html")
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in marked.collect()), key=str) == [
        (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1),
        (4, "response", None), (9, "revisit", 2), (None, "revisit", 1)]
    small = mark_revisits(data, "page_id", "html", least_bytes=1).where("page_id = 9").first()
    assert small.record_type == "response"
    path = str(tmp_path / "warc")
    write_warc(marked.select(
        F.col("page_id").cast("string").alias("record_id"), "record_type",
        F.col("url").alias("target_uri"), F.col("refers_to").cast("string").alias("refers_to"),
        F.col("html").cast("binary").alias("payload")), path)
    back = {(r.record_id, r.record_type): r for r in read_warc(spark, path).collect()}
    assert back["4", "response"].payload == ("é" * 70000).encode()
    assert back["3", "revisit"].payload is None and back["3", "revisit"].payload_bytes == 4
    assert back["3", "revisit"].payload_digest == sha1_base32(b"same")
    revisits = read_warc(spark, path, payload=False).where(
        "record_type = 'revisit' AND target_uri LIKE 'u%'")
    assert sorted(r.record_id for r in revisits.collect()) == ["3", "9"]
    write_warc(marked.limit(0).select("record_type"), str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0


# 8


def test_restoring():
    text = " ".join(["a stupid idiot and a loser went", "the thing that then is there",
                     "a letter for all the good class", "an ass is there"] * 50)
    counts = np.zeros(61 ** 3, np.int64)
    from cadence.llm.toxicity import LETTERS, letter_codes
    codes = letter_codes("  " + "  ".join(text.split()) + "  ")
    np.add.at(counts, (codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:], 1)
    restorer = Restorer(letter_costs(counts))
    cases = {"1d10t": "idiot", "$tup1d!!": "stupid", "stuuuupid": "stupid", "l0$er": "loser",
             "s t u p i d": "stupid", "IDIOT###": "idiot", "thing": "thing", "12.5": "12.5", "": "",
             "stuupid": "stupid", "iidiot": "idiot", '"i d i o t"': "idiot", "(i d i o t)": "idiot",
             "a s s": "ass", "i  d  i  o  t": "idiot", "id-iot": "idiot", "$ t u p i d": "stupid",
             "i*d*i*o*t": "idiot", "i.d.i.o.t": "idiot", "a i*d*i*o*t went": "a idiot went",
             "455": "ass", "123456789": "123456789", "2024-01-02": "2024-01-02", "1 2 3 4": "1 2 3 4",
             "letter all good": "letter all good", "class": "class"}
    assert {k: restorer.text(k) for k in cases} == cases
    assert restorer.text(None) == ""


def test_viterbi_is_the_cheapest_path():
    rng = np.random.default_rng(0)
    restorer = Restorer(letter_costs(rng.integers(0, 9, 61 ** 3)))
    for word in ("1d10t", "aa0b", "lll5"):
        lattice = restorer._lattice(word)
        paths = [("", 0.0)]
        for readings in lattice:
            paths = [(t + r, c + cost) for t, c in paths for r, cost in readings]

        def cost(text, extra):
            codes = [59, 59, *(restorer._code(c) for c in text), 59]
            return extra + sum(restorer.costs[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))

        assert restorer.decode(lattice) == min(paths, key=lambda p: cost(*p))[0]


def test_plain_words_and_numbers_are_decided_as_by_the_lattice():
    rng = np.random.default_rng(5)
    for draw in range(6):
        restorer = Restorer(letter_costs(rng.integers(0, 2000, 61 ** 3) * (rng.random(61 ** 3) < 0.1 * (draw + 1))))
        words = ["".join(rng.choice(list("abcdeé漢"), rng.integers(1, 7))) for _ in range(150)]
        words += ["".join(rng.choice(list("0123456789"), rng.integers(3, 9))) for _ in range(150)]
        words += [w[:k] + w[k] + w[k:] for w in words[:150] for k in [len(w) // 2]] + ["aab", "baa", "aa", "a"]
        assert [restorer.restore(w) for w in words] == [restorer.decode(restorer._lattice(w)) for w in words]


def test_weights_are_the_optimum_of_the_penalised_likelihood():
    rng = np.random.default_rng(3)
    rows = [(sorted(rng.choice(6, rng.integers(0, 4), replace=False).tolist()), float(n), float(rng.uniform(0, n)))
            for n in rng.integers(1, 30, 40)]
    weights, base = toxicity_module.fit_weights(rows, 6)

    def loss(w):
        total = 0.5 * toxicity_module.RIDGE * (w[:6] ** 2).sum() + 0.5e-3 * w[6] ** 2
        for present, n, toxic in rows:
            z = w[6] + w[present].sum()
            total += n * np.log1p(np.exp(z)) - toxic * z
        return total

    best = np.append(weights, base)
    for step in [*np.eye(7), *rng.normal(size=(20, 7))]:
        for size in (1e-3, -1e-3, 0.1, -0.1):
            assert loss(best) <= loss(best + size * step) + 1e-9


def test_rare_toxic_labels_are_all_learned_from(spark):
    rng = random.Random(4)
    plain = "this that there when then other thing long with some more".split()
    rows = [(k, " ".join(rng.choices(plain, k=12)) + (" vilest" if k % 50 == 0 else "")) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(k, int(k % 50 == 0)) for k, _ in rows], "doc_id int, toxic int")
    model = toxicity_module.learn_toxicity(docs, labels, rows=100)
    scores = {r.doc_id: r.s for r in docs.select("doc_id", toxicity(spark, model, F.col("text")).alias("s")).collect()}
    assert all((scores[k] >= 0.7) == (k % 50 == 0) for k, _ in rows)
    assert np.mean(list(scores.values())) < 0.1  # the clean ones weigh as much as there are of them


def test_toxicity_scores(spark):
    rng = random.Random(9)
    plain = "this that there when then other thing long".split()
    rows, labels = [], []
    for k in range(200):
        words = rng.choices(plain, k=15)
        if k % 4 == 0:
            words[rng.randrange(15)] = "vilest"
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0), 1))
    rows += [(900, "v1l3st thing"), (901, "v i l e s t"), (902, None), (903, ""), (904, "this that"),
             (0, rows[0][1]), (None, "vilest")]
    labels += [(0, None, 0), (12345, 1, 0), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("score", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id int, toxic int, quality int")
    got = score_toxicity(docs, marks, F.lit(True), "score").collect()
    assert len(got) == len(rows)
    for r in got:
        toxic = r.text is not None and "v" in r.text
        assert (r.score >= 0.7) == toxic, r
    none = score_toxicity(docs, marks.limit(0), F.lit(True), "score")
    assert none.agg(F.max("score")).first()[0] < 0.1
    assert score_toxicity(docs.limit(0), marks, F.lit(True), "score").count() == 0
    assert count_letters(docs).sum() > 0
    same = toxicity(spark, ToxicityModel(letter_costs(count_letters(docs))), F.col("text"))
    assert docs.select(same.alias("s")).distinct().count() == 1


# 9


def test_plan_places_every_piece_once():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([1, 5, 10, 30, 100])
        counts = {rng.randint(1, capacity): rng.randint(0, 9) for _ in range(rng.randint(0, 30))}
        placed, fill = Counter(), defaultdict(list)
        for length, first, n, sequence, offset in plan(counts, capacity):
            assert placed[length] == first
            placed[length] += n
            for k in range(n):
                fill[sequence + k].append((offset, length))
        assert placed == +Counter(counts)
        for pieces in fill.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= capacity and sum(3 * n > capacity for _, n in pieces) <= 2


def plain_packing(pieces, capacity):
    """Sequences by the method, piece by piece: large ones paired greedily, small ones best fit."""
    large = sorted(n for n in pieces if 3 * n > capacity)
    bins = []
    while large:
        own = large.pop()
        fits = [k for k, n in enumerate(large) if own + n <= capacity]
        bins.append([own, large.pop(fits[-1])] if fits else [own])
    for n in sorted((n for n in pieces if 3 * n <= capacity), reverse=True):
        room = [(capacity - sum(b), k) for k, b in enumerate(bins) if sum(b) + n <= capacity]
        if room:
            bins[min(room)[1]].append(n)
        else:
            bins.append([n])
    return bins


def test_plan_makes_as_many_sequences_as_piece_by_piece():
    rng = random.Random(8)
    for _ in range(500):
        capacity = rng.choice([3, 10, 30, 64, 100])
        pieces = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.3:
            pieces += [rng.randint(1, capacity)] * rng.randint(1, 40)
        made = defaultdict(int)
        for length, _, n, sequence, _ in plan(Counter(pieces), capacity):
            for k in range(n):
                made[sequence + k] += length
        plain = plain_packing(pieces, capacity)
        assert len(made) == len(plain)
        assert sorted(made.values()) == sorted(map(sum, plain))


def test_packing(spark):
    texts = corpus()
    got = pack(frame(spark, texts), PATH, capacity=64, end_id=0).collect()
    want = Counter()
    for k, text in enumerate(texts):
        ids = [*library_ids(text), 0]
        for n, at in enumerate(range(0, len(ids), 64)):
            want[k, n, at, as_bytes(ids[at:at + 64])] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got) == want
    fill = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4
        fill[r.sequence_id].append((r.offset, r.length))
    for pieces in fill.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert pack(frame(spark, []), PATH, capacity=64).count() == 0


# 10


def test_grammar_expands_to_its_ids():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 3, 500), np.zeros(300, int), np.arange(50)):
        starts = np.array([0, 20, 21])
        grammar = build_grammar(ids.astype("<u4"), starts)
        rules = {}
        for n, (a, b) in enumerate(grammar.rules.tolist()):
            rules[grammar.first_rule + n] = rules.get(a, [a]) + rules.get(b, [b])
            assert len(rules[grammar.first_rule + n]) == grammar.lengths[n]
        parts = [
            [i for s in grammar.symbols[a:b].tolist() for i in rules.get(s, [s])]
            for a, b in zip(grammar.first, grammar.first[1:])
        ]
        assert parts == [ids[:20].tolist(), ids[20:21].tolist(), ids[21:].tolist()]


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(2)
    cases = [rng.integers(0, 30, 20_000), np.zeros(5000, int), rng.zipf(1.3, 30_000) % 5000,
             np.tile(rng.integers(0, 900, 700), 40), np.arange(10)]
    for ids in cases:
        starts = np.unique(np.concatenate([[0], rng.integers(0, len(ids), len(ids) // 50)]))
        grammar = build_grammar(ids.astype("<u4"), starts)
        symbols, opens = grammar.symbols.tolist(), set(grammar.first.tolist())
        counts = Counter()
        at = 0
        while at < len(symbols) - 1:  # occurrences that do not overlap
            if at + 1 in opens:
                at += 1
                continue
            pair = symbols[at], symbols[at + 1]
            counts[pair] += 1
            twin = pair[0] == pair[1] and at + 2 < len(symbols) and symbols[at + 2] == pair[0]
            at += 2 if twin and at + 2 not in opens else 1
        assert max(counts.values(), default=0) < 8


def test_pairs_that_share_a_slot_do_not_stop_the_rounds(monkeypatch):
    monkeypatch.setattr(token_files, "SLOTS", 4)
    ids = np.random.default_rng(3).integers(0, 40, 8000)
    grammar = build_grammar(ids.astype("<u4"), np.array([0]))
    pairs = Counter(zip(grammar.symbols.tolist(), grammar.symbols[1:].tolist()))
    assert max(pairs.values()) < 8 and len(grammar.rules) > 100


def test_random_access_reads_one_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 60)
    monkeypatch.setattr(token_files, "FILE_BLOCKS", 3)
    rng, out = random.Random(6), token_files.TokenFileWriter(
        str(tmp_path / "t"), lambda: encoder(tokenizer_json(PATH)), 2)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 40))) for _ in range(80)]
    ids = [None, *range(-5, 74)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(token_files.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    out.commit([out.write(iter([batch]))])
    files = token_files.Folder(str(tmp_path / "t")).manifest()
    assert len(files) > 5
    opened, read = [], token_files.read_block
    monkeypatch.setattr(token_files, "read_block", lambda file, at: opened.append(at) or read(file, at))
    for doc_id, text in zip(ids[1:], texts[1:]):
        want = [*library_ids(text), 2]
        start, stop = rng.randint(0, len(want)), rng.randint(0, len(want) + 3)
        assert read_tokens(str(tmp_path / "t"), doc_id, start, stop).tolist() == want[start:stop]
        assert len(opened) == 1, doc_id
        opened.clear()
    with pytest.raises(KeyError):
        read_tokens(str(tmp_path / "t"), 999)


def test_token_files_encode_a_word_once_a_batch_when_none_is_remembered(tmp_path, monkeypatch):
    monkeypatch.setattr(encoding, "WORDS_KEPT", 0)
    encoding.forget_words()
    encoded, encode = Counter(), encoding._Words.encode
    monkeypatch.setattr(encoding._Words, "encode", lambda self, word: encoded.update([word]) or encode(self, word))
    out = token_files.TokenFileWriter(str(tmp_path / "t"), lambda: encoder(tokenizer_json(PATH)), 2)
    texts = ["Stone stone, stone!!! STONE"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(token_files.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    out.commit([out.write(iter([batch]))])
    assert read_tokens(str(tmp_path / "t"), 7).tolist() == [*library_ids(texts[7]), 2]
    assert encoded == {"stone": 1, ",": 1, "!!!": 1}


def test_token_files(spark, tmp_path):
    texts = corpus()
    ids = [3 * k - 20 for k in range(len(texts))]
    ids[3] = None
    path = str(tmp_path / "tokens")
    docs = frame(spark, texts, ids)
    write_token_files(docs.union(docs.where("doc_id = 10")), path, PATH, end_id=2)
    rows = sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0] or 0))
    rows = [r for r in rows for _ in range(2 if r[0] == 10 else 1)]
    want, start = [], 0
    for doc_id, text in rows:
        own = [*library_ids(text), 2]
        want.append((doc_id, start, len(own), zlib.crc32(as_bytes(own))))
        start += len(own)
    got = read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    long = library_ids(texts[-2])
    assert read_tokens(path, ids[-2], 30, 41).tolist() == long[30:41]
    empty = str(tmp_path / "empty")
    write_token_files(frame(spark, []), empty, PATH, end_id=2)
    assert read_token_files(spark, empty).count() == 0


def test_edited_half(spark):
    from cadence.llm.queries import _edited_half
    texts = ["abc é long text here", "x", "", "tail of it"]
    rows = [((k, t), (k, texts[(k + 1) % 4])) for k, t in enumerate(texts)]
    for (k, text), made in zip(enumerate(texts), _edited_half(iter(rows))):
        half = len(text) // 2
        edited = text[:len(text) - half] + texts[(k + 1) % 4][:half]
        assert made[:5] == (k, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                            fingerprint(text), fingerprint(edited))
