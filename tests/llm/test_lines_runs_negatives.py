"""Line dedup, periodic runs and hard negatives against brute-force versions, with awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import hard_negatives, line_dedup, periodic_runs
from cadence.llm.hard_negatives import mine_hard_negatives
from cadence.llm.line_dedup import LineIndex, PerfectHash, dedup_lines, line_key, long_enough
from cadence.llm.periodic_runs import collapse_runs, find_runs
from cadence.llm.queries import with_periodic_tails

WHITE = " \t\n\v\f\r"
LOWER = {k: k + 32 for k in range(65, 91)}


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


# lines ------------------------------------------------------------------------------------------

def brute_lines(rows, least_chars=20, least_documents=3):
    """(id, text) rows to their text, number of lines and number of dropped lines."""
    holders = defaultdict(list)
    for id_, text in rows:
        place = float("-inf") if id_ is None else id_
        for key in {line.strip(WHITE).translate(LOWER) for line in (text or "").split("\n")}:
            if len(key) >= least_chars:
                holders[key].append(place)
    last = {k: max(p) for k, p in holders.items() if len(p) >= least_documents}
    out = []
    for id_, text in rows:
        place = float("-inf") if id_ is None else id_
        lines = (text or "").split("\n")
        left = [line for line in lines
                if place >= last.get(line.strip(WHITE).translate(LOWER), float("-inf"))]
        out.append((id_, None if text is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return out


def line_rows():
    rng = random.Random(3)
    common = ["A line that many documents share", "ein Satz über zwanzig Zeichen, Ä ö ü", "x" * 19,
              "ä" * 20, "ä" * 19, "漢" * 19 + "字", "é" * 10 + "12345678", "  Subscribe to our newsletter \t"]
    rows = []
    for k in range(60):
        lines = [f"line {k} {j} with words of its own" if rng.random() < 0.5 else rng.choice(common)
                 for j in range(rng.randrange(9))]
        lines = [rng.choice(["", " ", "\t\r", "\v"]) + line.swapcase() if rng.random() < 0.3 else line
                 for line in lines]
        rows.append((k, "\n".join(lines)))
    rows += [(None, "A line that many documents share\n"), (None, None), (61, ""), (62, "\n\n"), (62, None),
             (63, "A line that many documents share"), (63, "A line that many documents share"),
             (None, "held by no row with an id, thrice"), (None, "held by no row with an id, thrice"),
             (None, "held by no row with an id, thrice"), (64, "\n".join(["the same line in one document only"] * 5)),
             (65, "\n".join(f"a very long text, line {k % 700}" for k in range(5000)) + "\n" + common[0]),
             (-7, common[0]), (66, "a line separator is no end\u0085of a line\x1c, here")]
    return rows


@pytest.mark.parametrize("shard_keys, probes", [(1 << 18, 1 << 20), (2, 5)])
def test_dedup_lines(spark, monkeypatch, shard_keys, probes):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(line_dedup, "PROBES", probes)
    rows = line_rows()
    docs = spark.createDataFrame(
        [(i, t, k, 1, "s", "p") for k, (i, t) in enumerate(rows)],
        "doc_id bigint, text string, `row.number` int, lines int, place string, h1 string").repartition(3)
    got = dedup_lines(docs)
    assert set(got.columns) == set(docs.columns)
    out = {r["row.number"]: (r.doc_id, r.text, *r.lines) for r in got.collect()}
    assert [out[k] for k in range(len(rows))] == brute_lines(rows)
    assert {(r.place, r.h1) for r in got.collect()} == {("s", "p")}


def test_dedup_lines_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert dedup_lines(docs).collect() == []
    one = spark.createDataFrame([(None, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in dedup_lines(one).collect()] == [(None, None, (1, 0))]


def test_line_keys():
    assert line_key(" \t\v\fAbC Ä\r".encode()) == "abc Ä".encode()
    for text in ("ä" * 20, "a" * 20, "漢" * 20, "😀" * 20, "a" * 90):
        assert long_enough(text.encode(), 20)
    for text in ("ä" * 19, "a" * 19, "漢" * 19, "😀" * 19, ""):
        assert not long_enough(text.encode(), 20)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    words = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    words[0, : n // 3] = 7  # pairs that share a word
    numbers = PerfectHash.build(*words).slots(*words)
    assert sorted(numbers.tolist()) == list(range(n))


def test_index_tells_other_lines_apart():
    rng = np.random.default_rng(5)
    first, second = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    counts, last = rng.integers(3, 1 << 31, 5000), rng.integers(-9, 1 << 60, 5000)
    index = LineIndex.load(LineIndex.build(first, second, counts, last).dump())
    found = index.probe(first, second)
    assert (found[0] == counts).all() and (found[1] == last).all()
    assert not index.probe(first, second ^ np.uint64(1 << 40))[0].any()
    assert not index.probe(*rng.integers(0, 1 << 63, (2, 100_000), dtype=np.uint64))[0].any()


# runs -------------------------------------------------------------------------------------------

def brute_runs(words, least=6, power=4):
    found = {}
    for q in range(1, len(words) // power + 1):
        k = 0
        while k + q < len(words):
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            length = k + q - start
            if length >= max(least, power * q):
                found.setdefault((start, length), q)  # the smallest period comes first
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def split_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_find_runs_of_many_small_texts():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, letters = rng.randint(0, 45), rng.choice([1, 2, 3, 5])
            words = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        least, power = rng.choice([1, 6]), rng.choice([2, 3, 4])
        sizes = np.array([len(t) for t in texts])
        got = find_runs(np.array(sum(texts, []), np.int64), sizes, least, power)
        want, before = [], 0
        for words in texts:
            want += [(s + before, n, q) for s, n, q in brute_runs(words, least, power)]
            before += len(words)
        assert list(zip(*(c.tolist() for c in got))) == want


def run_texts():
    rng = random.Random(7)
    texts = [None, "", " \t\r\n\v\f ", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "buy now " * 9,
             "x " + "to be or not " * 4 + "to be", "漢字   漢字 " * 8, "go\x1cgo " * 7, "w " * 3000,
             " ".join(f"{k % 37}" for k in range(4000)), "one two " * 6 + "one " * 8]
    for _ in range(60):
        texts.append(" ".join(rng.choices("ab" if rng.random() < 0.5 else "abcdef", k=rng.randrange(80))))
    return texts + texts[-2:]


@pytest.mark.parametrize("group_bytes, expanded", [(1 << 20, 1 << 20), (64, 3)])
def test_collapse_runs(spark, monkeypatch, group_bytes, expanded):
    monkeypatch.setattr(periodic_runs, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(periodic_runs, "EXPANDED", expanded)
    texts = run_texts()
    want = []
    for text in texts:
        words = split_words(text)
        runs = brute_runs(words)
        want.append((len(words), runs, collapsed(words, runs)))
    groups = periodic_runs._groups(periodic_runs.pa.array(texts, "string"))
    parts = [periodic_runs._collapsed(g, 6, 4).to_pylist() for g in groups]
    assert [(r["n_words"], [tuple(x.values()) for x in r["runs"]], r["text"]) for p in parts for r in p] == want

    docs = spark.createDataFrame(
        [(k, t, "p", "s") for k, t in enumerate(texts)],
        "doc_id bigint, `a.text` string, periodic string, start string").repartition(3)
    got = collapse_runs(docs, "a.text")
    assert got.columns == docs.columns
    rows = {r.doc_id: r.periodic for r in got.collect()}
    assert [(rows[k].n_words, [tuple(x) for x in rows[k].runs], rows[k].text) for k in range(len(texts))] == want
    assert collapse_runs(docs.limit(0), "a.text").collect() == []


def edited(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_of_periodic_runs(spark, tmp_path):
    from cadence.llm.queries import op12_periodic_runs

    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices("abc" if k % 3 else "abcdefghijklmnop", k=rng.randrange(120))))
            for k in range(400)]
    rows += [(k, t) for k, t in enumerate(run_texts(), 400)] + [(None, "a " * 9), rows[0]]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text in rows:
        words = edited(doc_id, split_words(text))
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        want.append((
            doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha256(collapsed(words, runs))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(edited(i, split_words(t)) != split_words(t) for i, t in rows) > 20


def test_periodic_tails_leave_other_texts_alone(spark):
    docs = spark.createDataFrame([(k, f" x {k}  y ") for k in range(300)], "doc_id bigint, text string")
    for r in with_periodic_tails(docs).collect():
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            assert r.text == f" x {r.doc_id}  y "


# negatives --------------------------------------------------------------------------------------

def brute_negatives(rows, is_anchor, n_pos=5, n_neg=5):
    """(id, vector, label) rows to (anchor, positive, rank, negative, scores)."""
    part = [(i, [int(np.floor(x)) for x in v], label) for i, v, label in rows
            if v is not None and label is not None
            and all(x is not None and np.isfinite(x) for x in v)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    def order(entry):
        return -entry[0], entry[1] is None, entry[1] or 0, entry[2]

    out = []
    for k, (anchor, vector, label) in enumerate(part):
        if not is_anchor(anchor):
            continue
        scored = [(score(vector, v), i, j, own) for j, (i, v, own) in enumerate(part) if j != k]
        near = sorted((s[:3] for s in scored if s[3] == label), key=order)[:n_pos]
        others = sorted((s[:3] for s in scored if s[3] != label), key=order)
        for limit, positive, _ in near:
            window = [s for s in others if 80 * limit <= 100 * s[0] <= 100 * limit][:n_neg]
            out += [(anchor, positive, rank, s[1], limit, s[0]) for rank, s in enumerate(window, 1)]
    return out


def vector_rows():
    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(-3, 6, 6).astype(float).tolist(), int(rng.integers(0, 3))) for k in range(220)]
    rows += [(300, [2.0] * 6, 1), (301, [2.0] * 6, 1), (301, [2.0] * 6, 0), (302, [2.0] * 6, 0),
             (400, None, 1), (400, [1.0] * 6, None), (500, [1.0, None, 1.0], 1), (500, [float("nan")] * 6, 1),
             (500, [float("inf")] + [1.0] * 5, 1), (600, [1.0] * 6, 9), (700, [], 1), (700, [1.5, 2.0], 2),
             (800, [0.0] * 6, 1), (900, [-1.0] * 6, 2), (300, [2.0] * 6, 1)]
    return rows + [(1000 + k, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0], k % 2) for k in range(80)]


@pytest.mark.parametrize("group_bytes, block, anchors", [(4 << 20, 4096, 256), (48 * 4, 7, 3)])
def test_hard_negatives(spark, monkeypatch, group_bytes, block, anchors):
    monkeypatch.setattr(hard_negatives, "GROUP_BYTES", group_bytes)
    rows = vector_rows()
    df = spark.createDataFrame(
        [(i, v, label, "x", 1) for i, v, label in rows],
        "vec_id bigint, embedding array<double>, label int, score string, row int").repartition(3)
    if block == 7:  # blocks are cut in the workers, so the small sizes are tried on the function itself
        monkeypatch.setattr(hard_negatives, "ROWS", block)
        monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
        in_blocks()
    got = mine_hard_negatives(df, F.col("vec_id") % 100 == 0)
    want = brute_negatives(rows, lambda i: i % 100 == 0)
    # rows with one id and one score may stand in either order
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) > 100


def in_blocks():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    n, width = 100, 4
    vectors, label = rng.integers(-4, 5, (n, width)).astype(float), rng.integers(0, 3, n)
    given = {"place": np.arange(10), "row": np.arange(10), "label": label[:10], "vectors": vectors[:10]}
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array(label), pa.array(vectors.tolist())],
        ["row", "vec_id", "label", "vector"])
    parts = hard_negatives._scored(given, width, 5, None, (80, 100))([batch.slice(0, 60), batch.slice(60)])
    found = sorted(map(tuple, pa.Table.from_batches(parts).to_pandas()[["anchor", "score", "vec_id"]].to_numpy().tolist()))
    want = []
    for a in range(10):
        same = [(-int(vectors[a] @ vectors[j]), j) for j in range(n) if j != a and label[j] == label[a]]
        want += [(a, -s, j) for s, j in sorted(same)[:5]]
    assert found == sorted(want)


def test_hard_negatives_of_nothing(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [], 1), (1, [], 1)], [(None, [1.0], 1)]):
        assert mine_hard_negatives(spark.createDataFrame(rows, kind), F.col("vec_id") % 100 == 0).collect() == []


def test_scores_beyond_exact_numbers_are_an_error(spark):
    rows = spark.createDataFrame([(100, [1e30], 1), (1, [1e30], 1)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large for exact scores"):
        mine_hard_negatives(rows, F.col("vec_id") % 100 == 0).collect()
