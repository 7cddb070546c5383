"""The registered query of each operator, over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.decontamination import contamination
from cadence.llm.fingerprints import fingerprint, likeness
from cadence.llm.hard_negatives import mine_hard_negatives
from cadence.llm.language_id import held_out, identify
from cadence.llm.line_dedup import dedup_lines
from cadence.llm.neighbours import map_with_next
from cadence.llm.packing import pack
from cadence.llm.periodic_runs import collapse_runs
from cadence.llm.simhash import hex_digits, near_duplicate_groups
from cadence.llm.storage import shared_folder
from cadence.llm.token_counts import context_totals, length_histogram
from cadence.llm.token_files import read_token_files, write_token_files
from cadence.llm.tool_calls import link_tool_calls
from cadence.llm.toxicity import score_toxicity
from cadence.llm.warc import mark_revisits, page_number, page_urn, read_warc, write_warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _edited_half(pairs: Iterator[tuple[tuple, tuple]]) -> Iterator[tuple]:
    """Fingerprint each text, its text with a half from the next document, and compare."""
    known: tuple[str, str] | None = None  # the next text was fingerprinted a step before
    for (doc_id, text), (_, following) in pairs:
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own = known[1] if known and known[0] == text else fingerprint(text)
        known = (following, fingerprint(following))
        changed = own if edited == text else fingerprint(edited)
        yield (
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed,
            likeness(own, changed), likeness(own, known[1]),
        )


@query()
def op1_phrase_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return map_with_next(
        docs, "doc_id", _edited_half,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


@query(r"""
    WITH doc_words AS (
      SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
    item_words AS (
      SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
    item_windows AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS n,
        array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k
            FROM item_words WHERE len(w) > 0)),
    doc_windows AS (
      SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k
            FROM doc_words, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
    hits AS (SELECT r, k, d.n, item_id FROM doc_windows d JOIN item_windows i USING (win)),
    words_hit AS (
      SELECT r, count(DISTINCT p) AS n_hit
      FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
    items_hit AS (
      SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ','
        ORDER BY item_id::VARCHAR) AS ids
      FROM hits GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
      coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc_words LEFT JOIN words_hit USING (r) LEFT JOIN items_hit USING (r)
""")
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(
        table(spark, folder, "documents").select("doc_id", "text"),
        table(spark, folder, "benchmark"),
    )
    ids = F.array_sort(F.transform("found.items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


@query()
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return context_totals(length_histogram(table(spark, folder, "documents"), TOKENIZER))


TOOLS = {
    "search": {"query": "string", "limit": "integer"},
    "summarize": {"text": "string", "words": "integer"},
    "translate": {"text": "string", "target": "string"},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off a conversation: an assistant's turn is a call, the user's
    turn after it the result.  The text's length decides the tool and what is wrong with it."""
    length, text = F.length("text"), F.col("text")

    def call_id(turn):
        return F.concat_ws("-", F.lit("call"), "conv_id", turn)

    search = F.to_json(F.struct(
        F.when(length % 7 == 0, F.to_json(F.array(text))).otherwise(text).alias("query"),
        F.when(length % 7 != 0, length % 50).alias("limit"),
    ))
    translate = F.to_json(F.struct(
        text.alias("text"), F.when(length % 5 != 0, F.lit("de")).alias("target"),
    ))
    summarize = F.to_json(F.struct(
        (length % 100).alias("words"), text.alias("text"),
        F.when(length % 11 == 0, F.lit("short")).alias("style"),
    ))
    kind = length % 3
    calls = turns.where("role = 'assistant'").select(
        "conv_id", call_id(F.col("turn")).alias("call_id"), "turn",
        F.when(kind == 0, "search").when(kind == 1, "translate").otherwise("summarize")
        .alias("tool"),
        F.when(kind == 0, search).when(kind == 1, translate).otherwise(summarize)
        .alias("arguments"),
        F.when(F.col("turn") > 1, F.array(call_id(F.floor(F.col("turn") / 2))))
        .alias("after"),
    )
    results = turns.where("role = 'user' AND turn > 0").select(
        "conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", text.alias("content")
    )
    return calls, results


@query(r"""
    WITH RECURSIVE first_calls AS (
      SELECT conv_id, turn, min(text) AS text FROM conversations
      WHERE role = 'assistant' GROUP BY conv_id, turn),
    calls AS (
      SELECT conv_id, turn, text, length(text) AS n, length(text) % 3 AS kind,
        'call-' || conv_id || '-' || turn AS call_id,
        CASE WHEN turn > 1 THEN turn // 2 END AS parent
      FROM first_calls),
    levels AS (
      SELECT conv_id, turn, 0 AS level FROM calls c
      WHERE parent IS NULL OR NOT EXISTS (
        SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.parent)
      UNION ALL
      SELECT c.conv_id, c.turn, level + 1 FROM levels l
      JOIN calls c ON c.conv_id = l.conv_id AND c.parent = l.turn),
    answers AS (
      SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, min(text) AS content,
        count(*) AS n_results
      FROM conversations WHERE role = 'user' AND turn > 0 GROUP BY conv_id, turn),
    checked AS (
      SELECT c.*, level, CASE kind WHEN 0 THEN 'search' WHEN 1 THEN 'translate'
          ELSE 'summarize' END AS tool,
        CASE WHEN kind = 0 AND n % 7 = 0 THEN ['missing limit']
          WHEN kind = 1 AND n % 5 = 0 THEN ['missing target']
          WHEN kind = 2 AND n % 11 = 0 THEN ['unexpected style'] ELSE [] END
        || CASE WHEN parent IS NOT NULL AND level = 0
          THEN ['unknown call call-' || conv_id || '-' || parent] ELSE [] END AS errors,
        CASE WHEN kind = 0 AND n % 7 = 0
            THEN '{"query":' || to_json(to_json([text])::VARCHAR) || '}'
          WHEN kind = 0 THEN '{"limit":' || (n % 50) || ',"query":' || to_json(text) || '}'
          WHEN kind = 1 THEN '{' || CASE WHEN n % 5 <> 0 THEN '"target":"de",' ELSE '' END
            || '"text":' || to_json(text) || '}'
          ELSE '{' || CASE WHEN n % 11 = 0 THEN '"style":"short",' ELSE '' END
            || '"text":' || to_json(text) || ',"words":' || (n % 100) || '}' END AS arguments
      FROM calls c JOIN levels USING (conv_id, turn))
    SELECT conv_id, call_id,
      CASE WHEN tool IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'unanswered'
        ELSE 'linked' END AS status,
      level, tool,
      CASE WHEN tool IS NULL THEN 'no call' ELSE array_to_string(errors, '; ') END AS errors,
      tool IS NOT NULL AND len(errors) = 0 AS valid, coalesce(n_results, 0) AS n_results,
      '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || to_json(call_id)
        || ',"name":' || coalesce(to_json(tool)::VARCHAR, 'null')
        || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS message
    FROM checked FULL JOIN answers USING (conv_id, call_id)
""")
def op4_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    calls, results = conversation_calls(table(spark, folder, "conversations"))
    linked = link_tool_calls(calls, results, TOOLS)
    return linked.withColumn("errors", F.array_join("errors", "; "))


@query()
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    out = held_out("doc_id", 4, 2)
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return identify(docs, ~out).select(
        "doc_id", out.alias("held_out"), "language.lang_pred", "language.score"
    )


@query()
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, folder, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), hex_digits(F.col("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query(r"""
    WITH p AS (
      SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    f AS (SELECT payload, min(page_id) AS first_id FROM p GROUP BY payload),
    b AS (
      SELECT page_id, payload, first_id,
        sha1(payload) AS hex
      FROM p JOIN f USING (payload)),
    bits AS (
      SELECT page_id, payload, first_id, array_to_string([
        lpad(bin(instr('0123456789abcdef', substr(hex, k + 1, 1)) - 1), 4, '0')
        for k in range(0, 40)], '') AS bit
      FROM b)
    SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
      array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
        + 16 * substr(bit, 5 * k + 1, 1)::INT + 8 * substr(bit, 5 * k + 2, 1)::INT
        + 4 * substr(bit, 5 * k + 3, 1)::INT + 2 * substr(bit, 5 * k + 4, 1)::INT
        + substr(bit, 5 * k + 5, 1)::INT, 1) for k in range(0, 32)], '') AS payload_digest,
      CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM bits
""")
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    pages = mark_revisits(table(spark, folder, "pages"), "page_id", "html", least_bytes=0)
    write_warc(
        pages.select(
            page_urn(F.col("page_id")).alias("record_id"), "record_type",
            F.col("url").alias("target_uri"),
            F.when(F.col("record_type") == "revisit", page_urn(F.col("refers_to")))
            .alias("refers_to"),
            F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
        ), path,
    )
    responses = read_warc(spark, path).where("record_type = 'response'")
    revisits = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return responses.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).drop(
        "payload"
    ).unionByName(revisits.drop("payload")).select(
        page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", page_number(F.col("refers_to")).alias("refers_to"),
    )


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    out = held_out("doc_id", 3, 1)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, folder, "labels"), ~out, "score")
    return scored.select(
        "doc_id", out.alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query()
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents"), TOKENIZER, capacity=2048, end_id=0)
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "sequence_id", "offset",
    )


@query()
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    write_token_files(table(spark, folder, "documents"), path, TOKENIZER, end_id=2)
    return read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query(r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l
      FROM documents),
    x AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS k FROM d),
    y AS (
      SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM x),
    g AS (
      SELECT key, max(doc_id) AS last FROM y WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT r) >= 3),
    z AS (SELECT y.*, coalesce(last > doc_id, false) AS gone FROM y LEFT JOIN g USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
    FROM z GROUP BY r, doc_id
""")
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = dedup_lines(docs, least_chars=20, least_documents=3)
    return kept.select(
        "doc_id", "lines.n_lines", "lines.n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Every tenth text, by its id's hash, with its tail replaced by repeats of the tail's head."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def edited(words):
        n = F.size(words)
        a = (g % n).cast("int")
        left = n - a
        p = 1 + F.floor(left / (3 + g % 8)).cast("int")
        head, unit = F.slice(words, 1, a), F.slice(words, a + 1, p)
        tail = F.flatten(F.array_repeat(unit, F.ceil(left / p).cast("int")))
        return F.when(n == 0, F.lit("")).otherwise(
            F.array_join(F.concat(head, F.slice(tail, 1, left)), " "))

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = F.transform(F.array(words), edited)[0]  # one evaluation of the words
    return docs.withColumn("text", F.when(h % 10 == 0, chosen).otherwise(F.col("text")))


@query()
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_periodic_tails(table(spark, folder, "documents").select("doc_id", "text"))
    found = collapse_runs(docs, least_length=6, power=4).select("doc_id", "periodic.*")

    def greater(best, run):
        one, other = run["length"] * best["period"], best["length"] * run["period"]
        return best.isNull() | (one > other)  # runs come by start and period, so ties stay

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(greater(b, r), r).otherwise(b))
    line = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


@query(r"""
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id,
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same,
        list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT * FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id,
      (row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id, s.br))::INT AS rank,
      s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.ar = s.ar AND NOT s.same
      AND 80 * p.score <= 100 * s.score AND s.score <= p.score
    QUALIFY row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id, s.br) <= 5
""")
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table(spark, folder, "embeddings").where(finite).select(
        "vec_id", whole.alias("embedding"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
    )
    return mine_hard_negatives(
        rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, ratio=(80, 100))
