"""Near-duplicates by SimHash and multi-index hashing.

:func:`near_duplicate_groups` links 64-bit fingerprints at up to 4 differing bits, exactly.
:func:`similar_groups` links texts at a similarity of shingle sets, which takes more differing
bits than any guarantee could enumerate; pairs that share one of their rarer shingles are
candidates, and each link is verified on the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.llm.components import connected_components
from cadence.llm.encoding import forget_words
from cadence.runtime import quoted, remove, stage, staging_path

BITS, SEED, DISTANCE = 64, 42, 4
SEGMENT_BITS = 32
"""Two segments: within distance 4, one of them differs in at most 2 bits."""
CROWD = 1024
"""Buckets with more fingerprints are linked by whole-fingerprint balls, not pair by pair."""

WIDE_WORDS = 3
"""64-bit words of the longer fingerprint."""
FREQUENT_ROWS, FREQUENT = 5_000, 200_000
"""Rows that are looked through for frequent shingles, and how many of those are kept at most.
They only decide in which order shingles are entered, hence how large buckets are."""
STAR_KEYS = 8
"""Keys of a node by which representatives are found."""
BLOCK = 4096
"""Entries of a bucket that meet in one place; larger buckets are dealt into blocks."""
SMALL = 32
"""Sets with fewer shingles are not told apart by fingerprints."""
PARTNERS = 256
"""Texts that one sent text is compared with."""
BROADCAST_NODES = 250_000
"""Nodes whose texts are fetched by a table that every executor gets."""
NEAREST = 8
"""Pairs of a node that are tested in the first round over whole buckets; each next takes four times as many."""
LEAST_LINKED = 20
"""Representatives are tried again while they link more than one node in so many."""
# additive constants that give one hash several independent words (fixed values)
_WORD_SALTS = (0x0, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, words_per_shingle: int) -> np.ndarray:
    """XXH64 of each run of words; the whole sequence, if shorter; none without words."""
    words = text.translate(_LOWER).split()  # bytes split at the six ASCII white-space characters
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    spans = zip(starts.tolist(), (ends[words_per_shingle - 1:] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def simhash(text: bytes | None, words_per_shingle: int) -> int:
    """Bit k is 1 if it is set in over half of the shingles' hashes; 0 for no words."""
    hashes = shingle_hashes(text or b"", words_per_shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(
            hashes[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8),
            axis=1, bitorder="little",
        )
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash_column(text: Column, words_per_shingle: int = 4) -> Column:
    """The fingerprint of a text column as a signed 64-bit integer."""

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        forget_words()
        found = [simhash(t.as_py(), words_per_shingle) for t in texts]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return prints(text.cast("binary"))


def hex_digits(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _ball_masks(bits: int, radius: int) -> np.ndarray:
    """Differences of at most ``radius`` bits among ``bits``."""
    single = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    masks = np.zeros(1, np.uint64)
    for _ in range(radius):
        masks = np.unique(np.concatenate([masks, (masks[:, None] ^ single[None, :]).ravel()]))
    # masks of one and the same size arise again through repeated bits; all stay within radius
    return masks[np.bitwise_count(masks) <= radius]


def _segment_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints to the tables' keys: for each segment, the values within one bit of it."""
    masks = _ball_masks(SEGMENT_BITS, 1)
    low = np.uint64((1 << SEGMENT_BITS) - 1)
    for batch in batches:
        whole = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(whole), 4096):
            prints = whole[at:at + 4096]
            for segment in (0, 1):
                values = (prints >> np.uint64(SEGMENT_BITS * segment)) & low
                keys = (values[:, None] ^ masks[None, :]).ravel() | np.uint64(segment << 32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.view(np.int64)),
                    pa.array(np.repeat(prints, len(masks)).view(np.int64)),
                ], ["key", "fp"])


def _ball_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints to all values within half the distance of them."""
    masks = _ball_masks(BITS, DISTANCE // 2)
    for batch in batches:
        whole = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(whole), 64):
            prints = whole[at:at + 64]
            keys = (prints[:, None] ^ masks[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([
                pa.array(keys.view(np.int64)),
                pa.array(np.repeat(prints, len(masks)).view(np.int64)),
            ], ["key", "fp"])


def _forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within one bucket, one fewer than its members."""
    left, a, b = np.unique(prints), [], []
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            node, reached = reached[0], reached[1:]
            near = np.bitwise_count(left ^ node) <= DISTANCE
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), node))
                b.append(found)
                reached = np.concatenate([reached, found])
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, fp) in order of the key to links within the distance."""

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.append(0, edges), np.append(edges, len(keys))
        two = ends - starts == 2
        a, b = [prints[starts[two]]], [prints[starts[two] + 1]]
        near = np.bitwise_count(a[0] ^ b[0]) <= DISTANCE
        a, b = [a[0][near]], [b[0][near]]
        for start, end in zip(starts[~two].tolist(), ends[~two].tolist()):
            one, other = _forest(prints[start:end])
            a.append(one)
            b.append(other)
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, k].astype(np.uint64).view(np.int64)) for k in (0, 1)], ["a", "b"]
        )

    kept_keys, kept = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([kept_keys, batch.column(0).to_numpy()])
        prints = np.concatenate([kept, batch.column(1).to_numpy().view(np.uint64)])
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if last:
            yield links(keys[:last], prints[:last])
        kept_keys, kept = keys[last:], prints[last:]
    if len(kept):
        yield links(kept_keys, kept)


def similar_links(prints: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints (distinct ``fp``) within the distance.

    Two fingerprints that differ in at most 4 bits differ in at most 2 within one of their
    segments, so some value lies within one bit of both segments: each fingerprint is entered
    under the 33 values of each segment's ball, and those under one key are compared.  Keys
    with one entry are dropped by a count.  A bucket above ``CROWD`` is not compared pair by
    pair: its members are entered under the 2,081 values within two bits of the whole
    fingerprint, where a common key alone proves a distance of at most 4, and each is linked
    with the smallest member of each key.  Both ways are exact; the second grows with the
    members, not with their pairs.
    """
    entries = prints.select("fp").mapInArrow(_segment_keys, "key bigint, fp bigint")
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # planned sizes do not see how many entries a fingerprint makes; neither side may be broadcast
    shared = stage(entries.join(sizes.hint("merge"), "key"), "buckets")
    compared = (
        shared.where(F.col("n") <= CROWD).select("key", "fp")
        .repartition("key").sortWithinPartitions("key")
        .mapInArrow(_verified, "a bigint, b bigint")
    )
    crowded = shared.where(F.col("n") > CROWD).select("fp").distinct()
    balls = crowded.mapInArrow(_ball_keys, "key bigint, fp bigint")
    smallest = balls.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("n"))
    star = balls.join(smallest.where("n > 1").hint("merge"), "key").where("fp <> b").select(
        F.col("fp").alias("a"), "b"
    )
    return compared.unionByName(star.distinct())


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4
) -> DataFrame:
    """``id, fp, component``: each row's fingerprint and the smallest id reachable by links.

    Every row is returned once per row; repeated rows and equal texts share a fingerprint and
    hence a component.  Null and empty texts, and texts of white space, have fingerprint 0 and
    link like others.  A null id gets its component but is never one, unless all ids there are
    null.  Equal fingerprints are one node, so a group of copies of any size adds one entry.
    """
    marked = stage(
        docs.select(F.col(id_col).alias("id"),
                    simhash_column(F.col(text_col), words_per_shingle).alias("fp")),
        "fingerprints",
    )
    prints = stage(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    return _grouped(marked, prints, similar_links(prints))


def _grouped(marked: DataFrame, prints: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the smallest id of their fingerprint's component."""
    found = stage(connected_components(links), "components")
    nodes = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root")
    )
    roots = nodes.groupBy("root").agg(F.min("first_id").alias("component"))
    return marked.join(nodes.join(roots, "root").select("fp", "component"), "fp").select(
        "id", "fp", "component"
    )


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The longer fingerprint of a set of hashes."""
    ones = np.zeros(BITS * WIDE_WORDS, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at:at + (1 << 12)]
        words = np.empty((len(part), WIDE_WORDS), "<u8")
        for k, salt in enumerate(_WORD_SALTS):
            mixed = (part + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
            words[:, k] = part if not k else mixed ^ (mixed >> np.uint64(29))
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def wide_distance(similarity: float) -> int:
    """Differing bits expected of two shingle sets with this Jaccard similarity, and six standard
    deviations more: about one such pair in a billion differs in more."""
    bits, share = BITS * WIDE_WORDS, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + 6 * math.sqrt(bits * share * (1 - share)))


def prefix_keys(hashes: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a set, in an order that holds for all sets: frequent ones come last.

    Two sets of the similarity share at least ``ceil(similarity * n)`` of the ``n`` hashes of
    either, so they share one of the first ``n - ceil(similarity * n) + 1``.  ``frequent`` is
    sorted; ``ranks`` has the place of each in the order.
    """
    place = np.zeros(len(hashes), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        place = np.where(frequent[at] == hashes, ranks[at] + 1, 0)
    length = len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1
    return hashes[np.lexsort((hashes, place))[:length]]


def frequent_shingles(texts: DataFrame, words_per_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that recur in some of the texts, and their ranks by frequency."""

    @F.arrow_udf("array<bigint>")
    def hashes_of(texts: pa.Array) -> pa.Array:
        found = [np.unique(shingle_hashes(t.as_py() or b"", words_per_shingle)) for t in texts]
        return pa.array([f.view(np.int64).tolist() for f in found], pa.list_(pa.int64()))

    every = max(1, texts.count() // FREQUENT_ROWS)
    counts = (
        texts.where(F.pmod(F.xxhash64("print"), F.lit(every)) == 0)
        .select(F.explode(hashes_of("text")).alias("h")).groupBy("h").count().where("count >= 4")
        .orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas()
    )
    hashes = counts["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - np.arange(len(hashes)))[order]


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of hashes (sorted, distinct) have this Jaccard similarity."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= 1 and shared / (len(a) + len(b) - shared) >= similarity


class _Scratch:
    """Staged tables of a run by label; a new one under a label drops the one before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, label: str) -> DataFrame:
        path = staging_path(self.spark, label)
        df.write.parquet(path)
        self.drop(label)
        self.paths[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            if label in self.paths:
                remove(self.spark, self.paths.pop(label))


class _Candidates:
    """Pairs of distinct shingle sets that share a key and are near by fingerprint and size.

    All steps are Spark joins and combined aggregates.  ``prints`` has a row per shingle set that
    shares a key with another: ``node, words, size, keys``, the keys being those that are shared.
    ``distance`` None lets fingerprints decide nothing.
    """

    def __init__(self, prints: DataFrame, distance: int | None, similarity: float, scratch: _Scratch):
        self.prints, self.distance, self.similarity, self.scratch = prints, distance, similarity, scratch
        self.shape = prints.select("node", "words", "size")

    def _near(self, x: str, y: str) -> Column:
        size_x, size_y = F.col(f"{x}.size"), F.col(f"{y}.size")
        # a similarity is never above the sizes' ratio
        less, more = F.least(size_x, size_y), F.greatest(size_x, size_y)
        near = less / more >= self.similarity
        if self.distance is None:
            return near
        # the spread holds for many shingles
        return near & ((less < SMALL) | (self._bits(x, y) <= self.distance))

    @staticmethod
    def _bits(x: str, y: str) -> Column:
        return sum(
            F.bit_count(F.col(f"{x}.words")[k].bitwiseXOR(F.col(f"{y}.words")[k]))
            for k in range(WIDE_WORDS)
        )

    def _buckets(
        self, labels: DataFrame, keys: Column, turn: int, only: DataFrame | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """Entries, and per key with several labels its size, its commonest label and one node of it.

        ``only`` leaves out the keys that it does not have.
        """
        entries = (
            self.prints.select("node", keys.alias("keys")).join(labels, "node", "left")
            .select(F.explode("keys").alias("key"), "node", F.coalesce("label", "node").alias("label"))
        )
        if only is not None:
            entries = entries.join(only, "key", "left_semi")
        counts = entries.groupBy("key", "label").agg(
            F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("m")
        )
        mains = counts.groupBy("key").agg(
            F.max(F.struct("n", "label", "m")).alias("main"), F.sum("n").alias("n"),
            F.count("*").alias("labels"),
        ).where("labels > 1").select(
            "key", "n", F.col("main.label").alias("main"), F.col("main.m.node").alias("b")
        )
        return entries, mains

    def nearest_stars(self, labels: DataFrame, turn: int) -> DataFrame:
        """``a, b``: each node and the nearest of its buckets' representatives."""
        drawn = F.transform("keys", lambda k: F.struct(F.xxhash64(k, F.lit(turn)).alias("by"), k.alias("k")))
        own = F.slice(F.sort_array(drawn), 1, STAR_KEYS)["k"]  # near copies draw much the same
        entries, mains = self._buckets(labels, own, turn)
        pairs = (
            entries.join(mains, "key").where("label <> main")
            .select(F.col("node").alias("a"), "b").distinct()
        )
        x = self.shape.select(F.col("node").alias("a"), F.struct("words", "size").alias("x"))
        y = self.shape.select(F.col("node").alias("b"), F.struct("words", "size").alias("y"))
        return (
            pairs.join(x, "a").join(y, "b").where(self._near("x", "y"))
            .groupBy("a").agg(F.min(F.struct(self._bits("x", "y"), "b")).alias("m"))
            .select("a", "m.b")
        )

    @staticmethod
    def _dealt(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entries of other labels than their bucket's commonest, once for each block of the
        bucket, and all entries in blocks of about ``BLOCK``, which a join may have to hold."""
        blocks = F.ceil(F.col("n") / BLOCK)
        others = shared.where("label <> main").withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        return others, shared.withColumn("block", F.pmod(F.xxhash64("node"), blocks))

    def keys_of(self, nodes: DataFrame) -> DataFrame:
        """``key``: the keys of these nodes, once each, ready for a join."""
        own = self.prints.join(nodes, "node", "left_semi")
        keys = self.scratch.put(own.select(F.explode("keys").alias("key")).distinct(), "keys")
        return F.broadcast(keys) if keys.count() <= BROADCAST_NODES else keys

    def between_labels(self, labels: DataFrame, unfinished: DataFrame | None = None) -> DataFrame:
        """``a, b, bits``: all pairs of nodes with different labels, where ``a`` has
        another than its bucket's commonest; a pair without such a node has one label.

        ``unfinished`` has the nodes that some pair not tested so far is of; buckets without any
        of them are left out.
        """
        only = None if unfinished is None else self.keys_of(unfinished)
        entries, mains = self._buckets(labels, F.col("keys"), 0, only)
        shared = self.scratch.put(
            entries.join(mains.drop("b"), "key").join(self.shape, "node"), "buckets"
        )
        others, members = self._dealt(shared)
        same_block = F.expr("x.key = y.key and x.block = y.block and x.label <> y.label")
        return (
            others.alias("x").join(members.alias("y"), same_block & self._near("x", "y"))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"),
                    self._bits("x", "y").alias("bits"))
            .distinct()
        )


def _compared(words_per_shingle: int, similarity: float):
    """Batches of (b, block, a, text), the text of ``b`` itself before those of its partners, to
    the pairs that have the similarity."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        own, one = None, None
        for batch in batches:
            b, block, a = (batch.column(k).to_pylist() for k in range(3))
            found = []
            for k, text in enumerate(batch.column(3)):
                hashes = np.unique(shingle_hashes(text.as_py() or b"", words_per_shingle))
                if a[k] is None:
                    own, one = hashes, (b[k], block[k])
                elif one != (b[k], block[k]):
                    raise RuntimeError(f"no text came before the partners of {b[k]}")
                elif alike(own, hashes, similarity):
                    found.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[k] for k in found], pa.int64()) for c in (a, b)], ["a", "b"])

    return compared


def _verified_pairs(
    pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words_per_shingle: int, similarity: float
) -> DataFrame:
    """The pairs ``a, b`` of nodes whose texts have the similarity.

    ``nodes`` gives each node's text by its ``print`` in ``texts``.  The text of ``b`` is sent
    once for up to ``PARTNERS`` of its partners, which meet it in one place.
    """
    blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).alias("blocks"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = nodes.select("node", "print").join(ends, "node", "left_semi")
    if needed.count() <= BROADCAST_NODES:
        needed = F.broadcast(needed)  # 24 bytes each; else both sides are shuffled
    own = texts.join(needed, "print").groupBy("node").agg(F.any_value("text").alias("text"))
    groups = blocks.join(own, F.col("b") == F.col("node")).select(
        "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
        F.lit(None).cast("bigint").alias("a"), "text")
    partners = (
        pairs.join(blocks, "b").join(own, F.col("a") == F.col("node"))
        .select("b", F.pmod(F.xxhash64("a"), "blocks").alias("block"), "a", "text")
    )
    return (
        groups.unionByName(partners).repartition("b", "block")
        .sortWithinPartitions("b", "block", F.col("a").isNotNull())
        .mapInArrow(_compared(words_per_shingle, similarity), "a bigint, b bigint")
    )


def _joined_labels(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (node, label) with the labels that the links ``found`` connect made one."""
    ends = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    new = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    every = labels.unionByName(new)
    x = every.select(F.col("node").alias("a"), F.col("label").alias("x"))
    y = every.select(F.col("node").alias("b"), F.col("label").alias("y"))
    links = found.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = connected_components(links).withColumnRenamed("node", "label")
    return every.join(roots, "label", "left").select(
        "node", F.coalesce("component", "label").alias("label"))


def text_print(text: Column) -> Column:
    """16 bytes that tell texts apart; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5,
    similarity: float = 0.8, fingerprints_decide: bool = True,
) -> DataFrame:
    """``id, fp, component`` as :func:`near_duplicate_groups`, for a similarity of shingle sets.

    Texts with one shingle set are a node, ``fp`` its digest.  Each is entered under the first
    fifth (at 0.8) of its shingles in one order, the frequent last, where any two sets of the
    similarity meet.  Shingles that no other node is entered under are dropped before anything
    else is done.  Pairs that share a key and are near by size and by fingerprints of 192 bits
    are candidates (``fingerprints_decide=False`` leaves the fingerprints out, and is exact).  A
    pair is linked if the shingle sets of its two texts have the Jaccard similarity, and only then.

    First each node is tested against the nearest representative of its buckets, as long as
    that links many; a crowd of near copies costs about its size.  Then all pairs of a bucket
    that no link connects yet are tested, those nearest by fingerprint first.  Texts without
    words form a group.  ``docs`` is read several times and should be a stored table; texts are
    found again by their prints, so rows that repeat an id or lack one need no number.
    """
    kind = pa.struct([("fp", pa.binary()), ("words", pa.list_(pa.int64())), ("size", pa.int32()),
                      ("keys", pa.list_(pa.int64()))])

    def described(text: bytes | None) -> dict:
        hashes = np.unique(shingle_hashes(text or b"", words_per_shingle))
        keys = prefix_keys(hashes, frequent, ranks, similarity) if len(hashes) else hashes
        return {"fp": xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes()),
                "words": np.frombuffer(wide_fingerprint(hashes), "<i8").tolist(),
                "size": len(hashes), "keys": keys.view(np.int64).tolist()}

    @F.arrow_udf("struct<fp:binary,words:array<bigint>,size:int,keys:array<bigint>>")
    def prints_of(texts: pa.Array) -> pa.Array:
        forget_words()
        return pa.array([described(t.as_py()) for t in texts], kind)

    spark = docs.sparkSession
    scratch = _Scratch(spark)
    text = F.col(quoted(text_col))
    texts = docs.select(text_print(text).alias("print"), text.cast("binary").alias("text"))
    frequent, ranks = frequent_shingles(texts, words_per_shingle)
    marked = scratch.put(
        docs.select(F.col(quoted(id_col)).alias("id"), text_print(text).alias("print"),
                    prints_of(text.cast("binary")).alias("p")).select("id", "print", "p.*"),
        "marked")
    members = scratch.put(marked.select("id", "fp"), "members")
    prints = scratch.put(
        marked.groupBy("fp").agg(
            F.min("id").alias("first_id"), F.min("print").alias("print"),
            F.any_value(F.struct("words", "size", "keys")).alias("p"),
        ).select(F.monotonically_increasing_id().alias("node"), "fp", "first_id", "print", "p.*"),
        "prints",
    )
    scratch.drop("marked")
    nodes = scratch.put(prints.select("node", "fp", "first_id", "print"), "nodes")
    entries = prints.select(F.explode("keys").alias("key"), "node")
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    own_shared = entries.join(shared, "key").groupBy("node").agg(F.collect_list("key").alias("keys"))
    meeting = scratch.put(
        prints.select("node", "words", "size").join(own_shared, "node"), "meeting")
    scratch.drop("prints")

    total = nodes.count()
    labels = spark.createDataFrame([], "node bigint, label bigint")
    distance = wide_distance(similarity) if fingerprints_decide else None
    proposed = _Candidates(meeting, distance, similarity, scratch)

    def test(pairs: DataFrame) -> int:
        nonlocal labels
        found = scratch.put(_verified_pairs(pairs, nodes, texts, words_per_shingle, similarity), "similar")
        passed = found.count()
        if passed:
            labels = scratch.put(_joined_labels(labels, found), "labels")
        return passed

    turn = 0
    while test(scratch.put(proposed.nearest_stars(labels, turn), "stars")) * LEAST_LINKED > total:
        turn += 1
    tested, nearest, unfinished = spark.createDataFrame([], "a bigint, b bigint"), NEAREST, None
    while True:
        rank = F.row_number().over(Window.partitionBy("a").orderBy("bits", "b"))
        pairs = proposed.between_labels(labels, unfinished).select(
            F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "*"
        ).join(tested.select(F.col("a").alias("low"), F.col("b").alias("high")),
               ["low", "high"], "left_anti")
        pairs = scratch.put(pairs.withColumn("rank", rank).where(F.col("rank") <= nearest + 1), "pairs")
        now = scratch.put(pairs.where(F.col("rank") <= nearest).select(
            F.col("low").alias("a"), F.col("high").alias("b")).distinct(), f"tested-{nearest}")
        scratch.drop("buckets")
        test(now)
        # labels only merge, so a pair left for later was proposed now, from a node with more pairs
        unfinished = scratch.put(
            pairs.where(F.col("rank") > nearest).select(F.col("a").alias("node")).distinct(), "unfinished")
        if unfinished.isEmpty():
            break
        tested, nearest = tested.union(now), nearest * 4
    rooted = nodes.join(labels, "node", "left").select(
        "fp", "first_id", F.coalesce("label", "node").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    return members.join(
        rooted.join(roots, "root").select("fp", "component"), "fp"
    ).select("id", "fp", "component")
