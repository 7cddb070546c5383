"""Periodic runs of words, by branching tandem repeats in an enhanced suffix array.

Texts are handled in groups of some 100,000 words.  A group's suffixes are sorted by prefix
doubling within their texts; the neighbours' common prefixes give the intervals of suffixes
that share a prefix.  In an interval of depth ``d``, each suffix ``i`` of all children but the
largest is asked, by its inverse array alone, whether ``i + d`` or ``i - d`` lies in another
child: then a square of period ``d`` ends where its period does.  Squares are rotated to the
left as far as they go and merged into runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.runtime import quoted

GROUP_BYTES = 1 << 20
"""Bytes of text whose suffixes are sorted together; a longer text is a group of its own."""
EXPANDED = 1 << 20
"""Suffixes of smaller children that are asked at a time."""

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("text", pa.string())])
RESULT_SQL = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,text:string>"


@dataclass
class SuffixArray:
    """``order`` lists the suffixes, sorted within their texts; ``ranks[r]`` numbers each position
    by its first ``2**r`` words, equal numbers meaning equal words inside one text."""

    order: np.ndarray
    ranks: list[np.ndarray]
    begin: np.ndarray  # of the text of each position
    end: np.ndarray

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, inside one text."""
        a, b, length, last = a.copy(), b.copy(), np.zeros(len(a), np.int64), len(self.order) - 1
        end_a, end_b = self.end[a], self.end[b]
        for r in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[r]
            same = (a < end_a) & (b < end_b)
            same &= rank[np.minimum(a, last)] == rank[np.minimum(b, last)]
            step = same * (1 << r)
            a += step
            b += step
            length += step
        return length

    def shared_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words right before ``a`` and ``b``, with ``a < b`` in one text."""
        least, length = self.begin[a], np.zeros(len(a), np.int64)
        a, b = a.copy(), b.copy()
        for r in range(len(self.ranks) - 1, -1, -1):
            rank, size = self.ranks[r], 1 << r
            same = a - size >= least
            same &= rank[np.maximum(a - size, 0)] == rank[np.maximum(b - size, 0)]
            step = same * size
            a -= step
            b -= step
            length += step
        return length


def suffix_array(words: np.ndarray, sizes: np.ndarray) -> SuffixArray:
    """Sort the suffixes of each text; ``words`` are numbers, ``sizes`` the texts' lengths.

    Prefix doubling: a round sorts by twice as many words, and only what is still equal to
    another suffix of its text.
    """
    n, ends = len(words), np.cumsum(sizes)
    end, begin = np.repeat(ends, sizes), np.repeat(ends - sizes, sizes)
    key = begin * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key)
    key, i, open_ = key[order], order, np.arange(n)  # suffixes i fill the places open_ by key
    rank, ranks, h = np.empty(n, np.int32), [], 1
    while True:
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        lengths = np.diff(np.append(starts, len(i)))
        rank[i] = np.repeat(open_[starts], lengths)
        ranks.append(rank.copy())
        several = np.repeat(lengths > 1, lengths)
        open_, i = open_[several], i[several]
        if not len(open_):
            return SuffixArray(order, ranks, begin, end)
        inside = i + h < end[i]
        second = np.where(inside, rank[np.where(inside, i + h, 0)], -1).astype(np.int64)
        key = rank[i].astype(np.int64) * (n + 1) + second + 1
        turn = np.argsort(key)
        i, key, h = i[turn], key[turn], 2 * h
        order[open_] = i


def _smaller_to_the_sides(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the nearest places before and after it with a smaller number; the first and
    last number are 0, and places that hold 0 themselves get no meaningful answer."""
    n = len(depth)
    zeros = np.flatnonzero(depth == 0)
    longest = int(np.diff(zeros).max(initial=1))
    least = [depth]  # least[t][j]: the smallest of the 2**t numbers that end at j
    while 1 << len(least) <= longest:
        half, last = 1 << (len(least) - 1), least[-1]
        wider = last.copy()
        np.minimum(last[half:], last[:-half], out=wider[half:])
        least.append(wider)
    before, after = np.arange(n) - 1, np.arange(n) + 1
    np.maximum(before, 0, out=before)
    np.minimum(after, n - 1, out=after)
    for t in range(len(least) - 1, -1, -1):
        size = 1 << t
        fits = (before - size >= -1) & (least[t][before] >= depth)
        before = np.maximum(before - size * fits, 0)
        ahead = np.minimum(after + size - 1, n - 1)
        fits = (after + size <= n) & (least[t][ahead] >= depth)
        after = np.minimum(after + size * fits, n - 1)
    return before, after


def _squares(found: SuffixArray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the branching squares in intervals of at least ``power`` suffixes."""
    order, n = found.order, len(found.order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    place = np.flatnonzero(found.ranks[0][order[1:]] == found.ranks[0][order[:-1]]) + 1
    depth = np.zeros(n + 1, np.int64)
    depth[place] = found.shared(order[place - 1], order[place])
    # places without a common prefix only separate; one of them between two stretches is enough
    kept = np.flatnonzero((depth > 0) | (np.append(depth[1:], 0) > 0) | (np.append(0, depth[:-1]) > 0))
    if not len(kept):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kept_depth = depth[kept]
    before, after = _smaller_to_the_sides(kept_depth)
    inner = np.flatnonzero(kept_depth > 0)
    place, d = kept[inner], kept_depth[inner]
    low, high = kept[before[inner]], kept[after[inner]] - 1
    wide = high - low + 1 >= power
    place, d, low, high = place[wide], d[wide], low[wide], high[wide]
    if not len(place):
        return np.empty(0, np.int64), np.empty(0, np.int64)

    # children of an interval: cut at the places whose depth is the interval's
    turn = np.argsort(low * (n + 1) + high, kind="stable")
    place, d, low, high = place[turn], d[turn], low[turn], high[turn]
    first = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
    heads = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    child_low = np.concatenate([low[heads], place])
    child_group = np.concatenate([np.arange(len(heads)), group])
    turn = np.lexsort((child_low, child_group))
    child_low, child_group = child_low[turn], child_group[turn]
    last = np.append(child_group[1:] != child_group[:-1], True)
    child_high = np.where(last, high[heads][child_group], np.append(child_low[1:], 0) - 1)
    size = child_high - child_low + 1
    # all children but the largest one (the first of the largest)
    turn = np.lexsort((-size, child_group))
    largest = turn[np.append(True, np.diff(child_group[turn]) > 0)]
    small = np.ones(len(size), bool)
    small[largest] = False
    child_low, child_high, size = child_low[small], child_high[small], size[small]
    child_group = child_group[small]

    starts, periods = [], []
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // EXPANDED)) + 1
    for one in np.split(np.arange(len(size)), cuts):
        if not len(one):
            continue
        owner = np.repeat(one, size[one])
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(size[one]) - size[one], size[one])
        i = order[child_low[owner] + offset]
        of = heads[child_group[owner]]
        d_i = d[of]

        def in_another_child(j: np.ndarray, inside: np.ndarray) -> np.ndarray:
            at = inverse[np.where(inside, j, 0)]
            return (inside & (at >= low[of]) & (at <= high[of])
                    & ((at < child_low[owner]) | (at > child_high[owner])))

        ahead = in_another_child(i + d_i, i + d_i < found.end[i])
        back = in_another_child(i - d_i, i - d_i >= found.begin[i])
        starts += [i[ahead], i[back] - d_i[back]]
        periods += [d_i[ahead], d_i[back]]
    none = np.empty(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate([none, *starts]), np.concatenate([none, *periods])]), axis=1)
    return pairs[0], pairs[1]


def find_runs(
    words: np.ndarray, sizes: np.ndarray, least_length: int = 6, power: int = 4
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (in the whole array), lengths and smallest periods of the runs of all texts,
    ordered by start and period: stretches of at least ``least_length`` words and ``power``
    (2 or more) times their period that no neighbouring word extends."""
    none = np.empty(0, np.int64)
    if not len(words):
        return none, none, none
    found = suffix_array(words, sizes)
    start, period = _squares(found, power)
    # the square is the last of its run; a power below the asked one ends before it is rotated
    more = (power - 2) * period
    enough = start - more >= found.begin[start]
    start, period, more = start[enough], period[enough], more[enough]
    reach = found.shared(start - more, start - more + period) >= more
    start, period = start[reach], period[reach]
    end = start + 2 * period
    start = start - found.shared_before(start, start + period)
    # one stretch may have come with multiples of its period
    turn = np.lexsort((period, end, start))
    start, end, period = start[turn], end[turn], period[turn]
    first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[:len(start)]
    long = first & (end - start >= np.maximum(least_length, power * period))
    start, end, period = start[long], end[long], period[long]
    turn = np.lexsort((period, start))
    return start[turn], (end - start)[turn], period[turn]


def _groups(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of about ``GROUP_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // GROUP_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def _collapsed(texts: pa.Array, least_length: int, power: int) -> pa.Array:
    """Number of words, runs and the text without repeats, for each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words, of = words.filter(real), of[real.to_numpy(zero_copy_only=False)]
    sizes = np.bincount(of, minlength=len(texts))
    begins = np.cumsum(sizes) - sizes
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, length, period = find_runs(codes, sizes, least_length, power)

    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    stays = np.cumsum(change)[:-1] == 0
    left = np.bincount(of[stays], minlength=len(texts))
    kept = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(left)), pa.int32()), words.filter(pa.array(stays)))
    owner = of[start] if len(start) else np.empty(0, np.int64)
    runs = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts)))), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(start - begins[owner], pa.int64()), pa.array(length, pa.int64()),
             pa.array(period, pa.int64())], fields=list(RUN)),
    )
    return pa.StructArray.from_arrays(
        [pa.array(sizes, pa.int64()), runs, pc.binary_join(kept, " ")], fields=list(RESULT))


def runs_column(text: Column, least_length: int = 6, power: int = 4) -> Column:
    """``struct<n_words, runs array<struct<start, length, period>>, text>`` of a text column."""

    @F.arrow_udf(RESULT_SQL)
    def described(texts: pa.Array) -> pa.Array:
        parts = [_collapsed(g, least_length, power) for g in _groups(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], RESULT)

    return described(text)


def collapse_runs(
    docs: DataFrame, text_col: str = "text", out_col: str = "periodic", least_length: int = 6,
    power: int = 4,
) -> DataFrame:
    """All columns of ``docs`` and ``out_col``: number of words, runs, and the text collapsed.

    Words are what white space (blank, tab to carriage return) leaves.  A run is a stretch of
    words with smallest period ``q`` and at least ``max(least_length, power * q)`` words that no
    neighbouring word extends; runs are ordered by start and period, starts count from 0.  In
    ``out_col.text`` each word is dropped that some run holds after its first ``q`` words, and one
    blank stands between the others.

    Null and empty texts and texts of white space have no words, no runs and an empty text.
    Repeated rows get equal results, an empty table none.  A column named ``out_col`` is replaced;
    all others stay.  Nothing is shuffled; a task holds one group of texts, and of a very long
    text its words and one rank of each position for every doubling up to its longest repeat.
    """
    return docs.withColumn(out_col, runs_column(F.col(quoted(text_col)), least_length, power))
