"""Periodic runs of words, as maximal pairs of a text's LCP-interval tree.

The suffixes of a text's words are sorted, and the intervals of suffixes that
share a prefix of ``depth`` words are closed bottom-up. Every open interval
holds its positions as one sorted list per left word (the word before the
position; the text's first position has a class of its own). When a smaller
interval joins a larger one, two positions i < j of different intervals and
different left-word classes are a maximal pair: their common prefix is exactly
``depth`` words, and neither side extends. With a distance p = j - i of at most
``depth`` and p + depth >= ``min_length`` the stretch from i to j + depth is a
run as it stands, with no extension: it has period p, two whole periods, and no
neighbouring word prolongs it. A run of exponent e shows up for the multiples
of its period too; of the pairs of one stretch the smallest distance is the
period.

An interval is needed only from ``ceil(min_length / 2)`` common words on, so
most of a text never reaches the tree. The smaller interval joins the larger,
and blocks of one class are skipped by doubling, so a word that repeats m times
costs about m * log(m) steps, never m * m.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlframe.llm.quality import ranks_by_doubling
from rlframe.llm.shared import offsets, slices, text_bytes, word_codes

BYTES_AT_ONCE = 1_000_000


def common_words(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Words in common of each suffix and the one before it in the order."""
    common = np.zeros(len(order), np.int64)
    at = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[at - 1], order[at]
    found = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + found, b + found
        inside = np.flatnonzero((x < ends[a]) & (y < ends[b]))
        same = inside[levels[k][x[inside]] == levels[k][y[inside]]]
        found[same] += 1 << k
    common[at] = found
    return common


class _Interval:
    """Positions that share ``depth`` words: in order, and by left word."""

    __slots__ = ("depth", "all", "classes")

    def __init__(self, depth: int, position: int, left: int):
        self.depth = depth
        self.all = [position]
        self.classes = {left: [position]}

    def pairs_with(self, i: int, left: int, depth: int):
        """Positions of this interval within ``depth`` of i whose left word differs."""
        every, n = self.all, len(self.all)
        own = self.classes.get(left, ())
        k = bisect_left(every, i)
        t = k
        while t < n and every[t] - i <= depth:
            at = bisect_left(own, every[t])
            if at < len(own) and own[at] == every[t]:
                t += _block(every, own, t, at, 1)
            else:
                yield every[t]
                t += 1
        t = k - 1
        while t >= 0 and i - every[t] <= depth:
            at = bisect_left(own, every[t])
            if at < len(own) and own[at] == every[t]:
                t -= _block(every, own, t, at, -1)
            else:
                yield every[t]
                t -= 1

    def take(self, other: _Interval) -> None:
        for left, positions in other.classes.items():
            mine = self.classes.setdefault(left, [])
            for i in positions:
                insort(mine, i)
                insort(self.all, i)


def _block(every: list, own: list, t: int, at: int, step: int) -> int:
    """How many places from ``every[t]`` on in one direction belong to ``own``."""
    most = min(len(own) - at, len(every) - t) if step > 0 else min(at, t) + 1
    good, size = 1, 1
    while good < most:  # doubling, then halving
        size = min(2 * size, most)
        if every[t + step * (size - 1)] != own[at + step * (size - 1)]:
            break
        good = size
    low, high = good, size
    while low < high:
        mid = (low + high + 1) // 2
        if every[t + step * (mid - 1)] == own[at + step * (mid - 1)]:
            low = mid
        else:
            high = mid - 1
    return low


def _join(a: _Interval, b: _Interval, depth: int, min_length: int, found: dict) -> _Interval:
    """Maximal pairs between two intervals, then their union at ``depth``."""
    small, large = (a, b) if len(a.all) < len(b.all) else (b, a)
    for left, positions in small.classes.items():
        for i in positions:
            for j in large.pairs_with(i, left, depth):
                start, period = (i, j - i) if i < j else (j, i - j)
                if period + depth >= min_length:
                    stretch = (start, period + depth)
                    if period < found.get(stretch, period + 1):
                        found[stretch] = period
    large.take(small)
    large.depth = depth
    return large


def maximal_pair_runs(codes: np.ndarray, counts: np.ndarray, min_length: int) -> np.ndarray:
    """Runs (start, length, period) of consecutive texts, sorted by start and
    period; starts count from the first word of the first text."""
    found: dict[tuple[int, int], int] = {}
    n = len(codes)
    least = -(-min_length // 2)
    if n:
        ends = np.repeat(offsets(counts)[1:], counts)
        order, levels = ranks_by_doubling(codes, ends)
        common = common_words(order, levels, ends)
        # left words: codes, but a class of its own for a text's first word
        left = np.empty(n, np.int64)
        left[1:] = codes[:-1]
        first = offsets(counts)[:-1][counts > 0]
        left[first] = -1 - first
        near = np.flatnonzero(common >= least)
        # an interval of the forest is a stretch of neighbours in the order
        for lo, hi in _stretches(near):
            _tree(order[lo - 1:hi + 1].tolist(), common[lo:hi + 1].tolist(), left, min_length, found)
    runs = np.array([(s, length, p) for (s, length), p in found.items()], np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _stretches(at: np.ndarray):
    if len(at):
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        yield from ((int(x[0]), int(x[-1])) for x in np.split(at, cuts))


def _tree(positions: list[int], common: list[int], left: np.ndarray, min_length: int, found: dict) -> None:
    """Close the intervals of one stretch of suffixes bottom-up."""
    lefts = left[positions].tolist()
    open_ = [_Interval(0, positions[0], lefts[0])]  # depth: words shared with the one below
    for i in range(1, len(positions)):
        depth = common[i - 1]
        while open_[-1].depth > depth:
            # the top shares more with the one below it than with what comes
            top = open_.pop()
            below = open_.pop()
            outer = below.depth
            joined = _join(below, top, top.depth, min_length, found)
            joined.depth = outer
            open_.append(joined)
        open_.append(_Interval(depth, positions[i], lefts[i]))
    while len(open_) > 1:
        top = open_.pop()
        below = open_.pop()
        outer = below.depth
        joined = _join(below, top, top.depth, min_length, found)
        joined.depth = outer
        open_.append(joined)


def collapsed_words(docs: list[list[bytes]], counts: np.ndarray, runs: np.ndarray) -> list[bytes]:
    """Each text's words that no run covers after its first period."""
    at = offsets(counts)
    edge = np.zeros(at[-1] + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(edge)[:-1] > 0
    kept = []
    for words, lo, hi in zip(docs, at, at[1:]):
        gone = dropped[lo:hi]
        kept.append(b" ".join(w for w, x in zip(words, gone.tolist()) if not x) if gone.any() else b" ".join(words))
    return kept


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = 12) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed`` in place of the text.

    A run is a stretch of at least ``min_length`` words and two periods that no
    neighbouring word prolongs; ``runs`` holds (start, length, period) by start,
    then period, and ``collapsed`` the words left when each run keeps its first
    period. Null and empty texts have no words: no runs, collapsed ''. Columns
    of the input that clash with these three names are dropped, others stay.
    One row out per row in, repeats too; an empty table gives none. Texts of
    any length are taken whole; a task holds about ``BYTES_AT_ONCE`` bytes of
    texts, or one longest text."""
    own = ("n_words", "runs", "collapsed")
    keep = [c for c in docs.columns if c != text and c not in own]
    source = docs.select(*[docs[c] for c in keep], text_bytes(text).alias("_text"))
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "n_words long",
                            "runs array<struct<start: long, length: long, period: long>>", "collapsed string"])

    def run(batches):
        for batch in batches:
            texts = batch.column("_text")
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1])
            for lo, hi in slices(sizes.tolist(), BYTES_AT_ONCE):
                words = [t.split() for t in texts[lo:hi].to_pylist()]
                codes, counts = word_codes(words)
                found = maximal_pair_runs(codes, counts, min_length)
                at = offsets(counts)
                cuts = np.searchsorted(found[:, 0], at)
                own_start = found[:, 0] - at[np.searchsorted(at, found[:, 0], "right") - 1]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(own_start), pa.array(found[:, 1]), pa.array(found[:, 2])], fields=list(RUNS.value_type)))
                part = batch.slice(lo, hi - lo).select(keep)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(counts), lists, pa.array(collapsed_words(words, counts, found)).cast(pa.string())],
                    names=[*keep, *own])

    return source.mapInArrow(run, out_schema)


def run_digests(found: DataFrame) -> DataFrame:
    """Per document: the number of runs, the longest run, and digests."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("_top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.start")).alias("start"),
        F.col("_top.length").alias("length"), (-F.col("_top.period")).alias("period"),
        F.expr("(1000 * _top.length) div -_top.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_planted_tail(docs: DataFrame) -> DataFrame:
    """(doc_id, text) whose text ends in a repeated stretch for one id in ten.

    Only shapes the input of the check: with h = crc32 of the id's digits and
    g = h div 10, a text of n words with h % 10 = 0 repeats p of its words from
    word a = g % n on, p = 1 + (n - a) div (3 + g % 8). A row without doc_id
    stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != '')")
    out = docs.select("doc_id", "text", h.alias("h")) \
        .withColumn("words", F.when(F.col("h") % 10 == 0, words)) \
        .withColumn("n", F.coalesce(F.size("words"), F.lit(0)).cast("long")) \
        .withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")) \
        .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("transform(sequence(0L, n - 1), i -> words[cast(IF(i >= a, a + (i - a) % p, i) AS int)])")
    return out.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
