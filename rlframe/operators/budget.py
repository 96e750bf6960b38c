"""Micro-batches of unequal counts under a token budget (BS-16).

Sequences go longest first to the micro-batch with the least load. Only the
histogram of lengths enters that rule: c sequences of one length l, given to k
loads one by one, take the c smallest of the numbers load_j + i l (i = 0, 1, ...;
ties: the lower bucket). Few sequences of a length are dealt from a heap of the
loads, many by a threshold found by bisection, which gives every bucket's share
of the c at once. So the rule costs at most rows x log(buckets), and distinct
lengths x buckets where rows are many.

One task walks the histogram, as each length depends on the loads the longer ones
left. It holds the loads and one length's shares; the shares that are not zero,
at most one a row, go out as a table. Rows of a length are numbered and joined
with the numbers each bucket takes, so no table of quotas is held anywhere.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlframe.operators.batch import rank_within

#: So many sequences of a length per bucket make the bisection cheaper than the heap.
MANY = 4
#: Rows of one outgoing batch of shares, and ranks listed in one array.
SHARES_AT_ONCE = 50_000
RANKS_AT_ONCE = 4096


def _levelled(load: np.ndarray, size: int, c: int) -> np.ndarray:
    """Shares of ``c`` sequences of length ``size`` in the buckets of ``load``."""
    # the largest level such that at most c places lie below it
    low, high = int(load.min()), int(load.min()) + size * c + 1
    while low < high - 1:
        mid = (low + high) // 2
        if np.maximum(0, -((load - mid) // size)).sum() <= c:
            low = mid
        else:
            high = mid
    share = np.maximum(0, -((load - low) // size))
    rest = c - int(share.sum())  # places at the level itself, lower buckets first
    at_level = np.flatnonzero(load + share * size == low)[:rest]
    share[at_level] += 1
    return share


def deal(histogram: Iterable[tuple[int, int]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, buckets, shares) for (length, count) pairs, longest first.

    Buckets ascend and have a share of 1 at least. Equal to handing out the
    sequences one at a time, always to the least loaded bucket (ties: the lower)."""
    heap = list(range(k))  # load * k + bucket
    for size, c in histogram:
        if size == 0:  # the least loaded bucket stays the least loaded
            yield size, np.array([heap[0] % k]), np.array([c])
        elif c <= MANY * k:
            got, step = [], size * k
            for _ in range(c):
                least = heap[0]
                got.append(least % k)
                heapq.heapreplace(heap, least + step)
            yield size, *np.unique(np.array(got, np.int64), return_counts=True)
        else:
            load = np.zeros(k, np.int64)
            for x in heap:
                load[x % k] = x // k
            share = _levelled(load, size, c)
            load += share * size
            heap = [x * k + j for j, x in enumerate(load.tolist())]
            heapq.heapify(heap)
            some = np.flatnonzero(share)
            yield size, some, share[some]


def longest_first(lengths: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Quotas (distinct lengths x k): how many of each length a bucket gets, as one
    matrix. ``lengths`` are distinct; see :func:`deal`."""
    quotas = np.zeros((len(lengths), k), np.int64)
    order = np.argsort(-lengths, kind="stable")
    for at, (_, buckets, shares) in zip(order, deal(((int(lengths[i]), int(counts[i])) for i in order), k)):
        quotas[at, buckets] = shares
    return quotas


def _shares(k: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())

    def pairs(batches):
        for batch in batches:
            yield from zip(batch.column("_len").to_pylist(), batch.column("_c").to_pylist())

    def run(batches):
        part: list[tuple] = []
        held = 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*part)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["_len", "_from", "_to", "_bucket"])

        for size, buckets, shares in deal(pairs(batches), k):
            ends = np.cumsum(shares)
            part.append((np.full(len(ends), size), ends - shares, ends - 1, buckets))
            held += len(ends)
            if held >= SHARES_AT_ONCE:
                yield flush()
                part, held = [], 0
        if part:
            yield flush()
    return run


def budget_buckets(df: DataFrame, length: str, max_tokens: int, key: list[str], out: str = "micro_batch") -> tuple[DataFrame, int]:
    """``df`` with ``out``, and the number of micro-batches: ceil(tokens / budget).

    The order inside a length is ``key``, which should be total. Loads may exceed
    the budget where lengths do not fit it; :func:`budget_report` says by how much.
    Rows with a null or negative length are an error; an empty table has one
    micro-batch and no rows. Any number of lengths and micro-batches will do."""
    ok = F.when(F.col(length) >= 0, F.col(length)).otherwise(F.raise_error(F.lit(f"{length} must be 0 or more")).cast("long"))
    hist = df.groupBy(ok.cast("long").alias("_len")).agg(F.count(F.lit(1)).alias("_c"))
    tokens = hist.agg(F.sum(F.col("_len") * F.col("_c"))).first()[0]
    k = max(1, -(-int(tokens or 0) // max_tokens))
    shares = hist.repartition(1).sortWithinPartitions(F.desc("_len")) \
        .mapInArrow(_shares(k), "_len long, _from long, _to long, _bucket int")
    # the ranks of a share, by stretches so that no array is long
    stretch = shares.select("_len", "_bucket", "_to", F.explode(F.sequence("_from", "_to", F.lit(RANKS_AT_ONCE).cast("long"))).alias("_at"))
    places = stretch.select("_len", F.explode(F.sequence("_at", F.least("_to", F.col("_at") + (RANKS_AT_ONCE - 1)))).alias("_rank"),
                            F.col("_bucket").alias(out))
    ranked = rank_within(df, [length], key, "_rank").withColumn("_len", F.col(length).cast("long")).withColumn("_rank", F.col("_rank").cast("long"))
    return ranked.join(places, ["_len", "_rank"]).select(*df.columns, out), k


def budget_report(assigned: DataFrame, length: str, k: int, max_tokens: int, bucket: str = "micro_batch") -> DataFrame:
    """One row: buckets, largest and smallest load (an empty bucket has 0), spread,
    fewest and most rows, buckets above the budget and the tokens above it."""
    load = assigned.groupBy(bucket).agg(F.sum(length).cast("long").alias("_l"), F.count(F.lit(1)).alias("_n"))
    over = F.greatest(F.col("_l") - F.lit(max_tokens), F.lit(0))
    empty = F.count(F.lit(1)) < k
    low = lambda c: F.when(empty, F.lit(0)).otherwise(F.min(c)).cast("long")
    return load.agg(F.lit(k).cast("long").alias("buckets"), F.max("_l").alias("largest"), low("_l").alias("smallest"),
                    (F.max("_l") - low("_l")).alias("spread"), low("_n").alias("fewest_rows"), F.max("_n").alias("most_rows"),
                    F.sum((over > 0).cast("long")).alias("over_budget"), F.sum(over).alias("tokens_over"))
