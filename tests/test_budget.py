"""Longest-first micro-batches against a heap that takes one sequence at a time."""

import heapq
import random
from collections import Counter

import numpy as np
import pytest

from rlframe.operators import batch as B
from rlframe.operators import budget as BU


def heap_loads(lengths, k):
    heap = [(0, j) for j in range(k)]
    got = [Counter() for _ in range(k)]
    for size in sorted(lengths, reverse=True):
        load, j = heapq.heappop(heap)
        got[j][size] += 1
        heapq.heappush(heap, (load + size, j))
    return got


def test_quotas_equal_a_heap():
    rng = random.Random(6)
    for _ in range(300):
        lengths = [rng.choice([0, 1, 2, 3, 7, 50, 51, 400]) for _ in range(rng.randrange(1, 60))]
        k = rng.randrange(1, 9)
        c = Counter(lengths)
        sizes = np.array(sorted(c))
        quotas = BU.longest_first(sizes, np.array([c[x] for x in sizes.tolist()]), k)
        want = heap_loads(lengths, k)
        assert [{s: int(q) for s, q in zip(sizes.tolist(), quotas[:, j]) if q} for j in range(k)] == [dict(w) for w in want]
    # a billion sequences cost no more than a few
    quotas = BU.longest_first(np.array([3, 1000]), np.array([10 ** 9, 5]), 7)
    load = quotas.T @ np.array([3, 1000])
    assert quotas.sum() == 10 ** 9 + 5 and load.max() - load.min() <= 3


def test_rows_follow_the_quotas_and_beat_equal_counts(spark):
    rng = random.Random(2)
    lengths = [rng.choice([5, 6, 7, 900]) if rng.random() < 0.9 else 3000 for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, len int")
    out, k = BU.budget_buckets(df, "len", 4000, ["id"])
    rows = out.collect()
    assert k == -(-sum(lengths) // 4000) and sorted(r.id for r in rows) == list(range(400))
    got = [Counter(r.len for r in rows if r.micro_batch == j) for j in range(k)]
    assert got == heap_loads(lengths, k)
    r = BU.budget_report(out, "len", k, 4000).first()
    load = [sum(x * n for x, n in c.items()) for c in got]
    assert (r.buckets, r.largest, r.smallest, r.spread) == (k, max(load), min(load), max(load) - min(load))
    assert (r.over_budget, r.tokens_over) == (sum(x > 4000 for x in load), sum(max(0, x - 4000) for x in load))
    snake, _ = B.token_budget_buckets(df, "len", 4000, ["id"])
    other = [x[0] for x in snake.groupBy("micro_batch").sum("len").select("sum(len)").collect()]
    assert r.spread < max(other) - min(other) and r.largest <= max(other)


def test_many_lengths_and_buckets(spark):
    """More than twenty million pairs of a length and a bucket."""
    lengths = [1 + 7 * i for i in range(5000)] * 2
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, len int")
    budget = sum(lengths) // 4500
    out, k = BU.budget_buckets(df, "len", budget, ["id"])
    assert k * 5000 > 20_000_000
    got = [Counter() for _ in range(k)]
    for r in out.collect():
        got[r.micro_batch][r.len] += 1
    assert got == heap_loads(lengths, k)


def test_heap_and_bisection_agree(monkeypatch):
    rng = random.Random(8)
    for _ in range(100):
        pairs = sorted({rng.randrange(0, 90): rng.randrange(1, 60) for _ in range(12)}.items(), reverse=True)
        k = rng.randrange(1, 9)
        both = []
        for many in (0, 10 ** 9):
            monkeypatch.setattr(BU, "MANY", many)
            both.append([(s, b.tolist(), n.tolist()) for s, b, n in BU.deal(iter(pairs), k)])
        assert both[0] == both[1]


def test_edges(spark):
    empty = spark.createDataFrame([], "id long, len int")
    out, k = BU.budget_buckets(empty, "len", 10, ["id"])
    assert (k, out.count()) == (1, 0)
    out, k = BU.budget_buckets(spark.createDataFrame([(1, 0), (2, 0), (3, 25)], empty.schema), "len", 10, ["id"])
    assert k == 3 and {r.id: r.micro_batch for r in out.collect()} == {1: 1, 2: 1, 3: 0}
    assert BU.budget_report(out, "len", k, 10).first().smallest == 0
    with pytest.raises(Exception, match="0 or more"):
        BU.budget_buckets(spark.createDataFrame([(1, None)], empty.schema), "len", 10, ["id"])
