"""Batch-shaping golden cases stated by the reference's tests (FIXTURES §2)."""

import pytest
from pyspark.sql import functions as F

from rlframe.operators import batch as B


@pytest.fixture()
def obs(spark):
    # obs rows [1,2],[3,4],[5,6] keyed by their first value
    df = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long")
    return B.with_global_index(df, [F.col("a")])


def _order(df, col):
    return [r.a for r in df.orderBy(col).collect()]


def test_global_index(obs):
    assert [(r.a, r.idx) for r in obs.orderBy("idx").collect()] == [(1, 0), (3, 1), (5, 2)]


def test_repeat(obs):
    assert _order(B.repeat(obs, 2, interleave=True), "new_idx") == [1, 1, 3, 3, 5, 5]
    assert _order(B.repeat(obs, 2, interleave=False, n=3), "new_idx") == [1, 3, 5, 1, 3, 5]


@pytest.mark.parametrize("k,pad,expect", [(2, 1, [1, 3, 5, 1]), (3, 0, [1, 3, 5]),
                                          (7, 4, [1, 3, 5, 1, 3, 5, 1])])
def test_pad_to_divisor(obs, k, pad, expect):
    padded, p = B.pad_to_divisor(obs, k, 3)
    assert p == pad
    assert _order(padded, "idx") == expect
    assert _order(padded.where(~F.col("is_pad")), "idx") == [1, 3, 5]


def test_reorder_and_inverse(spark):
    df = B.with_global_index(spark.createDataFrame([(i,) for i in range(1, 7)], "a long"), [F.col("a")])
    perm = spark.createDataFrame(list(enumerate([3, 4, 2, 0, 1, 5])), "new_idx long, src_idx long")
    out = B.reorder(df, perm)
    assert _order(out, "new_idx") == [4, 5, 3, 1, 2, 6]
    back = B.reorder(out.drop("idx").withColumnRenamed("new_idx", "idx"), B.inverse_permutation(perm))
    assert _order(back, "new_idx") == [1, 2, 3, 4, 5, 6]


def test_chunk(spark):
    df = B.with_global_index(spark.createDataFrame([(i,) for i in range(1, 7)], "a long"), [F.col("a")])
    c = {r.a: r.chunk_id for r in B.chunk(df, 2, 6).collect()}
    assert [c[i] for i in range(1, 7)] == [0, 0, 0, 1, 1, 1]
    with pytest.raises(ValueError):
        B.chunk(df, 5, 6)


def test_fold_unfold(spark):
    df = B.with_global_index(spark.createDataFrame([(1,), (2,), (3,)], "a long"), [F.col("a")])
    rep = B.repeat(df, 2, interleave=True).drop("idx").withColumnRenamed("new_idx", "idx")
    folded = B.fold(rep, 2)
    perm = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "new_idx long, src_idx long")
    reordered = B.reorder(folded.withColumnRenamed("fold_idx", "idx"), perm).drop("idx") \
        .withColumnRenamed("new_idx", "fold_idx")
    un = B.unfold(reordered, 2)
    assert _order(un, "idx") == [2, 2, 3, 3, 1, 1]


def test_snake_balance_bounds(spark):
    lens = [13, 2, 7, 7, 30, 1, 9, 4, 16, 5, 8, 3]
    df = spark.createDataFrame(list(enumerate(lens)), "k long, len long")
    a = B.snake_buckets(df, "len", 4, ["k"])
    sums = {r.bucket: (r.n, r.s) for r in a.groupBy("bucket").agg(F.count("*").alias("n"),
                                                                   F.sum("len").alias("s")).collect()}
    assert {v[0] for v in sums.values()} == {3}
    spread = max(v[1] for v in sums.values()) - min(v[1] for v in sums.values())
    assert spread <= max(lens) - min(lens)


def test_keyed_union_conflict(spark):
    a = spark.createDataFrame([(1, 1.0), (2, float("nan"))], "k long, x double")
    ok = spark.createDataFrame([(1, 1.0, "p"), (2, float("nan"), "q")], "k long, x double, y string")
    assert B.keyed_union(a, ok, ["k"]).count() == 2          # NaN equals NaN
    bad = spark.createDataFrame([(1, 2.0, "p"), (2, float("nan"), "q")], "k long, x double, y string")
    with pytest.raises(Exception):
        B.keyed_union(a, bad, ["k"]).collect()


def test_accuracy_band_orders_by_both_columns(spark):
    from pyspark.sql import functions as F

    from rlframe.operators import batch
    from rlframe.plans import q_batch
    # 1001 samples of the first prompt come before any of the second
    rows = [(1, i) for i in range(1500)] + [(2, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "uid long, sample_idx int").withColumns(
        {"acc": F.lit(0.5), "response_len": F.lit(1)})
    real = q_batch.AD.rollouts
    q_batch.AD.rollouts = lambda *_: df
    try:
        got = {(r.uid, r.sample_idx) for r in q_batch.accuracy_band_filter(spark, "").collect()}
    finally:
        q_batch.AD.rollouts = real
    assert got == set(rows[:1500])
    assert batch.accuracy_band_filter(df, "uid", "acc", 0, 1, keep_ratio=0.5, order="sample_idx").count() == 1500


def test_prefix_sums_cover_every_array(spark):
    import inspect

    from pyspark.sql import functions as F

    from rlframe.functions.util import prefix_sum
    assert 1 << inspect.signature(prefix_sum).parameters["passes"].default >= 2**31 - 1
    for n in (0, 1, 2, 3, 1000):
        got = spark.range(1).select(prefix_sum(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias("s")).first().s
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]
    assert spark.range(1).select(prefix_sum(F.lit(None).cast("array<int>")).alias("s")).first().s is None
