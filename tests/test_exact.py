"""Inputs on which a cut, a gap or an underflow used to change results."""

import math

import pytest
from pyspark.sql import functions as F

from rlframe.functions import mathans
from rlframe.operators import losses, process, scan, turns


def solved(spark, rows, chunk=4096):
    d = spark.createDataFrame(rows, "k long, pos long, a double, b double")
    return {(r.k, r.pos): r.x for r in scan.reverse_linear_scan(d, ["k"], "pos", "a", "b", "x", chunk=chunk).collect()}


def test_scan_keeps_strongly_discounted_terms(spark):
    rows = [(1, i, 0.01, 1.0) for i in range(40)] + [(1, 40, 0.01, 1e80)]
    x = 0.0
    for _, _, a, b in reversed(rows):
        x = b + a * x
    assert solved(spark, rows)[1, 0] == pytest.approx(x, rel=1e-12)


def test_scan_crosses_empty_chunks(spark):
    rows = [(1, 0, 1.0, 1.0), (1, 10_000, 1.0, 1.0), (2, 7, 1.0, 3.0)]
    for chunk in (16, 4096, 1_000_000):
        got = solved(spark, rows, chunk)
        assert got == {(1, 0): 2.0, (1, 10_000): 1.0, (2, 7): 3.0}
    d = spark.createDataFrame(rows, "k long, pos long, a double, b double").withColumn("v", F.col("pos") + 0.5)
    nxt = {(r.k, r.pos): r.n for r in scan.lead_next(d, ["k"], "pos", "v", "n", chunk=16).collect()}
    assert nxt == {(1, 0): 10_000.5, (1, 10_000): None, (2, 7): None}


def test_scan_over_many_chunks_equals_a_loop(spark):
    rows = [(k, 3 * i + k, [0.0, -0.5, 0.9, 1.0][i % 4], float(i % 7)) for k in (1, 2) for i in range(700)]
    got = solved(spark, rows, chunk=8)
    for k in (1, 2):
        x = 0.0
        for _, pos, a, b in reversed([r for r in rows if r[0] == k]):
            x = b + a * x
            assert got[k, pos] == pytest.approx(x)


def test_adaptive_coefficient_with_negative_multipliers(spark):
    steps = spark.createDataFrame([(i, 0.0, 6) for i in range(3)], "step long, kl double, n_steps long")
    got = [r.coef for r in losses.adaptive_kl_coef(steps, 0.2, 0.1, 1.0).orderBy("step").collect()]
    assert got == pytest.approx([0.2, -0.04, 0.008])


def test_preference_loss_does_not_underflow(spark):
    rows = spark.createDataFrame([("g", -20000.0, 1.0), ("g", 0.0, 0.0)], "g string, q double, acc double")
    got = process.detach_preference_loss(rows, "g", "q", "acc", 1.0).first().dpo_loss
    assert math.isfinite(got) and got == pytest.approx(20000.0)


def test_all_closed_blocks_count(spark):
    texts = ["```python\na\n```\nx\n```python\nb\n```", "```python\na\n```\n```python\nb", "none", None,
             "see ```python\nc\n```"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in d.orderBy("i").select(turns.fenced_code("t").alias("c")).collect()]
    assert got == ["\n# ========\na\n\n# ========\nb\n", None, None, None, "\n# ========\nc\n"]


def test_answer_spans_and_numbers(spark):
    texts = [r"so \fbox{7} ok", r"we have \boxed 5 then \boxed{7} ok", r"answer is 5 \boxed{} 3"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [tuple(r.m) for r in d.orderBy("i").select(mathans.match_answer("t").alias("m")).collect()]
    assert got == [(True, "7"), (True, "7"), (True, r"5 \boxed{} 3")]
    pair = spark.createDataFrame([("1{,}000", "1000"), ("1,000", "1000"), ("x", "1")], "a string, b string")
    assert [r[0] for r in pair.select(mathans.numeric_close("a", "b")).collect()] == [True, True, False]


def test_scan_of_negative_positions(spark):
    """Chunks are numbered from the smallest position, so none is lost at 0."""
    for chunk in (2, 3, 4096):
        d = spark.createDataFrame([("k", p, 1.0, 1.0, float(p)) for p in range(-5, 6)], "k string, pos int, a double, b double, v double")
        got = {r.pos: r.x for r in scan.reverse_linear_scan(d, ["k"], "pos", "a", "b", "x", chunk=chunk).collect()}
        assert got == {p: 6.0 - p for p in range(-5, 6)}
        nxt = {r.pos: r.n for r in scan.lead_next(d, ["k"], "pos", "v", "n", chunk=chunk).collect()}
        assert nxt == {p: float(p + 1) if p < 5 else None for p in range(-5, 6)}


def test_backward_pass_equals_a_loop_over_batches():
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(8)
    n = 3000
    first = rng.random(n) < 0.02
    first[0] = True
    a, b = rng.normal(size=n), rng.normal(size=n)
    t = pa.table({"_scan_a": a, "_scan_b": b, "_row": np.where(first, 1, 2)})
    got = pa.Table.from_batches(list(scan._backward(t.to_batches(max_chunksize=7))))
    local, opened = 0.0, None
    for i in range(n):
        if first[i]:
            local, opened = 0.0, None
        assert got["_local_next"][i].as_py() == (None if opened is None else pytest.approx(local, abs=1e-9))
        assert got["_open_next"][i].as_py() == (None if opened is None else pytest.approx(opened, abs=1e-9))
        local, opened = b[i] + a[i] * local, a[i] * (1.0 if opened is None else opened)
        assert got["_local"][i].as_py() == pytest.approx(local, abs=1e-9)
        assert got["_open"][i].as_py() == pytest.approx(opened, abs=1e-9)
