"""Validation metrics read prompts in order, one row per prompt in what follows:
results don't depend on where batches end, and the plan joins no rows per class."""

import random

import numpy as np
import pytest

from rlframe.operators import metrics as ME
from rlframe.operators.voting import class_sizes, majority_law


def sizes_of(total):
    return [k for k in (2, 4, 8, 16, 32, 64) if k < total] + [total]


def by_hand(groups):
    """Means over prompts of the moments, from the sorted samples and the law."""
    found = {}
    for samples in groups.values():
        x, total = np.sort([v for _, v in samples]), len(samples)
        found.setdefault(f"mean@{total}", []).append(x.mean())
        if total == 1:
            continue
        found.setdefault(f"std@{total}", []).append(x.std())
        classes = {}
        for c, v in samples:
            classes.setdefault(c, []).append(v)
        counted = sorted((m, sum(len(vs) == m for vs in classes.values())) for m in {len(vs) for vs in classes.values()})
        i = np.arange(1, total + 1)
        for n in sizes_of(total):
            p = (i / total) ** n - ((i - 1) / total) ** n
            law = majority_law(counted, n)
            maj = [sum(law[len(vs)] * np.mean(np.power(vs, e)) for vs in classes.values()) for e in (1, 2)]
            for name, m1, m2 in (("best", x @ p, x * x @ p), ("worst", x @ p[::-1], x * x @ p[::-1]), ("maj", *maj)):
                found.setdefault(f"{name}@{n}/mean", []).append(m1)
                found.setdefault(f"{name}@{n}/std", []).append(max(m2 - m1 * m1, 0) ** 0.5)
    return {k: np.mean(v) for k, v in found.items()}


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_prompts_across_batches(spark, batch):
    rng = random.Random(5)
    groups = {f"p{i}": [(rng.choice("abc") if rng.random() < 0.9 else None, rng.randrange(4) + rng.choice([0.0, 0.5]))
                        for _ in range(n)] for i, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 40])}
    rows = [("s" if v != "p3" else None, v, "score", c, x) for v, vs in groups.items() for c, x in vs]
    df = spark.createDataFrame(rows, "data_source string, prompt string, var string, pred string, value double")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        got = ME.validation_metrics(df, vote="pred").collect()
    finally:
        spark.conf.set(key, before)
    for source in ("s", None):
        want = by_hand({v: vs for v, vs in groups.items() if (v == "p3") == (source is None)})
        if source is None:  # votes of no source aren't counted
            want = {k: v for k, v in want.items() if not k.startswith("maj")}
        assert {r.metric: r.value for r in got if r.data_source == source} == pytest.approx(want, abs=1e-9)


def test_class_sizes_are_counted_as_they_come(spark):
    votes = spark.createDataFrame([("p", i, 1 + i % 3, float(i)) for i in range(7)] + [("q", 0, 4, 1.0)],
                                  "prompt string, vote int, size int, m double")
    got = {r.prompt: (r.total, r.sizes, r.m) for r in class_sizes(votes, ["prompt"], sums=("m",)).collect()}
    assert got == {"p": (3 + 4 + 6, [1, 3, 2, 2, 3, 2], [9.0, 5.0, 7.0]), "q": (4, [4, 1], [1.0])}


def test_one_join_and_no_row_per_draw_size(spark):
    df = spark.createDataFrame([("s", "p", "score", "a", 1.0)], "data_source string, prompt string, var string, pred string, value double")
    plan = ME.validation_metrics(df, vote="pred")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # prompts with laws; before also classes with prompts
    assert plan.count("Window") >= 2 and "Generate explode(concat(array(1)" not in plan
