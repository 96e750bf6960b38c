"""Exact maj@n against enumeration of all draws, and weighted pairwise ranking
against all pairs."""

import collections
import itertools
import random

import numpy as np
import pytest

from rlframe.operators import metrics as ME
from rlframe.operators import ranking as RK
from rlframe.operators.voting import majority_law


def vote(draw):
    """The vote class with most draws (ties: drawn first), valued by its first draw."""
    seen = collections.defaultdict(list)
    for cls, value in draw:
        seen[cls].append(value)
    return seen[max(seen, key=lambda c: len(seen[c]))][0]


@pytest.mark.parametrize("sizes", [(1,), (3,), (1, 1), (2, 1), (1, 1, 1, 1), (3, 2, 2, 1)])
def test_law_equals_enumeration(sizes):
    for n in range(1, 6):
        total, wins = sum(sizes), collections.Counter()
        for seq in itertools.product(range(len(sizes)), repeat=n):
            wins[vote([(c, c) for c in seq])] += np.prod([sizes[c] / total for c in seq])
        law = majority_law(sorted(collections.Counter(sizes).items()), n)
        assert [law[m] for m in sizes] == pytest.approx([wins[c] for c in range(len(sizes))], abs=1e-12)


def test_law_of_many_draws_adds_up_and_grows_with_the_class():
    classes = [(1, 40), (5, 3), (60, 2), (141, 1)]
    n = sum(m * r for m, r in classes)
    law = majority_law(classes, n)
    assert sum(law[m] * r for m, r in classes) == pytest.approx(1, abs=1e-10)
    assert law[1] < law[5] < law[60] < law[141] and law[141] > 0.999


def test_majority_metrics_equal_all_draws(spark):
    samples = {"p1": [("a", 0.25), ("b", 1.0), ("a", 0.75), (None, 0.5)], "p2": [("x", 3.0), ("x", 1.0), ("y", -2.0)], "p3": [("z", 7.0)]}
    rows = [("s", p, "score", c, v) for p, vs in samples.items() for c, v in vs]
    df = spark.createDataFrame(rows, "data_source string, prompt string, var string, pred string, value double")
    got = {r.metric: r.value for r in ME.validation_metrics(df, vote="pred").collect()}
    want = collections.defaultdict(list)
    for vs in samples.values():
        total = len(vs)
        want[f"mean@{total}"].append(np.mean([v for _, v in vs]))
        if total > 1:
            want[f"std@{total}"].append(np.std([v for _, v in vs]))
        for n in {2, total} - {1} if total > 1 else ():
            draws = list(itertools.product(vs, repeat=n))
            for name, fn in (("maj", vote), ("best", lambda d: max(v for _, v in d)), ("worst", lambda d: min(v for _, v in d))):
                outcome = [fn(d) for d in draws]
                want[f"{name}@{n}/mean"].append(np.mean(outcome))
                want[f"{name}@{n}/std"].append(np.std(outcome))
    assert got == pytest.approx({k: np.mean(v) for k, v in want.items()}, abs=1e-9)
    assert ME.validation_metrics(df.where("false"), vote="pred").count() == 0
    # values close together and far from 0 keep their spread
    far = spark.createDataFrame([("s", "p", "v", 1e9 + x) for x in (0.0, 0.001, 0.002)],
                                "data_source string, prompt string, var string, value double")
    assert {r.metric: r.value for r in ME.validation_metrics(far).collect()}["std@3"] == pytest.approx(0.000816, rel=1e-2)


def all_pairs(samples):
    """The rule by its definition, over pairs i < j."""
    hit = weight = 0.0
    for i in range(len(samples)):
        for j in range(i + 1, len(samples)):
            (s, a), (t, b) = samples[i], samples[j]
            hit += abs(a - b) * ((s > t) == (a > b)) if a != b else 0
            weight += abs(a - b)
    return hit / weight if weight else 0.5


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ranking_equals_all_pairs(spark, parts):
    rng = random.Random(parts)
    groups = {"huge": [(rng.randrange(6), rng.choice([0.0, 0.25, 0.5, 1.0])) for _ in range(300)],
              "real": [(rng.random(), rng.random() * 3 - 1) for _ in range(200)], "one": [(1.0, 1.0)],
              "same": [(rng.random(), 0.5) for _ in range(5)], "right": [(0.1, 0.2), (0.2, 0.7), (0.3, 0.9)],
              None: [(3.0, 0.0), (2.0, 1.0), (1.0, 2.0)], "ties": [(1.0, float(i % 2)) for i in range(40)]}
    groups.update({f"g{i}": [(rng.randrange(3), rng.random()) for _ in range(rng.randrange(1, 6))] for i in range(40)})
    rows = [(g, i, float(s), float(a)) for g, vs in groups.items() for i, (s, a) in enumerate(vs)]
    rows += [("void", 0, None, 1.0), ("void", 1, float("nan"), 0.0), ("huge", 999, 1.0, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "grp string, idx int, score double, acc double")
    got = {r.grp: r.rank_acc for r in RK.pairwise_rank_accuracy(df, "grp", "score", "acc", "idx", parts).collect()}
    want = {g: all_pairs(vs) for g, vs in groups.items()} | {"void": 0.5}
    assert got == pytest.approx(want, abs=1e-9)
    assert got["right"] == 1.0 and got[None] == 0.0


def test_ranking_edges(spark):
    df = spark.createDataFrame([], "grp string, idx int, score double, acc double")
    assert RK.pairwise_rank_accuracy(df, "grp", "score", "acc", "idx").count() == 0
    mean = RK.rank_accuracy_mean(RK.pairwise_rank_accuracy(
        spark.createDataFrame([("a", 0, 0.1, 0.0), ("a", 1, 0.2, 1.0), ("b", 0, 0.1, 1.0)], df.schema), "grp", "score", "acc", "idx"))
    assert mean.first()[0] == 0.75
