"""Hand-derived and reference-stated golden cases (FIXTURES.md)."""

import math

import pytest
from pyspark.sql import functions as F

from rlframe.functions import text as T
from rlframe.functions import transcript as TR
from rlframe.operators import advantage as A
from rlframe.operators import scoring as S


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys())) if cols else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


def test_normalize_answer(spark):
    assert one(spark, T.normalize_answer(F.lit("The  Quick, Fox's a DEN!"))) == "quick foxs den"


def test_f1_variants(spark):
    # eval F1: both-empty rule gives 1; reward F1: no overlap gives 0
    assert one(spark, T.token_f1(F.lit(""), F.lit("the"), eval_variant=True)) == 1.0
    assert one(spark, T.token_f1(F.lit(""), F.lit("the"), eval_variant=False)) == 0.0
    golds = F.array(F.lit("cat"), F.lit("dog sat"))
    assert one(spark, T.reward_f1_max(F.lit("a cat sat"), golds)) == pytest.approx(2 / 3)


def test_substring_variants(spark):
    p, g = T.normalize_answer(F.lit("paris")), T.normalize_answer(F.lit("paris france"))
    assert one(spark, T.eval_substring(p, g)) == 1.0
    assert one(spark, T.reward_substring_any(F.lit("paris"), F.array(F.lit("paris france")))) == 0.0


def test_tfidf_pair(spark):
    preds = spark.createDataFrame([(1, "d", "red car")], "data_id long, dataset string, pred string")
    golds = spark.createDataFrame([("d", 0, "red bus")], "dataset string, gold_idx int, gold string")
    r = S.pair_scores(preds, golds, ["data_id"], ["gold_idx"], ["dataset"]).first()
    assert r["tfidf"] == pytest.approx(1 / (1 + (1 + math.log(1.5)) ** 2), abs=1e-7)


def _transcript(*assistant):
    return "".join(f"<|im_start|>assistant\n{a}<|im_end|>\n" for a in assistant)


def test_format_and_combined(spark):
    good_call = "<think>x</think>\n<interaction_prompt>{}</interaction_prompt>"
    t1 = _transcript(good_call, "<think>y</think><answer>paris</answer>")
    t0 = _transcript("<answer>paris</answer>")
    df = spark.createDataFrame([(1, t1), (2, t0)], "id long, t string")
    out = {r["id"]: r["f"] for r in df.select("id", TR.format_score("t").alias("f")).collect()}
    assert out[1] == 1.0          # 0.4 + 0.25 + 0.25 + 0.1 is exactly 1.0
    assert out[2] == pytest.approx(0.5)
    # combined reward: format 1.0 and F1 0.5 -> 0.5 ; answer only (0.6) -> -0.4
    assert one(spark, TR.combined_reward(F.lit(1.0), F.lit(0.5), F.lit("t"))) == 0.5
    assert one(spark, TR.combined_reward(F.lit(0.6), F.lit(0.0), F.lit("t"))) == pytest.approx(-0.4)


def test_group_advantage_cases(spark):
    df = spark.createDataFrame([("u", 0, 1.0), ("u", 1, 0.0), ("s", 0, 0.3)], "uid string, i int, score double")
    g = {(r.uid, r.i): r.advantage for r in A.grpo_advantage(df).collect()}
    assert g[("u", 0)] == pytest.approx(0.5 / (math.sqrt(0.5) + 1e-6))
    assert g[("u", 1)] == pytest.approx(-0.5 / (math.sqrt(0.5) + 1e-6))
    assert g[("s", 0)] == pytest.approx(0.3 / (1 + 1e-6))
    r = {(x.uid, x.i): x.advantage for x in A.rloo_advantage(df).collect()}
    assert r[("u", 0)] == pytest.approx(1.0) and r[("u", 1)] == pytest.approx(-1.0)
    assert r[("s", 0)] == pytest.approx(0.3)


def test_few_golds_are_not_shuffled_by_token(spark, monkeypatch):
    """Neither tokens of a prediction nor texts of a pair go through a shuffle; many golds give the same."""
    preds = spark.createDataFrame([(i, "d", f"some words here w{i % 5} w{i % 3}") for i in range(30)] + [(3, "d", "twice")],
                                  "data_id long, dataset string, pred string")
    golds = spark.createDataFrame([("d", j, f"other words w{j} w{j + 1}") for j in range(3)], "dataset string, gold_idx int, gold string")
    args = (preds, golds, ["data_id"], ["gold_idx"], ["dataset"])
    got = {}
    for limit in (S.FEW_GOLD_CHARS, 0):
        monkeypatch.setattr(S, "FEW_GOLD_CHARS", limit)
        tfidf, pairs = S.tfidf_pair_scores(*args), S.pair_scores(*args)
        got[limit] = [sorted(map(tuple, df.collect())) for df in (tfidf, pairs)]
        if limit:
            for df in (tfidf, pairs):
                plan = df._jdf.queryExecution().executedPlan().toString()
                shuffles = [line for line in plan.splitlines() if "hashpartitioning(" in line]
                assert shuffles and not [x for x in shuffles if "data_id" in x and "tok#" in x]
    (a, b), (c, d) = got.values()
    assert a == c and b == d and len(a) == len(b) == 99
