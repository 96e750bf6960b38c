"""Queries for group-relative advantages and masked statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.operators import advantage as A
from rlframe.operators.aggregates import masked_mean
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import adapters as AD

_RO = AD.sql_with(rollouts=AD.ROLLOUTS_SQL)
_TK = AD.sql_with(tokens=AD.TOKENS_SQL)


def flagship(spark, sf_dir):
    """rollouts -> GRPO advantage -> per-source score/advantage summary."""
    adv = A.grpo_advantage(AD.rollouts(spark, sf_dir))
    return adv.groupBy("data_source").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg("score")).alias("score_mean"),
        r6(F.min("score")).alias("score_min"),
        r6(F.max("score")).alias("score_max"),
        r6(F.avg("advantage")).alias("adv_mean"),
        r6(F.min("advantage")).alias("adv_min"),
        r6(F.max("advantage")).alias("adv_max"),
    )


query("grpo_source_summary", _RO + f"""
, st AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS s FROM rollouts GROUP BY uid)
, adv AS (SELECT r.data_source, r.score,
                 CASE WHEN st.n = 1 THEN r.score / (1.0 + 1e-6) ELSE (r.score - st.m) / (st.s + 1e-6) END AS a
          FROM rollouts r JOIN st USING (uid))
SELECT data_source, count(*) AS n, {R6('avg(score)')} AS score_mean, {R6('min(score)')} AS score_min,
       {R6('max(score)')} AS score_max, {R6('avg(a)')} AS adv_mean, {R6('min(a)')} AS adv_min,
       {R6('max(a)')} AS adv_max
FROM adv GROUP BY data_source
""")(flagship)


@query("grpo_advantage", _RO + f"""
, st AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS s FROM rollouts GROUP BY uid)
SELECT r.uid, CAST(r.sample_idx AS BIGINT) AS sample_idx,
       {R6('CASE WHEN st.n = 1 THEN r.score / (1.0 + 1e-6) ELSE (r.score - st.m) / (st.s + 1e-6) END')} AS advantage
FROM rollouts r JOIN st USING (uid)
""")
def grpo_advantage(spark, sf_dir):
    adv = A.grpo_advantage(AD.rollouts(spark, sf_dir))
    return adv.select("uid", F.col("sample_idx").cast("bigint"), r6("advantage").alias("advantage"))


@query("grpo_no_std", _RO + f"""
, st AS (SELECT uid, count(*) AS n, avg(score) AS m FROM rollouts GROUP BY uid)
SELECT r.uid, CAST(r.sample_idx AS BIGINT) AS sample_idx,
       {R6('CASE WHEN st.n = 1 THEN r.score ELSE r.score - st.m END')} AS advantage
FROM rollouts r JOIN st USING (uid)
""")
def grpo_no_std(spark, sf_dir):
    adv = A.grpo_advantage(AD.rollouts(spark, sf_dir), norm_by_std=False)
    return adv.select("uid", F.col("sample_idx").cast("bigint"), r6("advantage").alias("advantage"))


@query("rloo_advantage", _RO + f"""
, st AS (SELECT uid, count(*) AS n, avg(score) AS m FROM rollouts GROUP BY uid)
SELECT r.uid, CAST(r.sample_idx AS BIGINT) AS sample_idx,
       {R6('CASE WHEN st.n > 1 THEN r.score * st.n / (st.n - 1) - st.m * st.n / (st.n - 1) ELSE r.score END')} AS advantage
FROM rollouts r JOIN st USING (uid)
""")
def rloo_advantage(spark, sf_dir):
    adv = A.rloo_advantage(AD.rollouts(spark, sf_dir))
    return adv.select("uid", F.col("sample_idx").cast("bigint"), r6("advantage").alias("advantage"))


@query("rf_baseline_whitened", _TK + f"""
, seqs AS (SELECT uid, grp, sum(reward * mask) AS s FROM tokens GROUP BY uid, grp)
, gs AS (SELECT grp, count(*) AS n, avg(s) AS m FROM seqs GROUP BY grp)
, cen AS (SELECT seqs.uid, CASE WHEN gs.n = 1 THEN seqs.s ELSE seqs.s - gs.m END AS c FROM seqs JOIN gs USING (grp))
, raw AS (SELECT t.uid, t.pos, t.mask, cen.c * t.mask AS v FROM tokens t JOIN cen USING (uid))
, st AS (SELECT sum(v * mask) / (sum(mask) + 1e-8) AS mu, sum(mask) AS ms FROM raw)
, st2 AS (SELECT mu, ms, (SELECT sum(mask * (v - mu) * (v - mu)) FROM raw) / (ms + 1e-8) * ms / (ms - 1) AS var FROM st)
SELECT raw.uid, CAST(raw.pos AS BIGINT) AS pos, {R6('(raw.v - st2.mu) / sqrt(st2.var + 1e-8)')} AS advantage
FROM raw, st2
""")
def rf_baseline_whitened(spark, sf_dir):
    tk = AD.tokens(spark, sf_dir)
    adv = A.rf_baseline_whitened(tk, seq=["uid"], group="grp")
    return adv.select("uid", F.col("pos").cast("bigint"), r6("advantage").alias("advantage"))


@query("masked_stats", _TK + f"""
SELECT uid, count(*) AS n_tokens, CAST(sum(mask) AS BIGINT) AS n_action,
       {R6('sum(reward * mask)')} AS masked_sum,
       {R6('sum(reward * mask) / (sum(mask) + 1e-8)')} AS masked_mean,
       {R6('sum(CASE WHEN mask = 0 THEN reward ELSE 0 END) / (sum(1 - mask) + 1e-8)')} AS unmasked_mean
FROM tokens GROUP BY uid
""")
def masked_stats(spark, sf_dir):
    tk = AD.tokens(spark, sf_dir)
    inv = (F.lit(1) - F.col("mask"))
    return tk.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum("mask").cast("bigint").alias("n_action"),
        r6(F.sum(F.col("reward") * F.col("mask"))).alias("masked_sum"),
        r6(masked_mean("reward", "mask")).alias("masked_mean"),
        r6(masked_mean("reward", inv)).alias("unmasked_mean"),
    )
