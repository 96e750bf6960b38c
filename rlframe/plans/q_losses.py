"""KL, loss and batch-metric queries over the token table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.operators import losses as L
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import adapters as AD
from rlframe.sources.tables import table

CLIP_LOW, CLIP_HIGH, CLIP_C, VCLIP, BETA = 0.2, 0.28, 3.0, 0.5, 0.05

_TK = AD.sql_with(tokens=AD.TOKENS_SQL) + """
, tk AS (SELECT *, reward - value AS adv, value + 0.1 * (logp - old_logp) AS vpred, reward AS ret FROM tokens)
"""


def _tk(spark, sf_dir):
    return AD.tokens(spark, sf_dir).withColumns({
        "adv": F.col("reward") - F.col("value"),
        "vpred": F.col("value") + F.lit(0.1) * (F.col("logp") - F.col("old_logp")),
        "ret": F.col("reward")})


@query("kl_estimators", _TK + f"""
SELECT uid, CAST(pos AS BIGINT) AS pos, {R6('logp - ref_logp')} AS kl, {R6('abs(logp - ref_logp)')} AS kl_abs,
       {R6('0.5 * (logp - ref_logp) * (logp - ref_logp)')} AS kl_mse,
       {R6('greatest(least(exp(ref_logp - logp) - (ref_logp - logp) - 1.0, 10.0), -10.0)')} AS kl_low_var
FROM tk
""")
def kl_estimators(spark, sf_dir):
    t = _tk(spark, sf_dir)
    return t.select("uid", F.col("pos").cast("bigint").alias("pos"),
                    *[r6(L.kl_penalty("logp", "ref_logp", k)).alias(n) for k, n in
                      (("kl", "kl"), ("abs", "kl_abs"), ("mse", "kl_mse"), ("low_var_kl", "kl_low_var"))])


@query("kl_penalised_reward", _TK + f"""
SELECT uid, CAST(pos AS BIGINT) AS pos, {R6(f'reward - {BETA} * (old_logp - ref_logp) * mask')} AS token_reward FROM tk
""")
def kl_penalised_reward(spark, sf_dir):
    d, _ = L.kl_penalised_rewards(_tk(spark, sf_dir), ["uid"], BETA)
    return d.select("uid", F.col("pos").cast("bigint").alias("pos"), r6("token_reward").alias("token_reward"))


@query("batch_kl", _TK + f"""
SELECT {R6('avg(skl)')} AS reward_kl_penalty, CAST({BETA} AS DOUBLE) AS reward_kl_penalty_coeff
FROM (SELECT uid, sum((old_logp - ref_logp) * mask) / (sum(mask) + 1e-8) AS skl FROM tk GROUP BY uid)
""")
def batch_kl(spark, sf_dir):
    _, b = L.kl_penalised_rewards(_tk(spark, sf_dir), ["uid"], BETA)
    return b.select(r6("reward_kl_penalty").alias("reward_kl_penalty"), "reward_kl_penalty_coeff")


_PG = _TK + f"""
, pg AS (SELECT *, exp(logp - old_logp) AS ratio FROM tk)
, pg2 AS (SELECT *, -adv * ratio AS l1, -adv * greatest(least(ratio, {1 + CLIP_HIGH}), {1 - CLIP_LOW}) AS l2,
                 -adv * {CLIP_C} AS l3 FROM pg)
, pg3 AS (SELECT *, greatest(l1, l2) AS c1 FROM pg2)
, pt AS (SELECT grp, uid, pos, mask, CASE WHEN adv < 0 THEN least(l3, c1) ELSE c1 END AS lt,
                CAST(l2 > l1 AS DOUBLE) AS clipped, CAST(c1 > l3 AND adv < 0 AS DOUBLE) AS lower,
                old_logp - logp AS klt FROM pg3)
"""


def _pg(spark, sf_dir):
    t = _tk(spark, sf_dir)
    return t.withColumns(L.policy_loss_terms("old_logp", "logp", "adv", CLIP_LOW, CLIP_HIGH, CLIP_C))


@query("ppo_loss_stats", _PG + f"""
SELECT grp, {R6('sum(lt * mask) / (sum(mask) + 1e-8)')} AS pg_loss,
       {R6('sum(clipped * mask) / (sum(mask) + 1e-8)')} AS pg_clipfrac,
       {R6('sum(klt * mask) / (sum(mask) + 1e-8)')} AS ppo_kl,
       {R6('sum(lower * mask) / (sum(mask) + 1e-8)')} AS pg_clipfrac_lower
FROM pt GROUP BY grp
""")
def ppo_loss_stats(spark, sf_dir):
    from rlframe.operators.aggregates import masked_mean
    d = _pg(spark, sf_dir)
    return d.groupBy("grp").agg(
        r6(masked_mean("pg_loss_tok", "mask")).alias("pg_loss"),
        r6(masked_mean("clipped_tok", "mask")).alias("pg_clipfrac"),
        r6(masked_mean("kl_tok", "mask")).alias("ppo_kl"),
        r6(masked_mean("lower_tok", "mask")).alias("pg_clipfrac_lower"))


@query("loss_agg_modes", _PG + f"""
, ps AS (SELECT grp, uid, sum(lt * mask) AS s, sum(mask) AS m, count(*) AS len FROM pt GROUP BY grp, uid)
, tm AS (SELECT grp, sum(lt * mask) / (sum(mask) + 1e-8) AS token_mean FROM pt GROUP BY grp)
SELECT ps.grp, {R6('any_value(tm.token_mean)')} AS token_mean, {R6('avg(s)')} AS seq_mean_token_sum,
       {R6('avg(s / m)')} AS seq_mean_token_mean, {R6('sum(s) / max(len)')} AS seq_mean_token_sum_norm
FROM ps JOIN tm USING (grp) GROUP BY ps.grp
""")
def loss_agg_modes(spark, sf_dir):
    d = _pg(spark, sf_dir)
    out = None
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        name = mode.replace("-", "_")
        r = L.agg_loss(d, "pg_loss_tok", "mask", ["uid"], ["grp"], mode).select("grp", r6("loss").alias(name))
        out = r if out is None else out.join(r, "grp")
    return out


@query("value_loss_stats", _TK + f"""
, vt AS (SELECT grp, mask, greatest(least(vpred, value + {VCLIP}), value - {VCLIP}) AS vc, vpred, ret FROM tk)
, vl AS (SELECT grp, mask, greatest((vpred - ret) * (vpred - ret), (vc - ret) * (vc - ret)) AS vt,
                CAST((vc - ret) * (vc - ret) > (vpred - ret) * (vpred - ret) AS DOUBLE) AS cl FROM vt)
SELECT grp, {R6('0.5 * (sum(vt * mask) / (sum(mask) + 1e-8))')} AS vf_loss,
       {R6('sum(cl * mask) / (sum(mask) + 1e-8)')} AS vf_clipfrac
FROM vl GROUP BY grp
""")
def value_loss_stats(spark, sf_dir):
    from rlframe.operators.aggregates import masked_mean
    d = _tk(spark, sf_dir).withColumns(L.value_loss_terms("vpred", "ret", "value", VCLIP))
    return d.groupBy("grp").agg(r6(F.lit(0.5) * masked_mean("vf_tok", "mask")).alias("vf_loss"),
                                r6(masked_mean("vf_clipped_tok", "mask")).alias("vf_clipfrac"))


_STEPS = """
, steps AS (SELECT CAST(dayofyear(ts) AS BIGINT) AS step, avg(abs(value)) / 100.0 AS kl, count(*) AS n_steps
            FROM events GROUP BY 1)
"""


@query("adaptive_kl", "WITH _u AS (SELECT 1)" + _STEPS + f"""
, m AS (SELECT step, ln(1.0 + greatest(least(kl / 0.1 - 1, 0.2), -0.2) * n_steps / 10000.0) AS lm FROM steps)
SELECT step, {R6('0.2 * exp(coalesce(sum(lm) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))')} AS coef
FROM m
""")
def adaptive_kl(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    steps = ev.groupBy(F.dayofyear("ts").cast("bigint").alias("step")).agg(
        (F.avg(F.abs("value")) / 100.0).alias("kl"), F.count(F.lit(1)).alias("n_steps"))
    d = L.adaptive_kl_coef(steps, 0.2, 0.1, 10000)
    return d.select("step", r6("coef").alias("coef"))
