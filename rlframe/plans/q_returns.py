"""Queries for token-level returns and GAE (oracle: O(n^2) self-joins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.operators import returns as RT
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import adapters as AD

_TK = AD.sql_with(tokens=AD.TOKENS_SQL)
GAMMA, LAM = 0.99, 0.95

_WHITEN = """
, st AS (SELECT sum({v} * mask) / (sum(mask) + 1e-8) AS mu, sum(mask) AS ms FROM {t})
, st2 AS (SELECT mu, (SELECT sum(mask * ({v} - mu) * ({v} - mu)) FROM {t}) / (ms + 1e-8) * ms / (ms - 1) AS var FROM st)
"""


def _out(df, *cols):
    return df.select("uid", F.col("pos").cast("bigint").alias("pos"), *[r6(c).alias(c) for c in cols])


@query("discounted_return", _TK + f"""
, mt AS (SELECT uid, pos, reward, row_number() OVER (PARTITION BY uid ORDER BY pos) AS i FROM tokens WHERE mask = 1)
, g AS (SELECT a.uid, a.pos, sum(pow({GAMMA}, b.i - a.i) * b.reward) AS g
        FROM mt a JOIN mt b ON a.uid = b.uid AND b.i >= a.i GROUP BY a.uid, a.pos)
, r AS (SELECT t.uid, t.pos, t.mask, coalesce(g.g, 0.0) AS returns FROM tokens t LEFT JOIN g USING (uid, pos))
{_WHITEN.format(v='returns', t='r')}
SELECT uid, CAST(pos AS BIGINT) AS pos, {R6('returns')} AS returns,
       {R6('(returns - st2.mu) / sqrt(st2.var + 1e-8) * mask')} AS advantage
FROM r, st2
""")
def discounted_return(spark, sf_dir):
    d = RT.reinforce_pp(AD.tokens(spark, sf_dir), ["uid"], gamma=GAMMA, variant="agent")
    return _out(d, "returns", "advantage")


@query("discounted_return_reset", _TK + f"""
, nz AS (SELECT uid, pos, reward, mask,
                min(CASE WHEN mask = 0 THEN pos END) OVER (PARTITION BY uid ORDER BY pos
                    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z FROM tokens)
, g AS (SELECT a.uid, a.pos, sum(pow({GAMMA}, b.pos - a.pos) * b.reward) AS g
        FROM nz a JOIN tokens b ON a.uid = b.uid AND b.pos >= a.pos AND (a.z IS NULL OR b.pos < a.z)
        GROUP BY a.uid, a.pos)
, r AS (SELECT t.uid, t.pos, t.mask, g.g AS returns FROM tokens t JOIN g USING (uid, pos))
{_WHITEN.format(v='returns', t='r')}
SELECT uid, CAST(pos AS BIGINT) AS pos, {R6('returns')} AS returns,
       {R6('(returns - st2.mu) / sqrt(st2.var + 1e-8) * mask')} AS advantage
FROM r, st2
""")
def discounted_return_reset(spark, sf_dir):
    d = RT.reinforce_pp(AD.tokens(spark, sf_dir), ["uid"], gamma=GAMMA, variant="framework")
    return _out(d, "returns", "advantage")


@query("reward_to_go", _TK + f"""
, g AS (SELECT a.uid, a.pos, a.mask, sum(b.reward * b.mask) AS rtg
        FROM tokens a JOIN tokens b ON a.uid = b.uid AND b.pos >= a.pos GROUP BY a.uid, a.pos, a.mask)
SELECT uid, CAST(pos AS BIGINT) AS pos, {R6('rtg')} AS returns,
       {R6('rtg - (uid % 7) / 10.0 * mask')} AS advantage
FROM g
""")
def reward_to_go(spark, sf_dir):
    tk = AD.tokens(spark, sf_dir).withColumn("baseline", F.pmod("uid", F.lit(7)) / 10.0)
    d = RT.remax(tk, ["uid"], "baseline")
    return _out(d, "returns", "advantage")


@query("gae", _TK + f"""
, mt AS (SELECT uid, pos, reward, value, row_number() OVER (PARTITION BY uid ORDER BY pos) AS i,
                coalesce(lead(value) OVER (PARTITION BY uid ORDER BY pos), 0.0) AS vn
         FROM tokens WHERE mask = 1)
, dl AS (SELECT uid, pos, i, reward + {GAMMA} * vn - value AS delta FROM mt)
, a AS (SELECT x.uid, x.pos, sum(pow({GAMMA * LAM}, y.i - x.i) * y.delta) AS adv
        FROM dl x JOIN dl y ON x.uid = y.uid AND y.i >= x.i GROUP BY x.uid, x.pos)
, r AS (SELECT t.uid, t.pos, t.mask, t.value, coalesce(a.adv, 0.0) AS adv FROM tokens t LEFT JOIN a USING (uid, pos))
{_WHITEN.format(v='adv', t='r')}
SELECT uid, CAST(pos AS BIGINT) AS pos, {R6('adv + value')} AS returns,
       {R6('(adv - st2.mu) / sqrt(st2.var + 1e-8)')} AS advantage
FROM r, st2
""")
def gae(spark, sf_dir):
    d = RT.gae(AD.tokens(spark, sf_dir), ["uid"], GAMMA, LAM, variant="agent")
    return _out(d, "returns", "advantage")


@query("gae_framework", _TK + f"""
, dl AS (SELECT uid, pos, mask, value,
                reward + {GAMMA} * coalesce(lead(value) OVER (PARTITION BY uid ORDER BY pos), 0.0) - value AS delta
         FROM tokens)
, a AS (SELECT x.uid, x.pos, x.mask, x.value, sum(pow({GAMMA * LAM}, y.pos - x.pos) * y.delta) AS adv
        FROM dl x JOIN dl y ON x.uid = y.uid AND y.pos >= x.pos GROUP BY x.uid, x.pos, x.mask, x.value)
{_WHITEN.format(v='adv', t='a')}
SELECT uid, CAST(pos AS BIGINT) AS pos, {R6('adv + value')} AS returns,
       {R6('(adv - st2.mu) / sqrt(st2.var + 1e-8)')} AS advantage
FROM a, st2
""")
def gae_framework(spark, sf_dir):
    d = RT.gae(AD.tokens(spark, sf_dir), ["uid"], GAMMA, LAM, variant="framework")
    return _out(d, "returns", "advantage")
