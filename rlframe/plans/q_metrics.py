"""Validation and batch metric queries (AG-5..17, AR-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.operators import losses as L
from rlframe.operators import metrics as M
from rlframe.operators import ranking as RK
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import adapters as AD
from rlframe.sources.tables import table

_RO = AD.sql_with(rollouts=AD.ROLLOUTS_SQL)
_RO_R = _RO.replace("WITH ", "WITH RECURSIVE ", 1)
_TK = AD.sql_with(tokens=AD.TOKENS_SQL)


def _long_rollouts(spark, sf_dir):
    r = AD.rollouts(spark, sf_dir, numbered=False)
    st = F.explode(F.array(F.struct(F.lit("score").alias("var"), F.col("score").alias("value")),
                           F.struct(F.lit("acc").alias("var"), F.col("acc").alias("value"))))
    return r.select("data_source", "prompt", "pred", "turns", st.alias("_s")).select("data_source", "prompt", "pred", "turns", "_s.*")


def _maj_sql(vote: str) -> str:
    """maj@n by enumeration: every sequence of n vote classes of every
    composition of class sizes, with its probability and its winner."""
    return f"""
, vs AS (SELECT data_source, prompt, {vote} AS vote, 'score' AS var, score AS value FROM rollouts
         UNION ALL SELECT data_source, prompt, {vote}, 'acc', acc FROM rollouts)
, cls AS (SELECT data_source, prompt, var, vote, count(*) AS m, avg(value) AS m1, avg(value * value) AS m2 FROM vs GROUP BY ALL)
, comp AS (SELECT data_source, prompt, var, list(m ORDER BY m) AS sizes, sum(m) AS gn FROM cls GROUP BY ALL)
, shapes AS (SELECT DISTINCT sizes, CAST(gn AS BIGINT) AS gn FROM comp WHERE gn > 1)
, seqs AS (
    SELECT sizes, gn, CAST(0 AS BIGINT) AS n, list_transform(sizes, lambda x: CAST(0 AS BIGINT)) AS cnt,
           list_transform(sizes, lambda x: CAST(0 AS BIGINT)) AS seen, CAST(1 AS DOUBLE) AS w FROM shapes
    UNION ALL
    SELECT s.sizes, s.gn, s.n + 1,
           list_transform(s.cnt, lambda x, i: CASE WHEN i = c.c THEN x + 1 ELSE x END),
           list_transform(s.seen, lambda x, i: CASE WHEN i = c.c AND x = 0 THEN s.n + 1 ELSE x END),
           s.w * s.sizes[c.c] / s.gn
    FROM seqs s JOIN (SELECT unnest(range(1, 9)) AS c) c ON c.c <= len(s.sizes) WHERE s.n < s.gn)
, keyed AS (SELECT sizes, gn, n, w, list_transform(cnt, lambda x, i: x * 1000 - seen[i]) AS k FROM seqs
            WHERE n = gn OR n IN (2, 4, 8, 16))
, wins AS (SELECT sizes, n, list_position(k, list_max(k)) AS c, sum(w) AS p FROM keyed WHERE n > 1 GROUP BY ALL)
, law AS (SELECT s.sizes, u.n, s.sizes[i.c] AS m, avg(coalesce(wins.p, 0)) AS p
          FROM (SELECT DISTINCT sizes FROM shapes) s JOIN (SELECT unnest(range(1, 9)) AS c) i ON i.c <= len(s.sizes)
          JOIN (SELECT DISTINCT sizes, n FROM wins) u ON u.sizes = s.sizes
          LEFT JOIN wins ON wins.sizes = s.sizes AND wins.n = u.n AND wins.c = i.c GROUP BY ALL)
, mj AS (SELECT cls.data_source, cls.prompt, cls.var, law.n, sum(law.p * m1) AS mm, sum(law.p * m2) AS mq
         FROM cls JOIN comp USING (data_source, prompt, var) JOIN law ON law.sizes = comp.sizes AND law.m = cls.m
         GROUP BY ALL)
, mja AS (SELECT data_source, var, 'maj@' || n || '/mean' AS metric, avg(mm) AS value FROM mj GROUP BY data_source, var, n
          UNION ALL SELECT data_source, var, 'maj@' || n || '/std', avg(sqrt(greatest(mq - mm * mm, 0.0)))
          FROM mj GROUP BY data_source, var, n)
"""


_VAL = _RO_R + _maj_sql("pred") + f"""
, lg AS (SELECT data_source, prompt, 'score' AS var, score AS value FROM rollouts
         UNION ALL SELECT data_source, prompt, 'acc' AS var, acc AS value FROM rollouts)
, basic AS (SELECT data_source, prompt, var, count(*) AS gn, avg(value) AS m, stddev_pop(value) AS s FROM lg GROUP BY ALL)
, hist AS (SELECT data_source, prompt, var, value, count(*) AS c FROM lg GROUP BY ALL)
, h2 AS (SELECT *, sum(c) OVER (PARTITION BY data_source, prompt, var ORDER BY value
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM hist)
, h3 AS (SELECT h2.*, hi - c AS lo, basic.gn FROM h2 JOIN basic USING (data_source, prompt, var) WHERE basic.gn > 1)
, ns AS (SELECT gn, unnest(list_append(list_filter(list_transform(range(1, 63), lambda k: CAST(1 AS BIGINT) << k),
                                                  lambda x: x < gn), gn)) AS k
         FROM (SELECT DISTINCT gn FROM h3))
, ex AS (SELECT data_source, prompt, var, k,
                sum(value * (pow(hi / gn, k) - pow(lo / gn, k))) AS bm,
                sum(value * value * (pow(hi / gn, k) - pow(lo / gn, k))) AS bm2,
                sum(value * (pow((gn - lo) / gn, k) - pow((gn - hi) / gn, k))) AS wm,
                sum(value * value * (pow((gn - lo) / gn, k) - pow((gn - hi) / gn, k))) AS wm2
         FROM h3 JOIN ns USING (gn) GROUP BY ALL)
, allm AS (SELECT data_source, prompt, var, 'mean@' || gn AS metric, m AS value FROM basic
           UNION ALL SELECT data_source, prompt, var, 'std@' || gn, s FROM basic WHERE gn > 1
           UNION ALL SELECT data_source, prompt, var, 'best@' || k || '/mean', bm FROM ex
           UNION ALL SELECT data_source, prompt, var, 'best@' || k || '/std', sqrt(greatest(bm2 - bm * bm, 0.0)) FROM ex
           UNION ALL SELECT data_source, prompt, var, 'worst@' || k || '/mean', wm FROM ex
           UNION ALL SELECT data_source, prompt, var, 'worst@' || k || '/std', sqrt(greatest(wm2 - wm * wm, 0.0)) FROM ex)
, vm AS (SELECT data_source, var, metric, avg(value) AS value FROM allm GROUP BY ALL UNION ALL SELECT * FROM mja)
"""


@query("validation_metrics", _VAL + f"SELECT data_source, var, metric, {R6('value')} AS value FROM vm")
def validation_metrics(spark, sf_dir):
    vm = M.validation_metrics(_long_rollouts(spark, sf_dir), vote="pred")
    return vm.select("data_source", "var", "metric", r6("value").alias("value"))


@query("metric_labels", _VAL + f"""
, nm AS (SELECT *, CAST(regexp_extract(metric, '@(\\d+)', 1) AS BIGINT) AS nk FROM vm)
, mx AS (SELECT data_source, var, max(nk) AS nmax FROM nm GROUP BY ALL)
, ha AS (SELECT data_source, max(CAST(var = 'acc' AS INTEGER)) AS has_acc FROM vm GROUP BY ALL)
SELECT CASE WHEN var = (CASE WHEN has_acc = 1 THEN 'acc' ELSE 'reward' END)
                 AND regexp_matches(metric, '^(mean|maj|best)') AND nk = nmax
            THEN 'val-core' ELSE 'val-aux' END || '/' || data_source || '/' || var || '/' || metric AS name,
       {R6('value')} AS value
FROM nm JOIN mx USING (data_source, var) JOIN ha USING (data_source)
""")
def metric_labels(spark, sf_dir):
    vm = M.validation_metrics(_long_rollouts(spark, sf_dir), vote="pred")
    lab = M.metric_labels(vm)
    return lab.select("name", r6("value").alias("value"))


@query("majority_at_n", _RO_R + _maj_sql("turns") + f"SELECT data_source, var, metric, {R6('value')} AS value FROM mja")
def majority_at_n(spark, sf_dir):
    """maj@n alone, with up to four vote classes a prompt."""
    vm = M.validation_metrics(_long_rollouts(spark, sf_dir), vote="turns").where(F.col("metric").startswith("maj@"))
    return vm.select("data_source", "var", "metric", r6("value").alias("value"))


@query("majority_vote", _RO + """
, cls AS (SELECT data_source, prompt, pred, count(*) AS n, min(sample_idx) AS f, arg_min(acc, sample_idx) AS v
          FROM rollouts GROUP BY ALL)
, rk AS (SELECT *, row_number() OVER (PARTITION BY data_source, prompt ORDER BY n DESC, f ASC) AS r FROM cls)
SELECT data_source, prompt, pred AS maj_vote, v AS maj_value FROM rk WHERE r = 1
""")
def majority_vote(spark, sf_dir):
    r = AD.rollouts(spark, sf_dir)
    return M.majority_vote(r, ["data_source", "prompt"], "pred", "acc", "sample_idx")


@query("pairwise_rank_acc", _RO + f"""
, pr AS (SELECT a.uid, abs(a.acc - b.acc) AS w,
                CAST((a.score - b.score > 0) = (a.acc - b.acc > 0) AS DOUBLE) AS hit
         FROM rollouts a JOIN rollouts b ON a.uid = b.uid AND a.sample_idx < b.sample_idx)
, g AS (SELECT uid, CASE WHEN sum(w) = 0 THEN 0.5 ELSE sum(hit * w) / sum(w) END AS rank_acc FROM pr GROUP BY uid)
SELECT r.uid, {R6('coalesce(g.rank_acc, 0.5)')} AS rank_acc FROM (SELECT DISTINCT uid FROM rollouts) r LEFT JOIN g USING (uid)
""")
def pairwise_rank_acc(spark, sf_dir):
    r = AD.rollouts(spark, sf_dir)
    g = RK.pairwise_rank_accuracy(r, "uid", "score", "acc", "sample_idx")
    return g.select("uid", r6("rank_acc").alias("rank_acc"))


_GRADED = """
WITH o AS (SELECT l_suppkey AS grp, l_quantity / 50.0 AS acc,
                  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount, l_orderkey * 10 + l_linenumber, l_quantity) AS rk FROM lineitem)
, pr AS (SELECT a.grp, sum(abs(a.acc - b.acc)) AS w, sum(greatest(b.acc - a.acc, 0)) AS hit
         FROM o a JOIN o b ON a.grp = b.grp AND a.rk < b.rk GROUP BY a.grp)
, g AS (SELECT grp, CASE WHEN coalesce(w, 0) = 0 THEN 0.5 ELSE hit / w END AS rank_acc
        FROM (SELECT DISTINCT grp FROM o) LEFT JOIN pr USING (grp))
"""


def _graded(spark, sf_dir):
    """Accuracies in 50 grades and tied scores, a few hundred samples a group."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("grp"), F.col("l_discount").alias("score"), (F.col("l_quantity") / 50.0).alias("acc"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return RK.pairwise_rank_accuracy(li, "grp", "score", "acc", "pos")


@query("pairwise_rank_graded", _GRADED + f"SELECT grp, {R6('rank_acc')} AS rank_acc FROM g")
def pairwise_rank_graded(spark, sf_dir):
    return _graded(spark, sf_dir).select("grp", r6("rank_acc").alias("rank_acc"))


@query("pairwise_rank_mean", _GRADED + f"SELECT {R6('avg(rank_acc)')} AS rank_acc FROM g")
def pairwise_rank_mean(spark, sf_dir):
    return RK.rank_accuracy_mean(_graded(spark, sf_dir)).select(r6("rank_acc").alias("rank_acc"))


@query("sign_agreement", _RO + f"""
SELECT {R6('avg(CAST(sign(score - 0.05) = sign(acc * 2 - 1) AS DOUBLE))')} AS abs_acc FROM rollouts
""")
def sign_agreement(spark, sf_dir):
    r = AD.rollouts(spark, sf_dir).withColumn("centred", F.col("score") - 0.05)
    return M.sign_agreement(r, "centred", "acc").select(r6("abs_acc").alias("abs_acc"))


@query("softmean_centered", _RO + f"""
, sm AS (SELECT uid, ln(avg(exp(2.0 * score))) / 2.0 AS s FROM rollouts GROUP BY uid)
SELECT r.uid, CAST(r.sample_idx AS BIGINT) AS sample_idx, {R6('r.score - sm.s')} AS centred
FROM rollouts r JOIN sm USING (uid)
""")
def softmean_centered(spark, sf_dir):
    r = AD.rollouts(spark, sf_dir)
    d = M.softmean_centered(r, ["uid"], "score", 2.0, "centred")
    return d.select("uid", F.col("sample_idx").cast("bigint"), r6("centred").alias("centred"))


_BM = _TK + """
, tk AS (SELECT *, reward - 0.05 * (old_logp - ref_logp) * mask AS trew, reward - value AS adv, reward AS ret FROM tokens)
, starts AS (SELECT t.uid, count(*) AS turns FROM tk t LEFT JOIN tk p ON p.uid = t.uid AND p.pos = t.pos - 1
             WHERE t.mask = 1 AND coalesce(p.mask, 0) = 0 GROUP BY t.uid)
, seqs AS (SELECT tk.uid, sum(reward) AS score, sum(trew) AS reward, coalesce(any_value(starts.turns), 0) AS turns,
                  (tk.uid % 50) + 10 AS prompt_length, count(*) AS response_length
           FROM tk LEFT JOIN starts USING (uid) GROUP BY tk.uid)
"""


def _bm_inputs(spark, sf_dir):
    tk = AD.tokens(spark, sf_dir)
    d, _ = L.kl_penalised_rewards(tk, ["uid"], 0.05)
    d = d.withColumns({"advantage": F.col("reward") - F.col("value"), "returns": F.col("reward")})
    prev = d.select("uid", (F.col("pos") + 1).alias("pos"), F.col("mask").alias("_pm"))
    starts = d.join(prev, ["uid", "pos"], "left") \
        .where((F.col("mask") == 1) & (F.coalesce(F.col("_pm"), F.lit(0)) == 0)) \
        .groupBy("uid").agg(F.count(F.lit(1)).alias("turns"))
    seqs = d.groupBy("uid").agg(F.sum("reward").alias("score"), F.sum("token_reward").alias("reward"),
                                F.count(F.lit(1)).alias("response_length")) \
        .join(starts, "uid", "left").fillna(0, ["turns"]) \
        .withColumn("prompt_length", F.pmod("uid", F.lit(50)) + 10)
    return seqs, d


@query("batch_metrics", _BM + f"""
, rmax AS (SELECT max(response_length) AS m FROM seqs)
, m AS (
  SELECT 'critic/score/mean' AS metric, avg(score) AS value FROM seqs UNION ALL
  SELECT 'critic/score/max', max(score) FROM seqs UNION ALL SELECT 'critic/score/min', min(score) FROM seqs UNION ALL
  SELECT 'critic/rewards/mean', avg(reward) FROM seqs UNION ALL SELECT 'critic/rewards/max', max(reward) FROM seqs UNION ALL
  SELECT 'critic/rewards/min', min(reward) FROM seqs UNION ALL
  SELECT 'turns/mean', avg(turns) FROM seqs UNION ALL SELECT 'turns/max', max(turns) FROM seqs UNION ALL
  SELECT 'turns/min', min(turns) FROM seqs UNION ALL
  SELECT 'response_length/mean', avg(response_length) FROM seqs UNION ALL
  SELECT 'response_length/max', max(response_length) FROM seqs UNION ALL
  SELECT 'response_length/min', min(response_length) FROM seqs UNION ALL
  SELECT 'response_length/clip_ratio', avg(CAST(response_length = (SELECT m FROM rmax) AS DOUBLE)) FROM seqs UNION ALL
  SELECT 'prompt_length/mean', avg(prompt_length) FROM seqs UNION ALL
  SELECT 'prompt_length/max', max(prompt_length) FROM seqs UNION ALL
  SELECT 'prompt_length/min', min(prompt_length) FROM seqs UNION ALL
  SELECT 'prompt_length/clip_ratio', avg(CAST(prompt_length = 64 AS DOUBLE)) FROM seqs UNION ALL
  SELECT 'critic/advantages/mean', avg(adv) FROM tk UNION ALL SELECT 'critic/advantages/max', max(adv) FROM tk UNION ALL
  SELECT 'critic/advantages/min', min(adv) FROM tk UNION ALL
  SELECT 'critic/returns/mean', avg(ret) FROM tk UNION ALL SELECT 'critic/returns/max', max(ret) FROM tk UNION ALL
  SELECT 'critic/returns/min', min(ret) FROM tk UNION ALL
  SELECT 'critic/values/mean', avg(value) FROM tk UNION ALL SELECT 'critic/values/max', max(value) FROM tk UNION ALL
  SELECT 'critic/values/min', min(value) FROM tk UNION ALL
  SELECT 'critic/vf_explained_var', 1.0 - var_samp(ret - value) / (var_samp(ret) + 1e-5) FROM tk)
SELECT metric, {R6('value')} AS value FROM m
""")
def batch_metrics(spark, sf_dir):
    seqs, toks = _bm_inputs(spark, sf_dir)
    bm = M.batch_metrics(seqs, toks, ["uid"], max_prompt_length=64)
    return bm.select("metric", r6("value").alias("value"))


@query("batch_score_metrics", _BM + f"""
, x AS (SELECT CAST(uid % 3 = 0 AS DOUBLE) AS em, (uid % 10) / 10.0 AS f1, (uid % 7) / 7.0 AS sm, CAST(uid % 2 AS DOUBLE) AS fmt FROM seqs)
, m AS (SELECT unnest([{{'n': 'em', 'v': em}}, {{'n': 'f1', 'v': f1}}, {{'n': 'sim', 'v': sm}}, {{'n': 'format', 'v': fmt}}]) AS s FROM x)
, a AS (SELECT s.n AS n, avg(s.v) AS mean, max(s.v) AS hi, min(s.v) AS lo FROM m GROUP BY 1)
, pr AS (SELECT avg(adv) AS mean, max(adv) AS hi, min(adv) AS lo, count(*) AS c FROM tk WHERE mask <> 0 AND adv <> 0)
, o AS (SELECT 'critic/' || n || '/mean' AS metric, mean AS value FROM a UNION ALL SELECT 'critic/' || n || '/max', hi FROM a
        UNION ALL SELECT 'critic/' || n || '/min', lo FROM a
        UNION ALL SELECT 'critic/process_rewards/mean', mean FROM pr UNION ALL SELECT 'critic/process_rewards/max', hi FROM pr
        UNION ALL SELECT 'critic/process_rewards/min', lo FROM pr UNION ALL SELECT 'critic/process_rewards/count', c FROM pr)
SELECT metric, {R6('value')} AS value FROM o
""")
def batch_score_metrics(spark, sf_dir):
    """The optional lines of the batch metrics: answer scores and process rewards."""
    seqs, toks = _bm_inputs(spark, sf_dir)
    uid = F.col("uid")
    seqs = seqs.withColumns({"em": (uid % 3 == 0).cast("double"), "f1": uid % 10 / 10.0, "sm": uid % 7 / 7.0, "format": (uid % 2).cast("double")})
    bm = M.batch_metrics(seqs, toks, ["uid"], max_prompt_length=64, extra=("em", "f1", "sm", "format"))
    lines = bm.where(F.col("metric").rlike("^critic/(em|f1|sim|format)/")).unionByName(M.process_reward_metrics(toks, "advantage"))
    return lines.select("metric", r6("value").alias("value"))


@query("throughput_metrics", f"""
WITH s AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS step, count(*) AS n_tokens, sum(value) / 1000.0 AS seconds FROM events GROUP BY 1)
, m AS (SELECT step, 'perf/total_num_tokens' AS metric, CAST(n_tokens AS DOUBLE) AS value FROM s
        UNION ALL SELECT step, 'perf/time_per_step', seconds FROM s
        UNION ALL SELECT step, 'perf/throughput', CASE WHEN seconds > 0 THEN n_tokens / (seconds * 8) END FROM s)
SELECT step, metric, {R6('value')} AS value FROM m
""")
def throughput_metrics(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    steps = ev.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("step")).agg(
        F.count(F.lit(1)).alias("n_tokens"), (F.sum("value") / 1000.0).alias("seconds"))
    return M.throughput_metrics(steps, n_devices=8, keys=["step"]).select("step", "metric", r6("value").alias("value"))


@query("action_mask_stats", _TK + f"""
, per AS (SELECT uid, sum(mask) AS a, count(*) AS t FROM tokens GROUP BY uid)
SELECT {R6('sum(a) / (sum(t) + 1e-8)')} AS action_ratio, CAST(max(a) AS BIGINT) AS action_length_max,
       CAST(min(a) AS BIGINT) AS action_length_min, {R6('avg(a)')} AS action_length_mean FROM per
""")
def action_mask_stats(spark, sf_dir):
    s = M.action_mask_stats(AD.tokens(spark, sf_dir), ["uid"])
    return s.select(r6("action_ratio").alias("action_ratio"), F.col("action_length_max").cast("bigint"),
                    F.col("action_length_min").cast("bigint"), r6("action_length_mean").alias("action_length_mean"))
