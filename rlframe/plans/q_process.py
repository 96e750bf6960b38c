"""Process-reward, preference-loss and scorer-plug-in queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.operators import batch as B
from rlframe.operators import process as PR
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import adapters as AD
from rlframe.sources.tables import table

_TK = AD.sql_with(tokens=AD.TOKENS_SQL)


def _tk(spark, sf_dir):
    return AD.tokens(spark, sf_dir).withColumn("acc", F.pmod("uid", F.lit(2)).cast("double")) \
        .withColumn("rm", F.col("logp") - F.col("ref_logp"))


@query("process_rloo", _TK + f"""
, t AS (SELECT *, CAST(uid % 2 AS DOUBLE) AS acc, logp - ref_logp AS rm FROM tokens)
, lastv AS (SELECT uid, max(pos) AS lv FROM t WHERE mask = 1 GROUP BY uid)
, sm AS (SELECT uid, grp, avg(rm) AS m FROM t WHERE mask = 1 GROUP BY uid, grp)
, gs AS (SELECT grp, sum(m) AS s, count(*) AS n FROM sm GROUP BY grp)
, gt AS (SELECT t.uid, t.grp, t.acc FROM t JOIN lastv ON t.uid = lastv.uid AND t.pos = lastv.lv)
, gg AS (SELECT grp, sum(acc) AS s, count(*) AS n FROM gt GROUP BY grp)
, f AS (SELECT t.uid, t.pos, t.mask,
               (CASE WHEN t.mask = 1 AND gs.n > 1 THEN t.rm * gs.n / (gs.n - 1) - gs.s / (gs.n - 1)
                     WHEN t.mask = 1 THEN t.rm ELSE 0.0 END
                + 5.0 * CASE WHEN t.pos = lastv.lv AND gg.n > 1 THEN t.acc * gg.n / (gg.n - 1) - gg.s / (gg.n - 1)
                             WHEN t.pos = lastv.lv THEN t.acc ELSE 0.0 END) * t.mask AS fin
        FROM t JOIN gs USING (grp) JOIN gg USING (grp) LEFT JOIN lastv ON lastv.uid = t.uid)
, r AS (SELECT uid, pos, mask, sum(fin) OVER (PARTITION BY uid ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS ret FROM f)
, st AS (SELECT sum(ret * mask) / (sum(mask) + 1e-8) AS mu, sum(mask) AS ms FROM r)
, st2 AS (SELECT mu, (SELECT sum(mask * (ret - mu) * (ret - mu)) FROM r) / (ms + 1e-8) * ms / (ms - 1) AS var FROM st)
SELECT uid, CAST(pos AS BIGINT) AS pos, {R6('ret')} AS returns, {R6('(ret - st2.mu) / sqrt(st2.var + 1e-8)')} AS advantage
FROM r, st2
""")
def process_rloo(spark, sf_dir):
    d = PR.process_rloo(_tk(spark, sf_dir), ["uid"], "grp", "pos", "mask", "rm", "acc", 1.0, 5.0)
    return d.select("uid", F.col("pos").cast("bigint"), r6("returns").alias("returns"), r6("advantage").alias("advantage"))


@query("implicit_process_reward", _TK + f"""
, t AS (SELECT *, CAST(uid % 2 AS DOUBLE) AS acc, 0.05 * (logp - ref_logp) AS q FROM tokens)
, l AS (SELECT uid, max(pos) AS lp, sum(q) AS tot FROM t GROUP BY uid)
, q2 AS (SELECT t.uid, t.pos, l.lp, CASE WHEN t.pos = l.lp THEN t.acc - (l.tot - t.q) ELSE t.q END AS qq FROM t JOIN l USING (uid))
, r AS (SELECT a.uid, a.pos, a.lp, sum(pow(0.9, b.pos - a.pos) * b.qq) AS r
        FROM q2 a JOIN q2 b ON a.uid = b.uid AND b.pos >= a.pos GROUP BY a.uid, a.pos, a.lp)
SELECT uid, CAST(pos AS BIGINT) AS pos, {R6('CASE WHEN pos < lp THEN r ELSE 0.0 END')} AS token_score FROM r
""")
def implicit_process_reward(spark, sf_dir):
    d = PR.implicit_process_reward(_tk(spark, sf_dir), ["uid"], "pos", "logp", "ref_logp", "acc", 0.05, 0.9)
    return d.select("uid", F.col("pos").cast("bigint"), r6("token_score").alias("token_score"))


_SEQ = _TK + """
, s AS (SELECT uid, grp, sum((logp - ref_logp) * mask) AS q, CAST(uid % 2 AS DOUBLE) AS acc FROM tokens GROUP BY uid, grp)
"""


def _seqs(spark, sf_dir):
    t = _tk(spark, sf_dir)
    return t.groupBy("uid", "grp").agg(F.sum(F.col("rm") * F.col("mask")).alias("q"), F.first("acc").alias("acc"))


@query("ce_preference_loss", _SEQ + f"""
SELECT {R6('avg(-(acc * greatest(ln(1.0 / (1.0 + exp(-0.5 * q))), -100.0) + (1.0 - acc) * greatest(ln(1.0 - 1.0 / (1.0 + exp(-0.5 * q))), -100.0)))')} AS ce_loss FROM s
""")
def ce_preference_loss(spark, sf_dir):
    return PR.ce_preference_loss(_seqs(spark, sf_dir), "q", "acc", 0.5).select(r6("ce_loss").alias("ce_loss"))


@query("detach_preference_loss", _SEQ + f"""
, o AS (SELECT a.uid, a.q, a.acc,
               avg(b.q) FILTER (WHERE (a.acc > 0 AND b.acc < a.acc) OR (a.acc <= 0 AND b.acc > a.acc)) AS oq,
               avg(CAST(b.acc <= a.acc AS DOUBLE)) AS frac, count(*) AS n
        FROM s a JOIN s b ON a.grp = b.grp GROUP BY a.uid, a.q, a.acc)
, l AS (SELECT *, -ln(1.0 / (1.0 + exp(-((a_q - o_q) * CASE WHEN acc > 0 THEN 1.0 ELSE -1.0 END)))) AS loss
        FROM (SELECT *, q * 0.5 AS a_q, coalesce(oq * 0.5, 0.0) AS o_q FROM o))
SELECT {R6('avg(loss)')} AS dpo_loss, {R6('sum(loss * n * pow(frac, n - 1))')} AS dpo_loss_bon_acc FROM l
""")
def detach_preference_loss(spark, sf_dir):
    s = _seqs(spark, sf_dir)
    a = PR.detach_preference_loss(s, "grp", "q", "acc", 0.5, "none")
    b = PR.detach_preference_loss(s, "grp", "q", "acc", 0.5, "bon_acc").withColumnRenamed("dpo_loss", "bon")
    return a.withColumn("_k", F.lit(1)).join(F.broadcast(b.withColumn("_k", F.lit(1))), "_k").select(
        r6("dpo_loss").alias("dpo_loss"), r6("bon").alias("dpo_loss_bon_acc"))


@query("best_of_n_preference_loss", _SEQ + f"""
, o AS (SELECT a.uid, a.q, a.acc,
               avg(b.q) FILTER (WHERE (a.acc > 0 AND b.acc < a.acc) OR (a.acc <= 0 AND b.acc > a.acc)) AS oq,
               avg(CAST(b.q * 0.05 <= a.q * 0.05 AS DOUBLE)) AS frac, count(*) AS n
        FROM s a JOIN s b ON a.grp = b.grp GROUP BY a.uid, a.q, a.acc)
, l AS (SELECT *, -ln(1.0 / (1.0 + exp(-((q * 0.05 - coalesce(oq * 0.05, 0.0)) * CASE WHEN acc > 0 THEN 1.0 ELSE -1.0 END)))) AS loss FROM o)
SELECT {R6('sum(loss * n * pow(frac, n - 1))')} AS dpo_loss FROM l
""")
def best_of_n_preference_loss(spark, sf_dir):
    return PR.detach_preference_loss(_seqs(spark, sf_dir), "grp", "q", "acc", 0.05, "bon_rm").select(r6("dpo_loss").alias("dpo_loss"))


@query("sq_logratio_loss", _TK + f"""
, s AS (SELECT uid, sum(logp * mask) AS lp, sum(old_logp * mask) AS olp, sum(reward) AS r FROM tokens GROUP BY uid)
SELECT {R6('avg(pow(lp - olp - 0.1 * r, 2))')} AS sppo_loss FROM s
""")
def sq_logratio_loss(spark, sf_dir):
    t = AD.tokens(spark, sf_dir)
    r = t.groupBy("uid").agg(F.sum("reward").alias("seq_reward"))
    return PR.sq_logratio_loss(t.join(r, "uid"), ["uid"], "logp", "old_logp", "mask", "seq_reward", 0.1) \
        .select(r6("sppo_loss").alias("sppo_loss"))


@query("last_token_reward", _TK + f"""
, s AS (SELECT uid, max(pos) AS lp, sum(reward) AS sc FROM tokens GROUP BY uid)
SELECT t.uid, CAST(t.pos AS BIGINT) AS pos, {R6('CASE WHEN t.pos = s.lp THEN s.sc ELSE 0.0 END')} AS token_reward
FROM tokens t JOIN s USING (uid)
""")
def last_token_reward(spark, sf_dir):
    t = AD.tokens(spark, sf_dir)
    s = t.groupBy("uid").agg(F.sum("reward").alias("seq_score"))
    d = PR.last_token_reward(t.join(s, "uid"), ["uid"], "pos", "seq_score")
    return d.select("uid", F.col("pos").cast("bigint"), r6("token_reward").alias("token_reward"))


@query("seeded_sample", """
SELECT event_id FROM events
ORDER BY md5('7' || chr(31) || CAST(event_id AS VARCHAR) || chr(31) || CAST(user_id AS VARCHAR) || chr(31) || event_type), event_id
LIMIT 50
""")
def seeded_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return PR.seeded_sample(e, ["event_id", "user_id", "event_type"], 50, 7).select("event_id")


@query("multi_response_eval", AD.sql_with(messages=AD.MESSAGES_SQL, facts=AD.CONV_FACTS_SQL) + f"""
, per AS (SELECT conv_id, avg(CAST(contains(content, 'the ') AS DOUBLE)) AS m FROM messages WHERE role = 'assistant' GROUP BY conv_id)
SELECT 'test_score/' || data_source AS metric, {R6('avg(m)')} AS test_score FROM per JOIN facts USING (conv_id) GROUP BY data_source
""")
def multi_response_eval(spark, sf_dir):
    m = AD.messages(spark, sf_dir).where(F.col("role") == "assistant")
    rows = B.gather_responses(m, ["conv_id"], "turn", "content").join(AD.conv_facts(spark, sf_dir), "conv_id")
    out = PR.multi_response_eval(rows, "data_source", "responses", lambda c: F.instr(c, "the ") > 0)
    return out.select("metric", r6("test_score").alias("test_score"))


def _distinct_ratio(text):
    words = text.split()
    return len(set(words)) / len(words)


@query("custom_scorer", f"""
SELECT doc_id, {R6("CASE WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) = 0 THEN 0.0 ELSE len(list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) / len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) END")} AS score
FROM documents
""")
def custom_scorer(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    udf = PR.python_scorer(_distinct_ratio)
    return d.select("doc_id", r6(udf(F.col("text"))).alias("score"))


def _lengths(texts):
    return [len(t) for t in texts]


@query("batched_scorer", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS score FROM documents")
def batched_scorer(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", PR.batched_scorer(_lengths)(F.col("text")).alias("score"))
