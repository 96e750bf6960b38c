"""Answer-scoring queries over whole document texts (SC-1..11)."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from rlframe.functions import text as T
from rlframe.operators import scoring as S
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import adapters as AD

_P = string.punctuation.replace("'", "''")


def _ntoks(x: str) -> str:
    # articles dropped as whole tokens: RE2's \b is ASCII-only, so the
    # oracle filters tokens instead of using a regex boundary
    return (f"list_filter(string_split_regex(translate(lower({x}), '{_P}', ''), '\\s+'), "
            f"lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))")


_BASE = AD.sql_with(preds=AD.PREDS_SQL, golds=AD.GOLDS_SQL) + f"""
, np AS (SELECT data_id, dataset, pred, {_ntoks('pred')} AS toks FROM preds)
, ng AS (SELECT dataset, gold_idx, gold, {_ntoks('gold')} AS toks FROM golds)
, pairs AS (SELECT np.data_id, ng.gold_idx, array_to_string(np.toks, ' ') AS sp, array_to_string(ng.toks, ' ') AS sg,
                   len(np.toks) AS n_p, len(ng.toks) AS n_g,
                   len(list_distinct(np.toks)) AS d_p, len(list_distinct(ng.toks)) AS d_g,
                   regexp_replace(np.pred, '\\s', '', 'g') = '' AS pblank,
                   regexp_replace(ng.gold, '\\s', '', 'g') = '' AS gblank
            FROM np JOIN ng USING (dataset))
, pt AS (SELECT data_id, dataset, tok, count(*) AS c FROM (SELECT data_id, dataset, unnest(toks) AS tok FROM np) GROUP BY ALL)
, gt AS (SELECT dataset, gold_idx, tok, count(*) AS c FROM (SELECT dataset, gold_idx, unnest(toks) AS tok FROM ng) GROUP BY ALL)
, cm AS (SELECT pt.data_id, gt.gold_idx, sum(least(pt.c, gt.c)) AS common, count(*) AS inter
         FROM pt JOIN gt USING (dataset, tok) GROUP BY ALL)
, ps AS (SELECT pairs.*, coalesce(cm.common, 0) AS common, coalesce(cm.inter, 0) AS inter
         FROM pairs LEFT JOIN cm USING (data_id, gold_idx))
, sc AS (SELECT data_id, gold_idx,
                CAST(sp = sg AS DOUBLE) AS em,
                CAST(contains(sp, sg) OR contains(sg, sp) AS DOUBLE) AS sm_eval,
                CAST(contains(sp, sg) AS DOUBLE) AS sm_reward,
                CASE WHEN n_p = 0 AND n_g = 0 THEN 1.0 WHEN n_p = 0 OR n_g = 0 THEN 0.0 WHEN common = 0 THEN 0.0
                     ELSE 2 * (common / n_p) * (common / n_g) / ((common / n_p) + (common / n_g)) END AS f1_eval,
                CASE WHEN n_p = 0 OR n_g = 0 OR common = 0 THEN 0.0
                     ELSE 2 * (common / n_p) * (common / n_g) / ((common / n_p) + (common / n_g)) END AS f1_reward,
                CASE WHEN pblank OR gblank OR d_p = 0 OR d_g = 0 THEN 1.0
                     ELSE inter / (d_p + d_g - inter) END AS jaccard
         FROM ps)
"""


def _scores(spark, sf_dir, tfidf=False):
    preds, golds = AD.prediction_tables(spark, sf_dir)
    sc = S.pair_scores(preds, golds, ["data_id"], ["gold_idx"], ["dataset"], with_tfidf=tfidf)
    return preds, sc


def _pair_out(sc, *cols):
    return sc.select("data_id", F.col("gold_idx").cast("bigint").alias("gold_idx"), *[r6(c).alias(c) for c in cols])


@query("normalize_answer", AD.sql_with(preds=AD.PREDS_SQL) + f"""
SELECT data_id, array_to_string({_ntoks('pred')}, ' ') AS norm, CAST(len({_ntoks('pred')}) AS BIGINT) AS n_tokens
FROM preds
""")
def normalize_answer(spark, sf_dir):
    preds, _ = AD.prediction_tables(spark, sf_dir)
    n = preds.select("data_id", T.normalize_answer("pred").alias("norm"))
    return n.select("data_id", "norm", F.size(T.tokens("norm")).cast("bigint").alias("n_tokens"))


@query("exact_match", _BASE + f"SELECT data_id, CAST(gold_idx AS BIGINT) AS gold_idx, {R6('em')} AS em FROM sc")
def exact_match(spark, sf_dir):
    return _pair_out(_scores(spark, sf_dir)[1], "em")


@query("substring_match", _BASE + f"""
SELECT data_id, CAST(gold_idx AS BIGINT) AS gold_idx, {R6('sm_eval')} AS sm_eval, {R6('sm_reward')} AS sm_reward FROM sc
""")
def substring_match(spark, sf_dir):
    return _pair_out(_scores(spark, sf_dir)[1], "sm_eval", "sm_reward")


@query("eval_f1", _BASE + f"SELECT data_id, CAST(gold_idx AS BIGINT) AS gold_idx, {R6('f1_eval')} AS f1_eval FROM sc")
def eval_f1(spark, sf_dir):
    return _pair_out(_scores(spark, sf_dir)[1], "f1_eval")


@query("reward_f1", _BASE + f"SELECT data_id, {R6('max(f1_reward)')} AS reward_f1 FROM sc GROUP BY data_id")
def reward_f1(spark, sf_dir):
    sc = _scores(spark, sf_dir)[1]
    return sc.groupBy("data_id").agg(r6(F.max("f1_reward")).alias("reward_f1"))


@query("jaccard_sim", _BASE + f"SELECT data_id, CAST(gold_idx AS BIGINT) AS gold_idx, {R6('jaccard')} AS jaccard FROM sc")
def jaccard_sim(spark, sf_dir):
    return _pair_out(_scores(spark, sf_dir)[1], "jaccard")


_W = "[\\p{L}\\p{N}_]{2,}"
_TFIDF = AD.sql_with(preds=AD.PREDS_SQL, golds=AD.GOLDS_SQL) + f"""
, pairs AS (SELECT p.data_id, g.gold_idx, regexp_replace(p.pred, '\\s', '', 'g') = '' AS pblank,
                   regexp_replace(g.gold, '\\s', '', 'g') = '' AS gblank
            FROM preds p JOIN golds g USING (dataset))
, pw AS (SELECT data_id, dataset, w, count(*) AS a
         FROM (SELECT data_id, dataset, unnest(regexp_extract_all(lower(pred), '{_W}')) AS w FROM preds) GROUP BY ALL)
, gw AS (SELECT dataset, gold_idx, w, count(*) AS b
         FROM (SELECT dataset, gold_idx, unnest(regexp_extract_all(lower(gold), '{_W}')) AS w FROM golds) GROUP BY ALL)
, pa AS (SELECT pairs.data_id, pairs.gold_idx, pw.w, pw.a FROM pairs JOIN preds USING (data_id)
         JOIN pw ON pw.data_id = pairs.data_id)
, pb AS (SELECT pairs.data_id, pairs.gold_idx, gw.w, gw.b FROM pairs JOIN preds USING (data_id)
         JOIN gw ON gw.dataset = preds.dataset AND gw.gold_idx = pairs.gold_idx)
, j AS (SELECT coalesce(pa.data_id, pb.data_id) AS data_id, coalesce(pa.gold_idx, pb.gold_idx) AS gold_idx,
               coalesce(pa.a, 0) AS a, coalesce(pb.b, 0) AS b
        FROM pa FULL OUTER JOIN pb ON pa.data_id = pb.data_id AND pa.gold_idx = pb.gold_idx AND pa.w = pb.w)
, v AS (SELECT data_id, gold_idx,
               a * CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE 1.0 + ln(1.5) END AS wa,
               b * CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE 1.0 + ln(1.5) END AS wb FROM j)
, cs AS (SELECT data_id, gold_idx, sum(wa * wb) AS dot, sqrt(sum(wa * wa)) AS na, sqrt(sum(wb * wb)) AS nb
         FROM v GROUP BY ALL)
SELECT pairs.data_id, CAST(pairs.gold_idx AS BIGINT) AS gold_idx,
       {R6("CASE WHEN pblank OR gblank OR cs.data_id IS NULL THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE dot / (na * nb) END")} AS tfidf
FROM pairs LEFT JOIN cs USING (data_id, gold_idx)
"""


@query("tfidf_pair_cosine", _TFIDF)
def tfidf_pair_cosine(spark, sf_dir):
    preds, golds = AD.prediction_tables(spark, sf_dir)
    return _pair_out(S.tfidf_pair_scores(preds, golds, ["data_id"], ["gold_idx"], ["dataset"]), "tfidf")


_ROLL = _BASE + """
, best AS (SELECT data_id, max(em) AS em, max(sm_eval) AS sm, max(f1_eval) AS f1, max(jaccard) AS sim FROM sc GROUP BY data_id)
, roll AS (SELECT p.dataset, count(*) AS cnt, avg(coalesce(em, 0)) AS emm, sum(coalesce(em, 0)) AS ems,
                  avg(coalesce(sm, 0)) AS smm, sum(coalesce(sm, 0)) AS sms, avg(coalesce(f1, 0)) AS f1m,
                  avg(coalesce(sim, 0)) AS simm
           FROM preds p LEFT JOIN best USING (data_id) GROUP BY p.dataset)
"""


def _rollup(spark, sf_dir):
    preds, sc = _scores(spark, sf_dir)
    best = S.best_per_prediction(sc, ["data_id"], ("em", "sm_eval", "f1_eval", "jaccard"))
    return S.dataset_rollup(preds, best, ["data_id"], "dataset", similarity="jaccard")


@query("eval_rollup", _ROLL + f"""
SELECT dataset, cnt AS count, {R6('emm')} AS exact_match_mean, CAST(ems AS BIGINT) AS exact_match_sum,
       {R6('smm')} AS substring_match_mean, CAST(sms AS BIGINT) AS substring_match_sum,
       {R6('f1m')} AS f1_mean, {R6('simm')} AS semantic_similarity_mean
FROM roll
""")
def eval_rollup(spark, sf_dir):
    r = _rollup(spark, sf_dir)
    return r.select("dataset", "count", r6("exact_match_mean").alias("exact_match_mean"), "exact_match_sum",
                    r6("substring_match_mean").alias("substring_match_mean"), "substring_match_sum",
                    r6("f1_mean").alias("f1_mean"),
                    r6("semantic_similarity_mean").alias("semantic_similarity_mean"))


@query("eval_macro", _ROLL + f"""
SELECT count(*) AS n_datasets, {R6('avg(emm)')} AS exact_match_mean, {R6('avg(smm)')} AS substring_match_mean,
       {R6('avg(f1m)')} AS f1_mean, {R6('avg(simm)')} AS semantic_similarity_mean
FROM roll
""")
def eval_macro(spark, sf_dir):
    m = S.macro_average(_rollup(spark, sf_dir))
    return m.select("n_datasets", *[r6(c).alias(c) for c in
                                    ("exact_match_mean", "substring_match_mean", "f1_mean",
                                     "semantic_similarity_mean")])
