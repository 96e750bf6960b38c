"""Scoring jobs: predictions x gold answers on whole texts (SC-1..11).

Per-pair token statistics are computed as Spark jobs, not per-row loops:
texts are normalised once per prediction and once per gold, exploded into
(token, count) rows, and joined on ``(join key, token)``. A long text's
tokens therefore spread over many tasks, and a gold shared by many
predictions is tokenised once.

Predictions are many and golds usually few: predictions are brought together by
their key once, before their tokens are exploded, and golds of up to
``FEW_GOLD_CHARS`` characters go to every task instead of being joined by a shuffle.

Join keys: ``on`` columns are present in both tables (e.g. ``dataset`` when
golds are shared per dataset, or ``data_id`` when each prediction has its
own list).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlframe.functions import text as T

IDF_ONE_SIDED = 1.0 + math.log(1.5)   # smooth idf for a term in 1 of 2 docs

#: Golds of no more characters in all are broadcast; more are joined by a shuffle.
FEW_GOLD_CHARS = 4_000_000


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back
    (cuts lineage; a lost executor re-reads instead of recomputing)."""
    from rlframe.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _few(golds: DataFrame, gold: str) -> bool:
    """Whether the golds and their token counts fit a broadcast."""
    return (golds.agg(F.sum(F.length(F.col(gold)) + 1)).first()[0] or 0) <= FEW_GOLD_CHARS


def _token_counts(df: DataFrame, key: list[str], tokens_col) -> DataFrame:
    return (df.select(*key, F.explode(tokens_col).alias("tok"))
              .groupBy(*key, "tok").agg(F.count(F.lit(1)).alias("cnt")))


def pair_scores(preds: DataFrame, golds: DataFrame, pred_key: list[str], gold_key: list[str],
                on: list[str], pred: str = "pred", gold: str = "gold",
                with_tfidf: bool = True) -> DataFrame:
    """One row per (prediction, gold) with em, sm_eval, sm_reward, f1_eval,
    f1_reward, jaccard and (optionally) tfidf cosine."""
    pk = list(dict.fromkeys(pred_key + on))
    gk = list(dict.fromkeys(gold_key + on))
    P = preds.select(*pk, T.normalize_answer(pred).alias("np"), T.is_blank(pred).alias("pblank"))
    G = golds.select(*gk, T.normalize_answer(gold).alias("ng"), T.is_blank(gold).alias("gblank"))
    # normalisation is the expensive step and both tables feed several
    # branches (strings for EM/SM, token counts for F1/Jaccard, words for
    # TF-IDF): materialise each once in the shared checkpoint folder
    P = materialize(P.withColumn("ptoks", T.tokens("np")))
    G = materialize(G.withColumn("gtoks", T.tokens("ng")))

    few = _few(G, "ng")
    small = F.broadcast if few else (lambda df: df)
    # what needs both texts is taken here, so that no text goes into the joins by pair
    pairs = P.select(*pk, "np", "pblank", F.size("ptoks").alias("n_p"),
                     F.size(F.array_distinct("ptoks")).alias("d_p")).join(
            small(G.select(*gk, "ng", "gblank", F.size("gtoks").alias("n_g"),
                           F.size(F.array_distinct("gtoks")).alias("d_g"))), on) \
        .select(*dict.fromkeys(pk + gk), "pblank", "gblank", "n_p", "d_p", "n_g", "d_g",
                (F.col("np") == F.col("ng")).cast("double").alias("em"),
                T.eval_substring(F.col("np"), F.col("ng")).alias("sm_eval"),
                (F.instr(F.col("np"), F.col("ng")) > 0).cast("double").alias("sm_reward"))

    pc = _token_counts(P.select(*pk, "ptoks").repartition(*pk), pk, "ptoks").withColumnRenamed("cnt", "cp")
    gc = small(_token_counts(G, gk, "gtoks").withColumnRenamed("cnt", "cg"))
    both_key = list(dict.fromkeys(pk + gk))
    common = (pc.join(gc, on + ["tok"])
                .groupBy(*both_key)
                .agg(F.sum(F.least("cp", "cg")).alias("common"),
                     F.count(F.lit(1)).alias("inter")))
    out = pairs.join(common, both_key, "left").fillna(0, ["common", "inter"])

    common_d = F.col("common").cast("double")
    n_p, n_g = F.col("n_p").cast("double"), F.col("n_g").cast("double")
    union = (F.col("d_p") + F.col("d_g") - F.col("inter")).cast("double")
    jac = F.when(F.col("pblank") | F.col("gblank") | (F.col("d_p") == 0) | (F.col("d_g") == 0),
                 F.lit(1.0)).otherwise(F.col("inter") / union)
    out = out.select(
        *both_key, "em", "sm_eval", "sm_reward",
        T.f1_from_counts(common_d, n_p, n_g, True).alias("f1_eval"),
        T.f1_from_counts(common_d, n_p, n_g, False).alias("f1_reward"),
        jac.alias("jaccard"),
        "pblank", "gblank",
    )
    if with_tfidf:
        out = out.join(_tfidf(preds.select(*pk, F.col(pred).alias("_praw")),
                              golds.select(*gk, F.col(gold).alias("_graw")), pk, gk, on, few), both_key, "left")
        out = out.withColumn("tfidf", F.when(F.col("pblank") | F.col("gblank"), F.lit(1.0))
                             .otherwise(F.coalesce(F.col("tfidf"), F.lit(1.0))))
    return out.drop("pblank", "gblank")


def tfidf_pair_scores(preds: DataFrame, golds: DataFrame, pred_key: list[str], gold_key: list[str],
                      on: list[str], pred: str = "pred", gold: str = "gold") -> DataFrame:
    """TF-IDF cosine only (no normalisation pass): blank side -> 1."""
    pk = list(dict.fromkeys(pred_key + on))
    gk = list(dict.fromkeys(gold_key + on))
    both_key = list(dict.fromkeys(pk + gk))
    few = _few(golds, gold)
    small = F.broadcast if few else (lambda df: df)
    t = _tfidf(preds.select(*pk, F.col(pred).alias("_praw")), golds.select(*gk, F.col(gold).alias("_graw")),
               pk, gk, on, few)
    blanks = preds.select(*pk, T.is_blank(pred).alias("pblank")).join(
        small(golds.select(*gk, T.is_blank(gold).alias("gblank"))), on)
    out = blanks.join(t, both_key, "left")
    return out.select(*both_key, F.when(F.col("pblank") | F.col("gblank"), F.lit(1.0))
                      .otherwise(F.coalesce(F.col("tfidf"), F.lit(1.0))).alias("tfidf"))


def _tfidf(P: DataFrame, G: DataFrame, pk, gk, on, few: bool) -> DataFrame:
    """Cosine of smooth-idf TF-IDF vectors fitted on the pair only.

    idf = 1 for a word in both texts, 1+ln(1.5) for a word in one. With
    S = sum of squared counts, the squared norm of a side is
    k^2 * S_all - (k^2 - 1) * S_shared (k = one-sided idf); the dot product
    runs over shared words only. Empty vocabulary -> NULL (caller maps to 1).
    """
    k2 = IDF_ONE_SIDED ** 2
    small = F.broadcast if few else (lambda df: df)
    pw = _token_counts(P.repartition(*pk), pk, T.tfidf_words("_praw")).withColumnRenamed("cnt", "a")
    gw = _token_counts(G, gk, T.tfidf_words("_graw")).withColumnRenamed("cnt", "b")
    pn = pw.groupBy(*pk).agg(F.sum(F.col("a") * F.col("a")).alias("sa"))
    gn = gw.groupBy(*gk).agg(F.sum(F.col("b") * F.col("b")).alias("sb"))
    both_key = list(dict.fromkeys(pk + gk))
    shared = (pw.join(small(gw), on + ["tok"]).groupBy(*both_key).agg(
        F.sum(F.col("a") * F.col("b")).alias("dot"),
        F.sum(F.col("a") * F.col("a")).alias("sa_sh"),
        F.sum(F.col("b") * F.col("b")).alias("sb_sh")))
    pairs = P.select(*pk).join(small(G.select(*gk)), on)
    t = (pairs.join(pn, pk, "left").join(gn, gk, "left").join(shared, both_key, "left")
              .fillna(0, ["sa", "sb", "dot", "sa_sh", "sb_sh"]))
    na = F.sqrt(F.lit(k2) * F.col("sa") - F.lit(k2 - 1.0) * F.col("sa_sh"))
    nb = F.sqrt(F.lit(k2) * F.col("sb") - F.lit(k2 - 1.0) * F.col("sb_sh"))
    cos = (F.when((F.col("sa") == 0) & (F.col("sb") == 0), F.lit(None).cast("double"))
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .otherwise(F.col("dot") / (na * nb)))
    return t.select(*both_key, cos.alias("tfidf"))


def best_per_prediction(scores: DataFrame, pred_key: list[str],
                        metrics=("em", "sm_eval", "f1_eval", "jaccard", "tfidf")) -> DataFrame:
    """Max over golds, per metric independently (EM and F1 may come from
    different golds, as in the reference)."""
    have = [m for m in metrics if m in scores.columns]
    return scores.groupBy(*pred_key).agg(*[F.max(m).alias(m) for m in have])


def dataset_rollup(preds: DataFrame, best: DataFrame, pred_key: list[str], dataset: str,
                   similarity: str | None = "jaccard") -> DataFrame:
    """Per-dataset count, EM/SM mean+sum, F1 mean, similarity mean.

    Predictions without any gold still count and score 0 everywhere.
    """
    d = preds.select(*pred_key, dataset).join(best, pred_key, "left").fillna(0.0)
    aggs = [
        F.count(F.lit(1)).alias("count"),
        F.avg("em").alias("exact_match_mean"),
        F.sum("em").cast("bigint").alias("exact_match_sum"),
        F.avg("sm_eval").alias("substring_match_mean"),
        F.sum("sm_eval").cast("bigint").alias("substring_match_sum"),
        F.avg("f1_eval").alias("f1_mean"),
    ]
    if similarity:
        aggs.append(F.avg(similarity).alias("semantic_similarity_mean"))
    return d.groupBy(dataset).agg(*aggs)


def macro_average(rollup: DataFrame) -> DataFrame:
    """Cross-dataset (unweighted) mean of the per-dataset means."""
    cols = [c for c in ("exact_match_mean", "substring_match_mean", "f1_mean",
                        "semantic_similarity_mean") if c in rollup.columns]
    return rollup.agg(F.count(F.lit(1)).alias("n_datasets"), *[F.avg(c).alias(c) for c in cols])
