"""Group-relative advantages over rollout tables (WN-1, WN-2, WN-3, WN-15).

Group statistics are computed with ``groupBy(group).agg`` (partial
aggregation on the map side, so a hot group costs one small row per map
task) and joined back on the group key. The join, unlike a window, lets
AQE split a skewed group across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlframe.operators.aggregates import masked_whiten

EPS_STD = 1e-6


def _group_stats(df: DataFrame, group: str, score: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_gn"),
        F.avg(score).alias("_gmean"),
        F.stddev_samp(score).alias("_gstd"),
    )


def grpo_advantage(df: DataFrame, group: str = "uid", score: str = "score",
                   out: str = "advantage", norm_by_std: bool = True,
                   epsilon: float = EPS_STD) -> DataFrame:
    """(s - mean_g) / (std_g + eps); a singleton group uses mean 0, std 1.

    ``std`` is the sample (Bessel) deviation. With ``norm_by_std=False`` the
    result is ``s - mean_g`` (also 0-mean for singletons, i.e. ``s``).
    """
    st = _group_stats(df, group, score)
    single = F.col("_gn") == 1
    mean = F.when(single, F.lit(0.0)).otherwise(F.col("_gmean"))
    std = F.when(single, F.lit(1.0)).otherwise(F.col("_gstd"))
    centred = F.col(score) - mean
    adv = centred / (std + F.lit(epsilon)) if norm_by_std else centred
    return df.join(st, group).withColumn(out, adv).drop("_gn", "_gmean", "_gstd")


def rloo_advantage(df: DataFrame, group: str = "uid", score: str = "score",
                   out: str = "advantage") -> DataFrame:
    """Leave-one-out: s*n/(n-1) - mean*n/(n-1); singleton keeps s."""
    st = _group_stats(df, group, score)
    n = F.col("_gn").cast("double")
    adv = F.when(F.col("_gn") > 1,
                 F.col(score) * n / (n - 1) - F.col("_gmean") * n / (n - 1)).otherwise(F.col(score))
    return df.join(st, group).withColumn(out, adv).drop("_gn", "_gmean", "_gstd")


def sequence_scores(tokens: DataFrame, seq: list[str], reward: str = "reward",
                    mask: str = "mask", out: str = "score") -> DataFrame:
    """Outcome score of each sequence: sum(reward * mask) over its tokens."""
    return tokens.groupBy(*seq).agg(F.sum(F.col(reward) * F.col(mask)).alias(out))


def rf_baseline_whitened(tokens: DataFrame, seq: list[str], group: str,
                         reward: str = "reward", mask: str = "mask",
                         out: str = "advantage") -> DataFrame:
    """REINFORCE++-baseline: (seq score - group mean) on action tokens, then
    whitened over all action tokens of the batch (WN-3)."""
    scores = sequence_scores(tokens, seq + [group], reward, mask, "_seqscore")
    st = scores.groupBy(group).agg(F.count(F.lit(1)).alias("_gn"), F.avg("_seqscore").alias("_gmean"))
    mean = F.when(F.col("_gn") == 1, F.lit(0.0)).otherwise(F.col("_gmean"))
    per_seq = scores.join(st, group).select(*seq, (F.col("_seqscore") - mean).alias("_centred"))
    tiled = tokens.join(per_seq, seq).withColumn("_raw", F.col("_centred") * F.col(mask))
    return masked_whiten(tiled, "_raw", mask, out).drop("_centred", "_raw")


def advantage(df: DataFrame, method: str, **kw) -> DataFrame:
    """One entry point for the outcome estimators (WN-15)."""
    if method == "grpo":
        return grpo_advantage(df, **kw)
    if method in ("grpo_no_std", "dr_grpo"):
        return grpo_advantage(df, norm_by_std=False, **kw)
    if method == "rloo":
        return rloo_advantage(df, **kw)
    if method == "reinforce_plus_plus_baseline":
        return rf_baseline_whitened(df, **kw)
    from rlframe.operators import returns as R
    if method == "reinforce_plus_plus":
        return R.reinforce_pp(df, **kw)
    if method == "remax":
        return R.remax(df, **kw)
    if method == "gae":
        return R.gae(df, **kw)
    raise ValueError(f"unknown advantage estimator {method!r}")
