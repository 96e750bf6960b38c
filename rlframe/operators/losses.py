"""Token-level KL, policy/value losses and loss aggregation (WN-7..11, AG-4).

All per-token math is column arithmetic; reductions are grouped aggregates
(two-level for the "seq-mean" modes). ``seq`` names the sequence key
columns, ``batch`` the key of the unit the loss is reduced over (a whole
batch = no key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rlframe.operators.aggregates import EPS_MEAN


def kl_penalty(logp: str | Column, ref_logp: str | Column, kind: str = "kl") -> Column:
    """kl / abs / mse / low_var_kl (clamped to [-10, 10])."""
    lp = F.col(logp) if isinstance(logp, str) else logp
    rp = F.col(ref_logp) if isinstance(ref_logp, str) else ref_logp
    if kind == "kl":
        return lp - rp
    if kind == "abs":
        return F.abs(lp - rp)
    if kind == "mse":
        return F.lit(0.5) * (lp - rp) * (lp - rp)
    if kind == "low_var_kl":
        k = rp - lp
        return F.greatest(F.least(F.exp(k) - k - F.lit(1.0), F.lit(10.0)), F.lit(-10.0))
    raise NotImplementedError(kind)


def kl_penalised_rewards(tokens: DataFrame, seq: list[str], beta: float, kind: str = "kl",
                         score: str = "reward", logp: str = "old_logp", ref_logp: str = "ref_logp",
                         mask: str = "mask", out: str = "token_reward") -> tuple[DataFrame, DataFrame]:
    """(tokens with ``out`` = score - beta*kl*mask, one-row batch KL table).

    The batch KL is the mean over sequences of each sequence's masked mean
    KL (1e-8 in the denominator)."""
    kld = kl_penalty(logp, ref_logp, kind) * F.col(mask)
    d = tokens.withColumn("_kld", kld).withColumn(out, F.col(score) - F.lit(beta) * F.col("_kld"))
    per_seq = d.groupBy(*seq).agg((F.sum("_kld") / (F.sum(mask) + F.lit(EPS_MEAN))).alias("_skl"))
    batch = per_seq.agg(F.avg("_skl").alias("reward_kl_penalty"), F.lit(beta).alias("reward_kl_penalty_coeff"))
    return d.drop("_kld"), batch


def adaptive_kl_coef(steps: DataFrame, init_coef: float, target: float, horizon: int,
                     step: str = "step", kl: str = "kl", n: str = "n_steps") -> DataFrame:
    """Adaptive KL coefficient per training step (WN-9).

    coef_{t+1} = coef_t * (1 + clip(kl_t/target - 1, -0.2, 0.2) * n_t / horizon).
    Each step's multiplier is row-local; the running product is a sum of
    logs of magnitudes over preceding steps, its sign the parity of negative
    ones, and 0 from the first zero on. ``coef`` is the value used *at* that step.
    """
    from pyspark.sql import Window
    mult = F.lit(1.0) + F.greatest(F.least(F.col(kl) / F.lit(target) - 1, F.lit(0.2)), F.lit(-0.2)) \
        * F.col(n) / F.lit(float(horizon))
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    # a training run has one row per step (thousands), so an unpartitioned
    # running window over it is a small, bounded job
    d = steps.withColumn("_m", mult)
    size = F.sum(F.when(F.col("_m") != 0, F.log(F.abs("_m")))).over(w)
    below = F.coalesce(F.sum((F.col("_m") < 0).cast("long")).over(w), F.lit(0))
    zero = F.coalesce(F.max((F.col("_m") == 0).cast("int")).over(w), F.lit(0))
    sign = F.when(zero == 1, F.lit(0.0)).when(F.pmod(below, F.lit(2)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    return d.withColumn("coef", F.lit(init_coef) * sign * F.exp(F.coalesce(size, F.lit(0.0)))).drop("_m")


def policy_loss_terms(old_logp: str, logp: str, adv: str, clip_low: float, clip_high: float,
                      clip_c: float = 3.0) -> dict[str, Column]:
    """Per-token dual-clip PPO terms."""
    if clip_c <= 1.0:
        raise ValueError("clip_ratio_c must be > 1")
    neg_kl = F.col(logp) - F.col(old_logp)
    ratio = F.exp(neg_kl)
    a = F.col(adv)
    l1 = -a * ratio
    l2 = -a * F.greatest(F.least(ratio, F.lit(1 + clip_high)), F.lit(1 - clip_low))
    c1 = F.greatest(l1, l2)
    l3 = -a * F.lit(clip_c)
    c2 = F.least(l3, c1)
    return {
        "pg_loss_tok": F.when(a < 0, c2).otherwise(c1),
        "clipped_tok": (l2 > l1).cast("double"),
        "lower_tok": ((c1 > l3) & (a < 0)).cast("double"),
        "kl_tok": -neg_kl,
    }


def agg_loss(d: DataFrame, loss: str, mask: str, seq: list[str], batch: list[str], mode: str,
             width: str | None = None) -> DataFrame:
    """Loss aggregation modes per ``batch`` key (AG-4).

    token-mean: sum(l*m)/(sum(m)+1e-8); seq-mean-token-sum: mean of per-seq
    sums; seq-mean-token-mean: mean of sum/count (no epsilon, NaN for an
    all-masked sequence); seq-mean-token-sum-norm: sum of per-seq sums /
    width (the padded response length: max sequence length in the batch
    unless ``width`` names a column).
    """
    lm = F.col(loss) * F.col(mask)
    if mode == "token-mean":
        return d.groupBy(*batch).agg((F.sum(lm) / (F.sum(mask) + F.lit(EPS_MEAN))).alias("loss"))
    per = d.groupBy(*batch, *seq).agg(F.sum(lm).alias("_s"), F.sum(mask).cast("double").alias("_m"),
                                      F.count(F.lit(1)).alias("_len"))
    if mode == "seq-mean-token-sum":
        return per.groupBy(*batch).agg(F.avg("_s").alias("loss"))
    if mode == "seq-mean-token-mean":
        ratio = F.when(F.col("_m") == 0, F.lit(float("nan"))).otherwise(F.col("_s") / F.col("_m"))
        return per.groupBy(*batch).agg(F.avg(ratio).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        wcol = F.max("_len") if width is None else F.max(width)
        return per.groupBy(*batch).agg((F.sum("_s") / wcol).alias("loss"))
    raise ValueError(f"Invalid loss_agg_mode: {mode}")


def value_loss_terms(vpred: str, ret: str, value: str, clip: float) -> dict[str, Column]:
    vclip = F.greatest(F.least(F.col(vpred), F.col(value) + clip), F.col(value) - clip)
    l1 = (F.col(vpred) - F.col(ret)) * (F.col(vpred) - F.col(ret))
    l2 = (vclip - F.col(ret)) * (vclip - F.col(ret))
    return {"vf_tok": F.greatest(l1, l2), "vf_clipped_tok": (l2 > l1).cast("double")}


def entropy_from_logits(logits: str | Column) -> Column:
    """logsumexp(l) - sum(softmax(l) * l) for one token's logits array."""
    lg = F.col(logits) if isinstance(logits, str) else logits
    mx = F.array_max(lg)
    z = F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx))
    lse = mx + F.log(z)
    return lse - F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx) / z * x)


def logprob_of_label(logits: str | Column, label: str | Column) -> Column:
    """log softmax(logits)[label] (label is 0-based)."""
    lg = F.col(logits) if isinstance(logits, str) else logits
    lb = F.col(label) if isinstance(label, str) else label
    mx = F.array_max(lg)
    lse = mx + F.log(F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx)))
    return F.element_at(lg, (lb + 1).cast("int")) - lse
