"""Process rewards, preference losses, token-level reward placement and
multi-response evaluation (WN-12..18, SC-22..27).

Group statistics are aggregates joined back on the group key; no pair of
samples is ever materialised (peer means come from per-label / cumulative
per-accuracy sums inside the group).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType

from rlframe.operators.aggregates import masked_whiten
from rlframe.operators.scan import reverse_linear_scan


def last_token_reward(tokens: DataFrame, seq: list[str], pos: str, score: str, out: str = "token_reward",
                      rm_score: str | None = None) -> DataFrame:
    """SC-22: the sequence score sits on its last token, 0 elsewhere; an
    existing model score column passes through unchanged."""
    last = tokens.groupBy(*seq).agg(F.max(pos).alias("_last"))
    d = tokens.join(last, seq)
    placed = F.when(F.col(pos) == F.col("_last"), F.col(score)).otherwise(F.lit(0.0))
    if rm_score is not None:
        placed = F.coalesce(F.col(rm_score), placed)
    return d.withColumn(out, placed).drop("_last")


def process_rloo(tokens: DataFrame, seq: list[str], group: str, pos: str, mask: str,
                 rm_score: str | None, acc: str | None, rm_coef: float = 1.0, gt_coef: float = 5.0,
                 out_adv: str = "advantage", out_ret: str = "returns") -> DataFrame:
    """WN-12: leave-one-out per reward source, weighted sum, reward-to-go,
    whitened over the response mask.

    For a source, each sequence's mean over its reward positions is taken;
    the baseline is the group's sum of those means / (n - 1) and every
    reward position becomes r * n/(n-1) - baseline (a group of one keeps r).
    The ground-truth source places ``acc`` on the last valid token only."""
    d = tokens
    parts = []
    if rm_score is not None:
        d = d.withColumn("_r_rm", F.when(F.col(mask) == 1, F.col(rm_score)).otherwise(F.lit(0.0))) \
             .withColumn("_m_rm", F.col(mask) == 1)
        parts.append(("_r_rm", "_m_rm", rm_coef))
    if acc is not None:
        last = d.where(F.col(mask) == 1).groupBy(*seq).agg(F.max(pos).alias("_lastv"))
        d = d.join(last, seq, "left")
        d = d.withColumn("_m_gt", F.col(pos) == F.col("_lastv")) \
             .withColumn("_r_gt", F.when(F.col("_m_gt"), F.col(acc).cast("double")).otherwise(F.lit(0.0))).drop("_lastv")
        parts.append(("_r_gt", "_m_gt", gt_coef))
    total = F.lit(0.0)
    for r, m, coef in parts:
        seq_mean = d.where(F.col(m)).groupBy(*seq, group).agg(F.avg(r).alias("_sm"))
        grp = seq_mean.groupBy(group).agg(F.sum("_sm").alias("_gs"), F.count(F.lit(1)).alias("_gn"))
        d = d.join(grp, group, "left")
        n = F.col("_gn").cast("double")
        # a singleton group keeps its reward (the reference divides by n - 1 = 0)
        rl = F.when(F.col(m) & (F.col("_gn") > 1), F.col(r) * n / (n - 1) - F.col("_gs") / (n - 1)) \
            .when(F.col(m), F.col(r)).otherwise(F.lit(0.0))
        d = d.withColumn(f"{r}_l", rl).drop("_gs", "_gn")
        total = total + F.lit(coef) * F.col(f"{r}_l")
    d = d.withColumn("_final", total * F.col(mask))
    d = d.withColumn("_one", F.lit(1.0))
    d = reverse_linear_scan(d, seq, pos, "_one", "_final", out_ret)
    d = masked_whiten(d, out_ret, mask, out_adv)
    return d.drop(*[c for c in d.columns if c.startswith("_")])


def implicit_process_reward(tokens: DataFrame, seq: list[str], pos: str, logp: str, ref_logp: str,
                            acc: str | None, beta: float, lam: float, granularity: str = "token",
                            use_gt: bool = True, out: str = "token_score") -> DataFrame:
    """WN-18: q = logp - ref_logp. lam = 0: r = beta*q. Otherwise the last
    valid token's beta*q is replaced by acc - sum(earlier beta*q) and
    r_t = beta*q_t + lam * r_{t+1}. Token granularity writes r to every
    valid token except the last (as the reference's slice does); "whole"
    puts the sum of r on the last token."""
    last = tokens.groupBy(*seq).agg(F.max(pos).alias("_last"),
                                    F.sum(F.lit(beta) * (F.col(logp) - F.col(ref_logp))).alias("_tot"))
    d = tokens.join(last, seq).withColumn("_q", F.lit(beta) * (F.col(logp) - F.col(ref_logp)))
    if lam == 0.0:
        d = d.withColumn("_r", F.col("_q"))
    else:
        if use_gt and acc is not None:
            earlier = F.col("_tot") - F.col("_q")
            d = d.withColumn("_q", F.when(F.col(pos) == F.col("_last"), F.col(acc).cast("double") - earlier)
                             .otherwise(F.col("_q")))
        d = d.withColumn("_lam", F.lit(float(lam)))
        d = reverse_linear_scan(d, seq, pos, "_lam", "_q", "_r")
    if granularity == "token":
        d = d.withColumn(out, F.when(F.col(pos) < F.col("_last"), F.col("_r")).otherwise(F.lit(0.0)))
    elif granularity == "whole":
        s = d.groupBy(*seq).agg(F.sum("_r").alias("_rs"))
        d = d.join(s, seq).withColumn(out, F.when(F.col(pos) == F.col("_last"), F.col("_rs")).otherwise(F.lit(0.0)))
    else:
        raise NotImplementedError(granularity)
    return d.drop(*[c for c in d.columns if c.startswith("_")])


def ce_preference_loss(seqs: DataFrame, q: str, acc: str, beta: float) -> DataFrame:
    """WN-13 (CE): binary cross-entropy of sigmoid(beta * sum q) vs acc."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(beta) * F.col(q)))
    # torch clamps log terms at -100
    lp = F.greatest(F.log(p), F.lit(-100.0))
    l1p = F.greatest(F.log(F.lit(1.0) - p), F.lit(-100.0))
    bce = -(F.col(acc) * lp + (F.lit(1.0) - F.col(acc)) * l1p)
    return seqs.agg(F.avg(bce).alias("ce_loss"))


def detach_preference_loss(seqs: DataFrame, group: str, q: str, acc: str, beta: float,
                           bon_mode: str = "none") -> DataFrame:
    """WN-13 (contrast): each sample is compared with the mean Q of its
    group's peers on the other side of its accuracy (lower accuracy for a
    positive sample, higher for the rest). Best-of-n weights n P^(n-1) optional:
    P is the share of the group whose accuracy (``bon_acc``) or scaled Q
    (``bon_rm``) is not above the sample's; weighted losses are summed.

    Peer sums come from cumulative sums over the group's accuracy levels
    (a window over at most n rows per group), not from pairs."""
    lv = seqs.groupBy(group, acc).agg(F.sum(q).alias("_qs"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group).orderBy(acc).rowsBetween(Window.unboundedPreceding, 0)
    lv = (lv.withColumn("_cq", F.sum("_qs").over(w)).withColumn("_cc", F.sum("_c").over(w))
            .withColumn("_tq", F.sum("_qs").over(Window.partitionBy(group)))
            .withColumn("_tc", F.sum("_c").over(Window.partitionBy(group))))
    d = seqs.join(lv.select(group, acc, "_qs", "_c", "_cq", "_cc", "_tq", "_tc"), [group, acc])
    lower_q, lower_c = F.col("_cq") - F.col("_qs"), F.col("_cc") - F.col("_c")
    higher_q, higher_c = F.col("_tq") - F.col("_cq"), F.col("_tc") - F.col("_cc")
    pos = F.col(acc) > 0
    chosen_q = F.when(pos, lower_q).otherwise(higher_q)
    chosen_c = F.when(pos, lower_c).otherwise(higher_c)
    other = F.when(chosen_c > 0, chosen_q / chosen_c * F.lit(beta)).otherwise(F.lit(0.0))
    cur = F.col(q) * F.lit(beta)
    sign = F.when(pos, F.lit(1.0)).otherwise(F.lit(-1.0))
    z = (cur - other) * sign
    loss = F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))  # -log sigmoid(z), no underflow
    d = d.withColumn("_loss", loss)
    if bon_mode == "none":
        return d.agg(F.avg("_loss").alias("dpo_loss"))
    if bon_mode == "bon_acc":
        n = F.col("_tc").cast("double")
        weight = n * F.pow(F.col("_cc") / n, n - 1)
        return d.agg(F.sum(F.col("_loss") * weight).alias("dpo_loss"))
    if bon_mode == "bon_rm":
        # share of the group whose scaled Q does not exceed the sample's own,
        # from the histogram of values: equal ones are one row
        hist = seqs.groupBy(group, F.col(q).alias("_v")).agg(F.count(F.lit(1)).alias("_vc"))
        upto = Window.partitionBy(group).orderBy(F.col("_v") * F.lit(beta)).rangeBetween(Window.unboundedPreceding, 0)
        hist = hist.select(F.col(group).alias("_vg"), "_v", F.sum("_vc").over(upto).alias("_upto"))
        d = d.join(hist, F.col(group).eqNullSafe(F.col("_vg")) & (F.col(q) == F.col("_v")))
        n = F.col("_tc").cast("double")
        return d.agg(F.sum(F.col("_loss") * n * F.pow(F.col("_upto") / n, n - 1)).alias("dpo_loss"))
    raise ValueError(f"unknown bon_mode {bon_mode!r}")


def sq_logratio_loss(tokens: DataFrame, seq: list[str], logp: str, old_logp: str, mask: str,
                     reward: str, eta: float) -> DataFrame:
    """WN-14: mean over sequences of (sum logp - sum old_logp - eta * r)^2
    (log-probs summed over the mask; r is the sequence's reward)."""
    s = tokens.groupBy(*seq).agg(
        F.sum(F.col(logp) * F.col(mask)).alias("_lp"), F.sum(F.col(old_logp) * F.col(mask)).alias("_olp"),
        F.first(reward).alias("_r"))
    return s.agg(F.avg(F.pow(F.col("_lp") - F.col("_olp") - F.lit(eta) * F.col("_r"), 2)).alias("sppo_loss"))


def seeded_sample(df: DataFrame, cols: list[str], n: int, seed: int) -> DataFrame:
    """WN-16: a seeded, order-independent sample of ``n`` rows (top-n by a
    hash of the row and the seed -- the limit is the feature)."""
    h = F.md5(F.concat_ws("\u001f", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
    return df.withColumn("_h", h).orderBy("_h", *cols).limit(n).drop("_h")


def multi_response_eval(df: DataFrame, source: str, responses: str, scorer) -> DataFrame:
    """SC-24: score every response, average per row, then per source
    (``test_score/<source>``): a two-level mean."""
    # the row id is fixed before the explode so every response of a row
    # shares it (an id computed next to the generator is per output row)
    keyed = df.select(F.monotonically_increasing_id().alias("_row"), source, responses)
    ex = keyed.select("_row", source, F.posexplode(responses).alias("_i", "_resp"))
    ex = ex.withColumn("_s", scorer(F.col("_resp")).cast("double"))
    per_row = ex.groupBy("_row", source).agg(F.avg("_s").alias("_m"))
    return per_row.groupBy(source).agg(F.avg("_m").alias("test_score")).select(
        F.concat(F.lit("test_score/"), F.col(source)).alias("metric"), "test_score")


def python_scorer(fn, return_type: DataType = DoubleType(), default: float = 0.0):
    """SC-25/SC-26: wrap a user's row scorer ``fn(*values) -> float`` as an
    Arrow-batched pandas UDF over a struct of the given columns; a failing
    row scores ``default``. Returns ``f(*cols) -> Column``."""

    @F.pandas_udf(return_type)
    def udf(batch: pd.DataFrame) -> pd.Series:
        out = []
        for vals in batch.itertuples(index=False, name=None):
            try:
                out.append(float(fn(*vals)))
            except Exception:  # noqa: BLE001 -- the reference scores failures as 0
                out.append(default)
        return pd.Series(out, dtype="float64")

    def apply(*cols):
        return udf(F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols]))
    return apply


def batched_scorer(fn, return_type: DataType = DoubleType()):
    """SC-27: a user's batched scorer (lists in, list out) as a pandas UDF.
    Returns ``f(*cols) -> Column``."""

    @F.pandas_udf(return_type)
    def udf(batch: pd.DataFrame) -> pd.Series:
        return pd.Series(fn(*[batch[c].tolist() for c in batch.columns]), dtype="float64")

    def apply(*cols):
        return udf(F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols]))
    return apply


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))



def resubmit_rewards(df: DataFrame, sample: str, turn: str, score: str, out: str = "tool_reward",
                     penalty: float = -0.05) -> DataFrame:
    """SC-28: 0 when a turn's score beats the previous turn's (the first turn
    compares with 0), else ``penalty`` -- compared with the last score, not
    the best, so right -> wrong -> right earns 0, penalty, 0. A sample's
    turns are bounded by the turn limit."""
    w = Window.partitionBy(sample).orderBy(turn)
    prev = F.lag(score, 1, 0.0).over(w)
    return df.withColumn(out, F.when(F.col(score) > prev, F.lit(0.0)).otherwise(F.lit(penalty)))
