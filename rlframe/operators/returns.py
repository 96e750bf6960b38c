"""Token-level returns and advantages (WN-4, WN-5, WN-6).

Token tables are long form: ``(seq keys..., pos, reward, value, mask)``.
"agent" variants run the recurrence over action tokens only (mask = 1);
tool/user tokens are skipped -- they pass the carried value through
unchanged and receive 0 themselves. "framework" variants run over every
token. All recurrences go through :func:`reverse_linear_scan`, which splits
long or hot sequences into bounded chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlframe.operators.aggregates import masked_whiten
from rlframe.operators.scan import position_span, lead_next, reverse_linear_scan


def discounted_return(tokens: DataFrame, seq: list[str], gamma: float, pos: str = "pos",
                      reward: str = "reward", mask: str = "mask", out: str = "returns",
                      variant: str = "agent", chunk: int = 4096) -> DataFrame:
    """Discounted return G_t = r_t + gamma * G_next.

    agent: over action tokens only; non-action tokens get 0.
    framework: over all tokens, the carry is reset after a token whose mask
    is 0 (G_t = r_t + gamma * mask_{t+1} * G_{t+1}).
    """
    m = F.col(mask)
    span = position_span(tokens, pos)
    if variant == "agent":
        d = tokens.withColumn("_a", F.when(m == 1, F.lit(float(gamma))).otherwise(F.lit(1.0))) \
                  .withColumn("_bb", F.when(m == 1, F.col(reward)).otherwise(F.lit(0.0)))
        d = reverse_linear_scan(d, seq, pos, "_a", "_bb", "_g", chunk=chunk, span=span)
        return d.withColumn(out, F.when(m == 1, F.col("_g")).otherwise(F.lit(0.0))).drop("_a", "_bb", "_g")
    if variant == "framework":
        # H_t = mask_t * G_t follows H_t = mask_t r_t + gamma mask_t H_{t+1};
        # then G_t = r_t + gamma * H_{t+1}.
        d = tokens.withColumn("_a", (F.lit(float(gamma)) * m).cast("double")) \
                  .withColumn("_bb", (m * F.col(reward)).cast("double"))
        d = reverse_linear_scan(d, seq, pos, "_a", "_bb", "_h", chunk=chunk, span=span)
        d = lead_next(d, seq, pos, "_h", "_hn", chunk=chunk, span=span)
        return d.withColumn(out, F.col(reward) + F.lit(float(gamma)) * F.coalesce(F.col("_hn"), F.lit(0.0))) \
                .drop("_a", "_bb", "_h", "_hn")
    raise ValueError(variant)


def reinforce_pp(tokens: DataFrame, seq: list[str], gamma: float = 1.0, variant: str = "agent",
                 pos: str = "pos", reward: str = "reward", mask: str = "mask",
                 out: str = "advantage", returns: str = "returns", **kw) -> DataFrame:
    """REINFORCE++: discounted returns, whitened over action tokens, masked."""
    d = discounted_return(tokens, seq, gamma, pos, reward, mask, returns, variant, **kw)
    d = masked_whiten(d, returns, mask, "_w")
    return d.withColumn(out, F.col("_w") * F.col(mask)).drop("_w")


def remax(tokens: DataFrame, seq: list[str], baseline: str, pos: str = "pos",
          reward: str = "reward", mask: str = "mask", out: str = "advantage",
          returns: str = "returns", **kw) -> DataFrame:
    """ReMax: reward-to-go of masked rewards minus the sequence baseline."""
    d = tokens.withColumn("_one", F.lit(1.0)).withColumn("_bb", F.col(reward) * F.col(mask))
    d = reverse_linear_scan(d, seq, pos, "_one", "_bb", returns, **kw)
    return d.withColumn(out, F.col(returns) - F.col(baseline) * F.col(mask)).drop("_one", "_bb")


def gae(tokens: DataFrame, seq: list[str], gamma: float, lam: float, variant: str = "agent",
        pos: str = "pos", reward: str = "reward", value: str = "value", mask: str = "mask",
        out: str = "advantage", returns: str = "returns", chunk: int = 4096) -> DataFrame:
    """Generalised advantage estimation.

    delta_t = r_t + gamma * V_next - V_t ;  A_t = delta_t + gamma*lam*A_next.
    agent: "next" means the next action token (tool tokens skipped, A=0
    there); framework: the next token. returns = A + V; advantages are
    A whitened over the mask (not re-masked), as in the reference.
    """
    span = position_span(tokens, pos)
    m = F.col(mask)
    g, gl = float(gamma), float(gamma) * float(lam)
    if variant == "agent":
        # y_t = value of the first action token at or after t
        d = tokens.withColumn("_ya", F.when(m == 1, F.lit(0.0)).otherwise(F.lit(1.0))) \
                  .withColumn("_yb", F.when(m == 1, F.col(value)).otherwise(F.lit(0.0)))
        d = reverse_linear_scan(d, seq, pos, "_ya", "_yb", "_y", chunk=chunk, span=span)
        d = lead_next(d, seq, pos, "_y", "_vn", chunk=chunk, span=span)
        delta = F.col(reward) + F.lit(g) * F.coalesce(F.col("_vn"), F.lit(0.0)) - F.col(value)
        d = d.withColumn("_aa", F.when(m == 1, F.lit(gl)).otherwise(F.lit(1.0))) \
             .withColumn("_ab", F.when(m == 1, delta).otherwise(F.lit(0.0)))
        d = reverse_linear_scan(d, seq, pos, "_aa", "_ab", "_A", chunk=chunk, span=span)
        d = d.withColumn("_A", F.when(m == 1, F.col("_A")).otherwise(F.lit(0.0)))
        d = d.drop("_ya", "_yb", "_y", "_vn", "_aa", "_ab")
    elif variant == "framework":
        d = lead_next(tokens, seq, pos, value, "_vn", chunk=chunk, span=span)
        delta = F.col(reward) + F.lit(g) * F.coalesce(F.col("_vn"), F.lit(0.0)) - F.col(value)
        d = d.withColumn("_aa", F.lit(gl)).withColumn("_ab", delta)
        d = reverse_linear_scan(d, seq, pos, "_aa", "_ab", "_A", chunk=chunk, span=span)
        d = d.drop("_vn", "_aa", "_ab")
    else:
        raise ValueError(variant)
    d = d.withColumn(returns, F.col("_A") + F.col(value))
    d = masked_whiten(d, "_A", mask, out)
    return d.withColumnRenamed("_A", "raw_advantage")
