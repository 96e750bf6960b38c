"""Masked reductions over token tables (long form: one row per token).

The reference reduces ``[batch, seq]`` tensors under a 0/1 mask. In long form
a mask is just a column, so every reduction is an ordinary aggregate with
map-side partial aggregation; nothing is padded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS_MEAN = 1e-8


def masked_sum(value: str | Column, mask: str | Column) -> Column:
    return F.sum(_c(value) * _c(mask))


def masked_mean(value: str | Column, mask: str | Column) -> Column:
    """sum(v*m) / (sum(m) + 1e-8): an all-masked group gives 0, not NULL."""
    return F.sum(_c(value) * _c(mask)) / (F.sum(_c(mask)) + F.lit(EPS_MEAN))


def global_stats(df: DataFrame, value: str, mask: str, unbiased: bool = True) -> DataFrame:
    """One-row table ``(_k, g_mean, g_var)`` of masked mean / variance.

    Variance follows the reference: mean of squared deviations under the mask
    (with the 1e-8 denominator), Bessel-corrected; a mask sum of 0 or 1 is an
    error. Computed with partial aggregates (n, sum, sum of squares around a
    shift) so it is a single pass with map-side combine.
    """
    m = F.col(mask).cast("double")
    v = F.col(value).cast("double")
    # first pass: n and mean; second pass uses the mean through a join-free
    # algebraic form: sum(m*(v-mu)^2) = sum(m*v^2) - 2 mu sum(m*v) + mu^2 sum(m)
    # which is unstable for large means; use Spark's stable moments instead.
    agg = df.where(m != 0).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(m).alias("_msum"),
        F.sum(v * m).alias("_s"),
        F.var_pop(v).alias("_vp"),
    )
    msum = F.col("_msum")
    mean = F.coalesce(F.col("_s"), F.lit(0.0)) / (F.coalesce(msum, F.lit(0.0)) + F.lit(EPS_MEAN))
    # masked_var: sum(m (v-mean)^2)/(sum(m)+eps); for 0/1 masks this equals
    # var_pop * n / (n + eps) exactly up to the eps term.
    var = F.col("_vp") * msum / (msum + F.lit(EPS_MEAN))
    if unbiased:
        bad = F.coalesce(msum, F.lit(0.0)) <= 1
        var = F.when(bad, F.raise_error(F.lit("masked_var: mask sum must be > 1"))).otherwise(
            var * msum / (msum - 1))
    return agg.select(F.lit(1).alias("_k"), mean.alias("g_mean"), var.cast("double").alias("g_var"))


def masked_whiten(df: DataFrame, value: str, mask: str, out: str,
                  shift_mean: bool = True) -> DataFrame:
    """(v - mean) * rsqrt(var + 1e-8) with batch-level masked stats.

    The stats are one row; it is joined on a constant key with a broadcast
    hint (size is one row by construction), so the big side never moves.
    """
    stats = global_stats(df, value, mask)
    w = (F.col(value) - F.col("g_mean")) / F.sqrt(F.col("g_var") + F.lit(1e-8))
    if not shift_mean:
        w = w + F.col("g_mean")
    return (df.withColumn("_k", F.lit(1))
              .join(F.broadcast(stats), "_k")
              .withColumn(out, w)
              .drop("_k", "g_mean", "g_var"))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x
