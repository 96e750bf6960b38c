"""Training and validation metrics (AG-5..18, AR-7).

Metric tables are long form ``(…keys, metric, value)`` so they can be
filtered, joined and written like any other table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rlframe.operators.voting import majority_moments


def _long(row: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """Unpivot metric columns into (metric, value)."""
    keys = keys or []
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value"))
                                for n in names]))
    return row.select(*keys, stack.alias("_m")).select(*keys, "_m.metric", "_m.value")


#: Fixed names: the substring-match column is logged as ``sim``.
SCORE_NAMES = {"sm": "sim"}


def batch_metrics(seqs: DataFrame, tokens: DataFrame, seq: list[str], max_prompt_length: int,
                  use_critic: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """AG-5: score/reward/advantage/return/value stats, explained variance,
    turns and length metrics. ``seqs`` has one row per sequence with
    ``score``, ``reward``, ``turns``, ``prompt_length``, ``response_length``
    (+ ``extra`` columns such as em/f1/sm/format); ``tokens`` has the valid
    response tokens with ``advantage``, ``returns``, ``value``.
    The padded response width is the longest response in the batch."""
    s = seqs.agg(
        *[f(c).alias(f"{n}/{fn}") for c, n in (("score", "critic/score"), ("reward", "critic/rewards"))
          for f, fn in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))],
        F.avg("turns").alias("turns/mean"), F.max("turns").alias("turns/max"), F.min("turns").alias("turns/min"),
        F.avg("response_length").alias("response_length/mean"),
        F.max("response_length").alias("response_length/max"),
        F.min("response_length").alias("response_length/min"),
        F.max("response_length").alias("_rmax"),
        F.avg("prompt_length").alias("prompt_length/mean"),
        F.max("prompt_length").alias("prompt_length/max"),
        F.min("prompt_length").alias("prompt_length/min"),
        F.avg((F.col("prompt_length") == max_prompt_length).cast("double")).alias("prompt_length/clip_ratio"),
        *[f(c).alias(f"critic/{SCORE_NAMES.get(c, c)}/{fn}") for c in extra for f, fn in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))],
    )
    rclip = seqs.join(s.select("_rmax"), F.col("response_length") == F.col("_rmax"), "left") \
        .agg((F.count("_rmax") / F.count(F.lit(1))).alias("response_length/clip_ratio"))
    tk_aggs = [
        F.avg("advantage").alias("critic/advantages/mean"), F.max("advantage").alias("critic/advantages/max"),
        F.min("advantage").alias("critic/advantages/min"),
        F.avg("returns").alias("critic/returns/mean"), F.max("returns").alias("critic/returns/max"),
        F.min("returns").alias("critic/returns/min"),
    ]
    if use_critic:
        tk_aggs += [F.avg("value").alias("critic/values/mean"), F.max("value").alias("critic/values/max"),
                    F.min("value").alias("critic/values/min"),
                    (F.lit(1.0) - F.var_samp(F.col("returns") - F.col("value"))
                     / (F.var_samp("returns") + F.lit(1e-5))).alias("critic/vf_explained_var")]
    t = tokens.agg(*tk_aggs)
    row = s.drop("_rmax").withColumn("_k", F.lit(1)) \
        .join(F.broadcast(rclip.withColumn("_k", F.lit(1))), "_k") \
        .join(F.broadcast(t.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return _long(row, row.columns)


def process_reward_metrics(tokens: DataFrame, reward: str = "process_reward", mask: str = "mask") -> DataFrame:
    """AG-5: mean, max, min and count of the non-zero process rewards of valid
    tokens; all 0 if there are none. Nulls count as zero."""
    x = F.when((F.col(mask) != 0) & (F.col(reward) != 0), F.col(reward).cast("double"))
    row = tokens.agg(*[F.coalesce(f(x), F.lit(0.0)).cast("double").alias(f"critic/process_rewards/{n}")
                       for f, n in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"), (F.count, "count"))])
    return _long(row, row.columns)


def throughput_metrics(steps: DataFrame, tokens: str = "n_tokens", seconds: str = "seconds", n_devices: int = 1,
                       keys: list[str] | None = None) -> DataFrame:
    """AG-7: tokens, time and tokens per second and device, for each row of
    ``steps`` (named by ``keys``). A step without time has no throughput (NULL)."""
    rate = F.when(F.col(seconds) > 0, F.col(tokens) / (F.col(seconds) * n_devices))
    row = steps.select(*(keys or []), F.col(tokens).alias("perf/total_num_tokens"), F.col(seconds).alias("perf/time_per_step"),
                       rate.alias("perf/throughput"))
    return _long(row, row.columns[len(keys or []):], keys)


# ------------------------------------------------------------ validation
_DRAWN = ("best_mean", "best_std", "worst_mean", "worst_std")


def _draw_sums(batches):
    """Sums over prompts of the moments of best@k and worst@k, for k = 1, 2, 4,
    ... < N and N, by (source, var, k, N if k is 1).

    Rows are the values of one prompt after another in rising order: ``_c``
    samples with the value ``_x`` above the smallest, ``_hi`` up to it. They are
    added up as they come: of a prompt that goes on, a row of sums per k is held."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        c, hi, n, base, x = (batch.column(name).to_numpy() for name in ("_c", "_hi", "_n", "_base", "_x"))
        begin = np.flatnonzero(hi == c)
        goes_on = len(begin) == 0 or begin[0] > 0
        if goes_on:
            begin = np.concatenate([[0], begin])
        if held is not None and not goes_on:
            yield from _over_prompts(*held)
            held = None
        sums = np.zeros((len(begin), 2 + int(np.log2(n.max())), 4))
        lo, total = hi - c, n.astype(np.float64)
        prompt = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(c))))
        rows, at = np.arange(len(c)), begin
        with np.errstate(all="ignore"):
            for j in range(sums.shape[1]):
                k = np.minimum(1 << min(j, 62), n[rows]).astype(np.float64)
                share = lambda y: np.power(y[rows] / total[rows], k)  # noqa: B023, E731
                most, least = share(hi) - share(lo), share(n - lo) - share(n - hi)
                v = x[rows]
                terms = np.column_stack([v * most, v * v * most, v * least, v * v * least])
                sums[prompt[rows[at]], j] = np.add.reduceat(terms, at)
                rows = rows[n[rows] > 1 << min(j, 62)] if j < 62 else rows[:0]
                if len(rows) == 0:
                    break
                at = np.flatnonzero(np.diff(prompt[rows], prepend=-1))
        if goes_on and held is not None:
            deep = min(sums.shape[1], held[1].shape[1])
            sums[0, :deep] += held[1][0, :deep]
        keys = batch.select(["_source", "_var"])
        if len(begin) > 1:
            yield from _over_prompts(keys.take(pa.array(begin[:-1])), sums[:-1], n[begin[:-1]], base[begin[:-1]])
        last = begin[-1:]
        held = (keys.take(pa.array(last)), sums[-1:], n[last], base[last])
    if held is not None:
        yield from _over_prompts(*held)


def _over_prompts(keys, sums, n, base):
    top = np.where(n > 1, np.ceil(np.log2(np.maximum(n, 2))), 0).astype(np.int64)  # the place of k = N
    prompt, j = np.nonzero(np.arange(sums.shape[1]) <= top[:, None])
    k = np.minimum(np.left_shift(1, np.minimum(j, 62)), n[prompt])
    b1, b2, w1, w2 = sums[prompt, j].T
    with np.errstate(all="ignore"):
        moments = (base[prompt] + b1, np.sqrt(np.maximum(b2 - b1 * b1, 0.0)),
                   base[prompt] + w1, np.sqrt(np.maximum(w2 - w1 * w1, 0.0)))
    rows = pa.Table.from_batches([keys.take(pa.array(prompt))]).append_column("_k", pa.array(k)) \
        .append_column("_of", pa.array(n[prompt], mask=j > 0)).append_column("_prompts", pa.array(np.ones(len(k), np.int64)))
    for name, value in zip(_DRAWN, moments):
        rows = rows.append_column(name, pa.array(value))
    added = ["_prompts", *_DRAWN]
    yield from rows.group_by(["_source", "_var", "_k", "_of"]).aggregate([(name, "sum") for name in added]) \
        .select(["_source", "_var", "_k", "_of", *[f"{name}_sum" for name in added]]) \
        .rename_columns(["_source", "_var", "_k", "_of", *added]).combine_chunks().to_batches()


def validation_metrics(long: DataFrame, source: str = "data_source", prompt: str = "prompt",
                       var: str = "var", value: str = "value", vote: str | None = None) -> DataFrame:
    """AG-9..11: per (source, prompt, var) mean@N, std@N (population) and, for
    n = 2, 4, ... < N and N, mean and std of best@n and worst@n, and of maj@n
    if ``vote`` names a column; then the mean over prompts per (source, var, metric).

    All are exact expectations over n draws with replacement, no random stream:
    P(max <= x_(i)) = (i/N)^n, so E[max] = sum_i x_(i) ((i/N)^n - ((i-1)/N)^n),
    from the histogram of values per group (ties collapse); n = 1 gives mean and
    std. The law of the majority vote is in :mod:`rlframe.operators.voting`.
    Values are measured from the group's smallest, so a std of close values
    far from 0 keeps its digits. Null values are left out."""
    g = [source, prompt, var]
    hist = long.where(F.col(value).isNotNull()).groupBy(*g, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*g).orderBy("_v")
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    all_ = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hist = hist.select(*g, "_c", F.sum("_c").over(upto).alias("_hi"), F.sum("_c").over(all_).alias("_n"),
                       F.first("_v").over(all_).alias("_base"), "_v")
    # means over prompts first, names on the few rows that are left
    marked = hist.select(F.col(source).alias("_source"), F.col(var).alias("_var"), "_c", "_hi", "_n", "_base",
                         (F.col("_v") - F.col("_base")).alias("_x"))
    kinds = StructType([marked.schema["_source"], marked.schema["_var"]])
    for name, kind in (("_k", "long"), ("_of", "long"), ("_prompts", "long"), *((c, "double") for c in _DRAWN)):
        kinds = kinds.add(name, kind)
    mean = marked.mapInArrow(_draw_sums, kinds).groupBy(F.col("_source").alias(source), F.col("_var").alias(var), "_k", "_of") \
        .agg(*[(F.sum(c) / F.sum("_prompts")).alias(c) for c in _DRAWN])
    one = F.col("_k") == 1
    named = lambda kind, n, stat, x: F.struct(F.concat(F.lit(kind), n.cast("string"), F.lit(stat)).alias("metric"), F.col(x).alias("value"))
    k = F.col("_k")
    rows = F.when(one & (F.col("_of") > 1), F.array(named("mean@", F.col("_of"), "", "best_mean"), named("std@", F.col("_of"), "", "best_std"))) \
        .when(one, F.array(named("mean@", F.col("_of"), "", "best_mean"))) \
        .otherwise(F.array(*[named(f"{kind}@", k, f"/{stat}", f"{kind}_{stat}") for kind in ("best", "worst") for stat in ("mean", "std")]))
    out = mean.select(source, var, F.explode(rows).alias("_m")).select(source, var, "_m.metric", "_m.value")
    if vote is None:
        return out
    maj = majority_moments(long.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double")),
                           [source, prompt], var, vote, value)
    maj = maj.groupBy(source, var, "n").agg(F.avg("maj_mean").alias("mean"), F.avg("maj_std").alias("std"))
    both = F.explode(F.array(*[named("maj@", F.col("n"), f"/{stat}", stat) for stat in ("mean", "std")]))
    return out.unionByName(maj.select(source, var, both.alias("_m")).select(source, var, "_m.metric", "_m.value"))


def majority_vote(df: DataFrame, group: list[str], vote: str, val: str, order: str) -> DataFrame:
    """AG-11 on the full sample: the vote class with most members (ties ->
    class seen first), valued by its first member (by ``order``)."""
    cls = df.groupBy(*group, vote).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"),
                                       F.min_by(val, order).alias("_v"))
    rank = F.struct(F.col("_n"), (-F.col("_first")).alias("_f"))
    return cls.groupBy(*group).agg(F.max_by(F.col(vote), rank).alias("maj_vote"),
                                   F.max_by(F.col("_v"), rank).alias("maj_value"))


def metric_labels(metrics: DataFrame, source: str = "data_source", var: str = "var") -> DataFrame:
    """AG-12: val-core for the core variable (acc if present, else reward)
    and mean/maj/best metrics at the largest n; everything else val-aux."""
    has_acc = metrics.groupBy(source).agg(F.max((F.col(var) == "acc").cast("int")).alias("_acc"))
    n_of = F.regexp_extract("metric", r"@(\d+)", 1).cast("long")
    d = metrics.join(has_acc, source).withColumn("_n", n_of)
    nmax = d.groupBy(source, var).agg(F.max("_n").alias("_nmax"))
    d = d.join(nmax, [source, var])
    core_var = F.when(F.col("_acc") == 1, F.lit("acc")).otherwise(F.lit("reward"))
    core = ((F.col(var) == core_var) & F.col("metric").rlike(r"^(mean|maj|best)")
            & (F.col("_n") == F.col("_nmax")))
    sec = F.when(core, F.lit("val-core")).otherwise(F.lit("val-aux"))
    return d.select(F.concat_ws("/", sec, F.col(source), F.col(var), F.col("metric")).alias("name"), "value")


def sign_agreement(df: DataFrame, score: str, acc: str) -> DataFrame:
    """AG-15: mean of sign(score) == sign(2*acc - 1)."""
    return df.agg(F.avg((F.signum(score) == F.signum(F.col(acc) * 2 - 1)).cast("double")).alias("abs_acc"))


def softmean_centered(df: DataFrame, group: list[str], x: str, beta: float, out: str) -> DataFrame:
    """AG-17: x - (1/beta) log(mean(exp(beta x))) per group (beta=0: mean)."""
    keyed = group or ["_k"]
    d = df if group else df.withColumn("_k", F.lit(1))
    if beta == 0.0:
        st = d.groupBy(*keyed).agg(F.avg(x).alias("_sm"))
    else:
        # max-shifted log-mean-exp: one pass for the max, one for the mean
        mx = d.groupBy(*keyed).agg(F.max(F.col(x) * beta).alias("_mx"))
        st = d.join(mx, keyed).groupBy(*keyed).agg(
            ((F.first("_mx") + F.log(F.avg(F.exp(F.col(x) * beta - F.col("_mx"))))) / beta).alias("_sm"))
    out_df = d.join(st, keyed).withColumn(out, F.col(x) - F.col("_sm")).drop("_sm")
    return out_df if group else out_df.drop("_k")


def _fmt3():
    @F.pandas_udf("string")
    def fmt3(v: pd.Series) -> pd.Series:
        # Python's formatting rounds the binary value (Java's %.3f rounds the
        # shortest decimal string, which differs on ties like 1.5385)
        return v.map(lambda x: None if x is None or x != x else f"{x:.3f}")
    return fmt3


def metrics_line(long: DataFrame, step: str = "step") -> DataFrame:
    """AG-18: ``step:N - name:value(3dp) - ...`` per step, names in order.
    A metric log has one row per training step, so formatting each number
    in a small Arrow UDF is cheap."""
    d = long.withColumn("_v3", _fmt3()(F.col("value").cast("double")))
    d = d.groupBy(step).agg(F.array_sort(F.collect_list(F.struct("ord", "metric", "_v3"))).alias("_m"))
    parts = F.transform("_m", lambda m: F.concat(m["metric"], F.lit(":"), m["_v3"]))
    return d.select(step, F.concat(F.lit("step:"), F.col(step).cast("string"), F.lit(" - "),
                                   F.array_join(parts, " - ")).alias("line"))


def best_from_log(lines: DataFrame, key: str = "critic/rewards/mean", col: str = "value") -> DataFrame:
    """AG-16: best value of one metric across ``step:`` lines of a log."""
    ln = F.col(col)
    kv = F.split(ln, " - ")
    val = F.filter(F.transform(kv, lambda p: F.when(F.split(p, ":")[0] == key,
                                                    F.split(p, ":")[1].try_cast("double"))),
                   lambda v: v.isNotNull())
    return lines.where(ln.startswith("step")).select(F.try_element_at(val, F.lit(1)).alias("_r")) \
        .agg(F.max("_r").alias("best"))


def action_mask_stats(tokens: DataFrame, seq: list[str], mask: str = "mask") -> DataFrame:
    """AR-7: ratio of action tokens (eps 1e-8) and per-sequence action length stats."""
    per = tokens.groupBy(*seq).agg(F.sum(mask).alias("_a"), F.count(F.lit(1)).alias("_t"))
    return per.agg((F.sum("_a") / (F.sum("_t") + F.lit(1e-8))).alias("action_ratio"),
                   F.max("_a").alias("action_length_max"), F.min("_a").alias("action_length_min"),
                   F.avg("_a").alias("action_length_mean"))


def timing_metrics(timing: DataFrame, prompt_tokens: DataFrame) -> DataFrame:
    """AG-6/AG-7: timing (name, seconds) -> per-token ms; ``gen`` divides by
    response tokens, other sections by all tokens. ``prompt_tokens`` is a
    one-row table (n_prompt, n_response)."""
    t = timing.withColumn("_k", F.lit(1)).join(F.broadcast(prompt_tokens.withColumn("_k", F.lit(1))), "_k")
    denom = F.when(F.col("name") == "gen", F.col("n_response")).otherwise(F.col("n_prompt") + F.col("n_response"))
    return t.select("name", F.col("seconds"), (F.col("seconds") * 1000 / denom).alias("per_token_ms"))
