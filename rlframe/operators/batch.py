"""Batch shaping on DataFrames (BS-0..20).

The reference's batch is positional: rows are addressed by their index.
Here a batch carries an explicit key; :func:`with_global_index` turns a
sort order into a dense 0-based index without a single-partition window:
the data is range-partitioned by the order, checkpointed (freezing the
partitioning in the shared checkpoint folder, which also cuts lineage and
survives executor loss), and every row's index is the count of rows in
earlier partitions plus its position inside its own partition. The offsets
table has one row per partition, so broadcasting it is size-bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rlframe.session import ensure_checkpoint_dir


def with_global_index(df: DataFrame, order: list, out: str = "idx") -> DataFrame:
    """Dense 0-based index following ``order`` (which should be a total order)."""
    ensure_checkpoint_dir(df.sparkSession)
    s = (df.orderBy(*order)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id())
           .checkpoint(eager=True))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a tiny, bounded window and broadcast
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (s.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
              .withColumn(out, (F.col("_off") + local).cast("long"))
              .drop("_pid", "_mid", "_off"))


def batch_size(df: DataFrame) -> int:
    return df.count()


# ------------------------------------------------------------- positional
def repeat(df: DataFrame, times: int, interleave: bool = True, idx: str = "idx", n: int | None = None,
           out: str = "new_idx") -> DataFrame:
    """BS-9: each row ``times`` times; interleaved (1,1,2,2) or tiled (1,2,1,2)."""
    r = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    d = df.withColumn("_r", r)
    if interleave:
        return d.withColumn(out, F.col(idx) * times + F.col("_r")).drop("_r")
    if n is None:
        n = df.count()
    return d.withColumn(out, F.col("_r") * n + F.col(idx)).drop("_r")


def chunk(df: DataFrame, k: int, n: int, idx: str = "idx", out: str = "chunk_id") -> DataFrame:
    """BS-6: k equal contiguous chunks; the batch size must divide by k."""
    if n % k != 0:
        raise ValueError(f"{n} rows cannot be cut into {k} equal chunks")
    return df.withColumn(out, F.floor(F.col(idx) / (n // k)).cast("int"))


def pad_to_divisor(df: DataFrame, k: int, n: int, idx: str = "idx") -> tuple[DataFrame, int]:
    """BS-7: append rows copied from the start (cycling) until n % k == 0.

    Returns (padded frame with ``is_pad``, pad size). Pad rows take indices
    n, n+1, ...; unpad is ``filter(~is_pad)``."""
    pad = (k - n % k) % k
    base = df.withColumn("is_pad", F.lit(False))
    if pad == 0:
        return base, 0
    # a pad row j (0..pad-1) copies row j % n; rows needed at most pad/n+1 times
    reps = (pad + n - 1) // n
    src = df.where(F.col(idx) < min(pad, n)).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    src = src.withColumn("_j", F.col("_r") * n + F.col(idx)).where(F.col("_j") < pad)
    padded = src.withColumn(idx, (F.lit(n) + F.col("_j")).cast("long")).drop("_r", "_j") \
        .withColumn("is_pad", F.lit(True))
    return base.unionByName(padded), pad


def pad_edge(df: DataFrame, p: int, n: int, idx: str = "idx", side: str = "last") -> DataFrame:
    """BS-8: pad with ``p`` copies of the first or last row."""
    src_idx = n - 1 if side == "last" else 0
    row = df.where(F.col(idx) == src_idx)
    extra = row.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))) \
        .withColumn(idx, (F.lit(n) + F.col("_r")).cast("long")).drop("_r").withColumn("is_pad", F.lit(True))
    return df.withColumn("is_pad", F.lit(False)).unionByName(extra)


def slice_rows(df: DataFrame, n: int, start: int | None, stop: int | None, step: int | None = None,
               idx: str = "idx") -> DataFrame:
    """BS-3: Python slice semantics over the index (negative bounds allowed)."""
    a, b, s = slice(start, stop, step).indices(n)
    if s <= 0:
        raise ValueError("only positive steps are supported")
    c = F.col(idx)
    return df.where((c >= a) & (c < b) & (F.pmod(c - a, F.lit(s)) == 0))


def pick_rows(df: DataFrame, picks: DataFrame, idx: str = "idx", pick_idx: str = "pick",
              ord_: str = "ord") -> DataFrame:
    """BS-2: rows by an index list ``(ord, pick)`` -- keeps list order and
    duplicates (a join, not a filter)."""
    return picks.join(df, picks[pick_idx] == df[idx]).drop(pick_idx)


def reorder(df: DataFrame, perm: DataFrame, idx: str = "idx", new: str = "new_idx",
            src: str = "src_idx") -> DataFrame:
    """BS-10: new row i = old row perm[i]; ``perm`` is ``(new_idx, src_idx)``."""
    return perm.join(df, perm[src] == df[idx]).drop(src)


def inverse_permutation(perm: DataFrame, new: str = "new_idx", src: str = "src_idx") -> DataFrame:
    return perm.select(F.col(src).alias(new), F.col(new).alias(src))


def keyed_union(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """BS-4: column-wise union of two equal-size batches joined on ``key``.

    Columns present in both must be equal (NULL-safe; NaN equals NaN); a
    mismatch or a missing key fails the job."""
    shared = [c for c in a.columns if c in b.columns and c not in key]
    only_b = [c for c in b.columns if c not in a.columns]
    bb = b.select(*key, *[F.col(c).alias(f"_b_{c}") for c in shared], *only_b)
    j = a.withColumn("_ina", F.lit(True)).join(bb.withColumn("_inb", F.lit(True)), key, "full")
    checks = [F.col("_ina").isNotNull() & F.col("_inb").isNotNull()]
    for c in shared:
        eq = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        tp = dict(a.dtypes)[c]
        if tp in ("double", "float"):
            eq = eq | (F.isnan(F.col(c)) & F.isnan(F.col(f"_b_{c}")))
        checks.append(eq)
    ok = checks[0]
    for c in checks[1:]:
        ok = ok & c
    # a filter predicate is always evaluated (a dropped check column would be
    # pruned by the optimizer)
    guard = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("keyed_union: rows or shared columns differ"))
                                               .cast("boolean"))
    return j.where(guard).select(*key, *[c for c in a.columns if c not in key], *only_b)


def fold(df: DataFrame, k: int, idx: str = "idx", cols: list[str] | None = None) -> DataFrame:
    """BS-11: fold ``k`` consecutive rows into one (batch dim / k)."""
    cols = cols or [c for c in df.columns if c != idx]
    return df.groupBy(F.floor(F.col(idx) / k).alias("fold_idx")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(idx).alias("_i"), *[F.col(c) for c in cols]))).alias("items"))


def unfold(folded: DataFrame, k: int) -> DataFrame:
    d = folded.select("fold_idx", F.posexplode("items").alias("_p", "_it"))
    return d.select((F.col("fold_idx") * k + F.col("_p")).alias("idx"), "_it.*").drop("_i")


# -------------------------------------------------------------- balancing
def snake_buckets(df: DataFrame, length: str, k: int, key: list[str], out: str = "bucket") -> DataFrame:
    """BS-14: k-way length balancing with equal counts.

    Rows are ranked by length (descending, then key) and dealt in snake
    order 0..k-1, k-1..0, ... . Every bucket gets n/k rows (n % k rows get
    one more) and bucket sums differ by at most max(len) - min(len)."""
    d = with_global_index(df, [F.col(length).desc()] + [F.col(c) for c in key], "_rank")
    rnd = F.floor(F.col("_rank") / k)
    pos = F.pmod(F.col("_rank"), F.lit(k))
    return d.withColumn(out, F.when(F.pmod(rnd, F.lit(2)) == 0, pos).otherwise(F.lit(k - 1) - pos).cast("int")) \
            .drop("_rank")


def balance_stats(assigned: DataFrame, length: str, bucket: str, idx: str, k: int, n: int) -> DataFrame:
    """Balance report: contiguous-chunk min/max/diff vs balanced min/max, mean."""
    bs = n // k
    orig = assigned.groupBy(F.floor(F.col(idx) / bs).alias("_c")).agg(F.sum(length).alias("_s"))
    bal = assigned.groupBy(bucket).agg(F.sum(length).alias("_s"))
    o = orig.agg(F.min("_s").alias("min"), F.max("_s").alias("max"), F.sum("_s").alias("_tot"))
    b = bal.agg(F.min("_s").alias("balanced_min"), F.max("_s").alias("balanced_max"))
    one = F.lit(1).alias("_k")
    return o.select("*", one).join(F.broadcast(b.select("*", one)), "_k").select(  # 1 row each
        "min", "max", (F.col("max") - F.col("min")).alias("minmax_diff"), "balanced_min", "balanced_max",
        (F.col("_tot") / k).alias("mean"))


def token_budget_buckets(df: DataFrame, length: str, max_tokens: int, key: list[str]) -> tuple[DataFrame, int]:
    """BS-16: ceil(total tokens / budget) micro-batches, length balanced."""
    total = df.agg(F.sum(length)).first()[0] or 0
    m = max(1, -(-int(total) // max_tokens))
    return snake_buckets(df, length, m, key, "micro_batch"), m


# ------------------------------------------------------------ group rules
def dynamic_group_filter(df: DataFrame, group: str, metric: str, max_groups: int | None,
                         order: str | None = None) -> DataFrame:
    """BS-17: keep groups whose metric varies (population std > 0) or that
    have one sample; then keep the first ``max_groups`` kept groups (by
    ``order``, default the group key)."""
    st = df.groupBy(group).agg(F.stddev_pop(metric).alias("_sd"), F.count(F.lit(1)).alias("_n"),
                               F.min(order or group).alias("_o"))
    kept = st.where((F.col("_sd") > 0) | (F.col("_n") == 1))
    if max_groups is not None:
        kept = kept.orderBy("_o", group).limit(max_groups)
    return df.join(kept.select(group), group, "left_semi")


def accuracy_band_filter(df: DataFrame, group: str, acc: str, lo: float, hi: float,
                         length: str | None = None, max_len: int | None = None,
                         keep_ratio: float | None = None, order: str | list[str] = "idx") -> DataFrame:
    """BS-18: flag groups whose mean accuracy is inside [lo, hi] (and, if
    given, with no sample at the length limit); passing groups sort first,
    then, in ``order`` (one or several columns), the batch is cut to ``keep_ratio`` of its rows."""
    aggs = [F.avg(acc).alias("_a")]
    if length is not None:
        aggs.append(F.max((F.col(length) >= max_len).cast("int")).alias("_trunc"))
    st = df.groupBy(group).agg(*aggs)
    ok = (F.col("_a") >= lo) & (F.col("_a") <= hi)
    if length is not None:
        ok = ok & (F.col("_trunc") == 0)
    d = df.join(st.select(group, ok.alias("passes")), group)
    if keep_ratio is None:
        return d
    n = df.count()
    keep = int(n * keep_ratio)
    ranked = with_global_index(d, [F.col("passes").desc(), *([order] if isinstance(order, str) else order)], "_r")
    return ranked.where(F.col("_r") < keep).drop("_r")


def first_n_per_group(df: DataFrame, group: str, order: list[str], n: int, salt: int = 64) -> DataFrame:
    """SC-23: the first ``n`` rows of every group (for inspection).

    A group can hold a large share of the table, so the top-n runs in two
    rounds: first per (group, salt) -- salt spreads one group over ``salt``
    tasks -- then over the at most ``salt * n`` survivors per group."""
    s = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salt)))
    w1 = Window.partitionBy(group, "_salt").orderBy(*order)
    pre = s.withColumn("_rn", F.row_number().over(w1)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    w2 = Window.partitionBy(group).orderBy(*order)
    return pre.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= n).drop("_rn")


def assign_uid(df: DataFrame, cols: list[str], out: str = "uid") -> DataFrame:
    """BS-19: deterministic per-prompt id (instead of a random uuid)."""
    return df.withColumn(out, F.sha2(F.concat_ws("\u001f", *[F.col(c).cast("string") for c in cols]), 256))


def gather_responses(df: DataFrame, row: list[str], sample: str, text: str, out: str = "responses") -> DataFrame:
    """BS-20: one ``responses`` array per row, ordered by sample index."""
    return df.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("_s"),
                                                                      F.col(text).alias("_t")))).alias("_a")) \
             .withColumn(out, F.transform("_a", lambda x: x["_t"])).drop("_a")


def minibatches(df: DataFrame, batch: int, epochs: int, seed: int, key: str,
                drop_last: bool = True) -> DataFrame:
    """BS-12: seeded shuffle per epoch, cut into mini-batches.

    The order is ``md5(key:seed:epoch)`` (stable across runs and
    cluster shapes); the last short batch is dropped when ``drop_last``."""
    d = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    d = d.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)),
                                               F.col("epoch").cast("string"))))
    d = with_global_index(d, [F.col("epoch"), F.col("_h"), F.col(key)], "_g")
    n = df.count()
    d = d.withColumn("_e", F.col("_g") - F.col("epoch") * n)
    d = d.withColumn("batch_id", F.floor(F.col("_e") / batch).cast("long"))
    if drop_last:
        d = d.where(F.col("batch_id") < n // batch)
    return d.drop("_h", "_g", "_e")


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """0-based position of each row inside its key, by ``order``.

    Unlike ``row_number() over (partition by key)``, no key has to fit in
    one task: rows get a global index from a range-partitioned sort (a hot
    key spans several partitions), and a key's first index (a partial
    ``min`` aggregate, one row per key) is subtracted."""
    d = with_global_index(df, [F.col(c) for c in keys + order], "_gi")
    first = d.groupBy(*keys).agg(F.min("_gi").alias("_g0"))
    return d.join(first, keys).withColumn(out, (F.col("_gi") - F.col("_g0")).cast("int")).drop("_gi", "_g0")
