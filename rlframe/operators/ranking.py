"""Weighted pairwise ranking accuracy (AG-14) without pairs.

For samples i < j of a group, the pair weighs |acc_i - acc_j| and counts as
right when (score_i > score_j) equals (acc_i > acc_j). In the order of
(score, position) that is: the sample of larger accuracy comes later. So the
right weight is a weighted count of pairs in order,

    hits = sum over p before q of max(acc_q - acc_p, 0),

the wrong weight is the same with accuracies negated, and a group's result is
hits / (hits + misses).

A group may hold any share of the table. Rows are dealt out by ranges of
(group, score, position); pairs inside one block are counted there, level by
level of the binary digits of the positions (two positions meet at their
highest differing digit). Only the first and last group of a block can reach
into another: their rows are reduced to (group, block, accuracy, count) cells and
dealt out by ranges of (group, accuracy); pairs in one strip and different blocks
are counted there the same way. What is left, pairs in different strips and blocks,
needs the counts and sums per (group, strip, block) alone: a grid of at most
partitions x partitions numbers a group, whatever the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlframe.session import ensure_checkpoint_dir


def ordered_gain(group: np.ndarray, place: np.ndarray, value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per group 0..max: the sums over pairs with place_p < place_q of
    count_p count_q max(+-(value_q - value_p), 0). Equal places make no pair."""
    n_groups = int(group.max()) + 1 if len(group) else 0
    hits, misses = np.zeros(n_groups), np.zeros(n_groups)
    if not len(group):
        return hits, misses
    by = np.argsort(value, kind="stable")
    g, p, v, c = group[by].astype(np.int64), place[by].astype(np.int64), value[by], count[by].astype(float)
    top = int(p.max())
    for level in range(top.bit_length()):
        key = (g << max(1, top.bit_length() - level)) | (p >> (level + 1))
        later = (p >> level) & 1 == 1
        o = np.argsort(key, kind="stable")  # by key, then value
        k, late, x, m, gg = key[o], later[o], v[o], c[o], g[o]
        start = np.zeros(len(k), bool)
        start[0] = True
        start[1:] = k[1:] != k[:-1]
        first = np.flatnonzero(start)
        run = np.cumsum(start) - 1

        def before(weights):  # sum over earlier rows of the same key
            total = np.cumsum(weights)
            base = np.concatenate([[0.0], total])[first]
            return total - weights - base[run]

        # values are measured from their key's smallest: small differences keep their digits
        x = x - x[first][run]
        early = np.where(late, 0.0, m)
        late_m = np.where(late, m, 0.0)
        np.add.at(hits, gg[late], (late_m * (x * before(early) - before(early * x)))[late])
        np.add.at(misses, gg[~late], (early * (x * before(late_m) - before(late_m * x)))[~late])
    return hits, misses


def _segments(keys: list[np.ndarray]) -> np.ndarray:
    """Numbers 0, 1, ... of runs of equal rows."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.cumsum(change)


def _within_blocks(batches):
    """One block of rows sorted by group, score, position: what each group
    gains inside it, and accuracy counts of the two groups at its borders."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    gid, acc, block = (t.column(c).to_numpy() for c in ("_gid", "_acc", "_block"))
    seg = _segments([gid])
    start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    hits, misses = ordered_gain(seg, np.arange(len(seg)) - start[seg], acc, np.ones(len(seg)))
    rows = [(gid[start], hits, misses, block[start], np.full(len(start), np.nan), np.zeros(len(start), np.int64))]
    for s in {0, int(seg[-1])}:
        value, count = np.unique(acc[seg == s], return_counts=True)
        rows.append((np.full(len(value), gid[start[s]]), np.zeros(len(value)), np.zeros(len(value)),
                     np.full(len(value), block[0]), value, count))
    yield _table(rows, ("_gid", "hits", "misses", "_block", "_acc", "_n"))


def _within_strips(batches):
    """One strip of cells sorted by group and accuracy."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    gid, acc, block, count, strip = (t.column(c).to_numpy() for c in ("_gid", "_acc", "_block", "_n", "_strip"))
    seg = _segments([gid])
    start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    place = np.unique(block, return_inverse=True)[1]
    hits, misses = ordered_gain(seg, place, acc, count)
    rows = [(gid[start], hits, misses, np.full(len(start), -1), np.full(len(start), -1), np.zeros(len(start)), np.zeros(len(start)))]
    cell, where = np.unique(np.column_stack([seg, block]), axis=0, return_inverse=True)
    where = where.ravel()
    n, total = np.bincount(where, count), np.bincount(where, count * acc)
    zero = np.zeros(len(cell))
    rows.append((gid[start][cell[:, 0]], zero, zero, cell[:, 1], np.full(len(cell), strip[0]), n, total))
    yield _table(rows, ("_gid", "hits", "misses", "_block", "_strip", "_n", "_sum"))


def _table(rows: list[tuple], names: tuple) -> pa.RecordBatch:
    types = {"_gid": pa.int64(), "_block": pa.int64(), "_strip": pa.int64()}
    cols = [np.concatenate([r[i] for r in rows]) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.float64())) for n, c in zip(names, cols)], names=list(names))


def _across(grid):
    """A group's grid of (strip, block) counts and sums: pairs that differ in both."""
    t = grid.to_pandas()
    strip, block = np.unique(t["_strip"], return_inverse=True)[1], np.unique(t["_block"], return_inverse=True)[1]
    shape = (strip.max() + 1, block.max() + 1)
    n, total = np.zeros(shape), np.zeros(shape)
    # from the group's mean: products of large sums would lose digits
    mean = t["_sum"].sum() / t["_n"].sum()
    np.add.at(n, (strip, block), t["_n"])
    np.add.at(total, (strip, block), t["_sum"] - mean * t["_n"])

    def below(x):  # lower strips, lower blocks
        out = np.zeros(shape)
        out[1:, 1:] = np.cumsum(np.cumsum(x, 0), 1)[:-1, :-1]
        return out

    def above(x):  # lower strips, higher blocks
        out = np.zeros(shape)
        out[1:, :-1] = np.cumsum(np.cumsum(x[:, ::-1], 0), 1)[:, ::-1][:-1, 1:]
        return out

    hits = float((total * below(n) - n * below(total)).sum())
    misses = float((total * above(n) - n * above(total)).sum())
    return pa.table({"_gid": pa.array([t["_gid"].iloc[0]], pa.int64()), "hits": [hits], "misses": [misses]})


def _dealt(df: DataFrame, order: list[str], parts: int, name: str) -> DataFrame:
    """Rows in range partitions by ``order``, each sorted, frozen in the shared
    folder, with the partition's number."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order) \
        .withColumn(name, F.spark_partition_id().cast("long")).checkpoint(eager=True)


def pairwise_rank_accuracy(df: DataFrame, group: str, score: str, acc: str, order: str, parts: int | None = None) -> DataFrame:
    """AG-14: (group, rank_acc), for any accuracies.

    Rows without score or accuracy are left out of the pairs; a group without two
    different accuracies, or of one row, gets 0.5. A null group is a group of its
    own. Equal scores rank by ``order``; rows that share that too rank by
    accuracy, smaller first. ``parts`` blocks and strips are used (default: the
    session's shuffle partitions). NaN counts as missing."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = F.col(score).isNotNull() & F.col(acc).isNotNull() & ~F.isnan(F.col(score).cast("double")) & ~F.isnan(F.col(acc).cast("double"))
    # groups by number: a hash could merge two, so ids come from the distinct groups
    ids = df.select(F.col(group).alias("_group")).distinct() \
        .withColumn("_gid", F.monotonically_increasing_id()).checkpoint(eager=True)
    rows = df.where(usable).select(F.col(group).alias("_g"), F.col(score).cast("double").alias("_score"), F.col(order).alias("_order"),
                                   F.col(acc).cast("double").alias("_acc"))
    rows = rows.join(ids, F.col("_g").eqNullSafe(F.col("_group"))).select("_gid", "_score", "_order", "_acc")
    blocks = _dealt(rows, ["_gid", "_score", "_order", "_acc"], parts, "_block").select("_gid", "_acc", "_block") \
        .mapInArrow(_within_blocks, "_gid long, hits double, misses double, _block long, _acc double, _n double")
    blocks = blocks.checkpoint(eager=True)
    spanning = blocks.where("_n > 0").groupBy("_gid").agg(F.min("_block").alias("_low"), F.max("_block").alias("_high")).where("_low < _high")
    cells = blocks.where("_n > 0").join(spanning.select("_gid"), "_gid", "left_semi").select("_gid", "_acc", "_block", "_n")
    strips = _dealt(cells, ["_gid", "_acc", "_block"], parts, "_strip") \
        .mapInArrow(_within_strips, "_gid long, hits double, misses double, _block long, _strip long, _n double, _sum double")
    strips = strips.checkpoint(eager=True)
    grid = strips.where("_n > 0").groupBy("_gid").applyInArrow(_across, "_gid long, hits double, misses double")
    gains = blocks.where("_n = 0").select("_gid", "hits", "misses") \
        .unionByName(strips.where("_n = 0").select("_gid", "hits", "misses")).unionByName(grid)
    per = gains.groupBy("_gid").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    weight = F.col("hits") + F.col("misses")
    return ids.join(per, "_gid", "left").select(
        F.col("_group").alias(group), F.when(weight > 0, F.col("hits") / weight).otherwise(0.5).alias("rank_acc"))


def rank_accuracy_mean(per_group: DataFrame) -> DataFrame:
    """The mean over groups, one row."""
    return per_group.agg(F.avg("rank_acc").alias("rank_acc"))
