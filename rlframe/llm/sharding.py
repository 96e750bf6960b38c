"""Uniform shuffle into shards of exact sizes by a communication matrix.

The rows lie in partitions. How many rows each partition sends to each shard
is drawn from the multivariate hypergeometric law, which is the law of those
counts under a uniform shuffle; each partition permutes its rows and deals
them out by its counts; the shards permute what they got. Permuted are row
numbers: the rows pass by, so a task holds one batch of them. The result is a
uniform shuffle whose shard sizes are exact. The matrix has one row per
partition and one column per shard and is all that the driver holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlframe.llm.shared import staged


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Counts at most one apart, the larger ones first."""
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def communication_matrix(partition_rows: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard; margins are exact."""
    rng = np.random.default_rng(seed)
    room = sizes.copy()
    out = np.zeros((len(partition_rows), len(sizes)), np.int64)
    for p, n in enumerate(partition_rows):
        out[p] = rng.multivariate_hypergeometric(room, n, method="marginals")
        room -= out[p]
    return out


#: Low bits of ``monotonically_increasing_id``: the row's number in its partition.
ROW = (1 << 33) - 1


def _deal(matrix: np.ndarray, seed: int):
    """Deal rows out by their partition and number in it; ``_order`` is the
    random key of the second permutation."""
    def run(batches):
        now, shard, key = -1, np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            part, row = batch.column("_part").to_numpy(), batch.column("_uid").to_numpy() & ROW
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if part[lo] != now:
                    now, n = int(part[lo]), int(matrix[part[lo]].sum())
                    rng = np.random.default_rng([seed, now])
                    order, shard = rng.permutation(n), np.empty(n, np.int32)
                    shard[order] = np.repeat(np.arange(matrix.shape[1], dtype=np.int32), matrix[now])
                    key = rng.integers(-2**63, 2**63 - 1, n)
                at = row[lo:hi]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(shard[at]), pa.array(key[at])],
                                                 names=[*batch.schema.names, "shard", "_order"])
    return run


def uniform_shards(df: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    """``df`` with shard (int) and slot (long, gapless from 0 in its shard).

    Every row is placed once, equal and null rows too. Columns that clash
    with shard, slot or the operator's own are replaced. With fewer rows than
    shards the last shards are empty; an empty table gives no rows. The draw
    follows the seed and the partitions of the input."""
    own = ("shard", "slot", "_part", "_uid", "_order", "_at", "_row")
    keep = [c for c in df.columns if c not in own]
    spark = df.sparkSession
    # numbered while written, so a retried task of a later job sees the same partitions
    rows = staged(df.select(*keep, F.spark_partition_id().alias("_part"),
                            F.monotonically_increasing_id().alias("_uid")), "rows")
    counts = {r._part: r.n for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    place = {p: i for i, p in enumerate(parts)}
    total = sum(counts.values())
    matrix = communication_matrix(np.array([counts[p] for p in parts], np.int64), shard_sizes(total, shards), seed)
    lookup = np.zeros((max(parts, default=-1) + 1, shards), np.int64)
    for p in parts:
        lookup[p] = matrix[place[p]]
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "shard int", "_order long"])

    dealt = rows.mapInArrow(_deal(lookup, seed), shape)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 500_000), 1)
    laid = staged(dealt.repartitionByRange(n, "shard", "_order").sortWithinPartitions("shard", "_order", "_uid")
                  .drop("_part", "_uid", "_order").withColumn("_at", F.spark_partition_id())
                  .withColumn("_row", F.monotonically_increasing_id()), "exchanged")
    # a row's slot is its number in the partition plus this
    ahead: dict[tuple[int, int], int] = {}
    before = np.zeros(shards, np.int64)
    at, start = -1, 0
    for r in laid.groupBy("_at", "shard").agg(F.count("*").alias("n")).orderBy("_at", "shard").collect():
        at, start = r._at, start if r._at == at else 0
        ahead[r._at, r.shard] = int(before[r.shard]) - start
        before[r.shard] += r.n
        start += r.n
    return laid.mapInArrow(_slots(ahead), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.select(*keep).schema),
                                                     "shard int", "slot long"]))


def _slots(ahead: dict[tuple[int, int], int]):
    def run(batches):
        for batch in batches:
            at, shard = batch.column("_at").to_numpy(), batch.column("shard").to_numpy()
            first = np.fromiter(map(ahead.__getitem__, zip(at.tolist(), shard.tolist())), np.int64, batch.num_rows)
            names = [c for c in batch.schema.names if c not in ("_at", "_row", "shard")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("shard"),
                                              pa.array(first + (batch.column("_row").to_numpy() & ROW))],
                                             names=[*names, "shard", "slot"])
    return run
