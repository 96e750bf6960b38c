"""Reverse linear recurrences over ordered rows, split into bounded chunks.

Returns, GAE, reward-to-go and "next value" are all instances of

    x_t = b_t + a_t * x_next(t)         (x = b at the last row of a key)

A single pass over a whole key would put a hot key (one sequence, or one
group holding a third of the table) into one task. Instead rows are cut into
chunks of ``chunk`` positions. A row maps the carry that enters its chunk to
its own value: x_t = local_t + open_t * carry. Both numbers come from one
backward pass over the chunk's sorted rows (Arrow batches, in double
precision, nothing dropped; whole arrays at a time, see ``_compose``). The first row of each chunk, one row per
occupied chunk, forms the same problem again, whose solution gives every
chunk the value at the next *occupied* chunk; it is joined back on
``(key, chunk)``, the partitioning the pass already uses. Gaps between
positions, negative or zero factors and any magnitude are all exact.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_OUT = ("_local", "_open", "_local_next", "_open_next")


def _compose(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running compositions of x -> b + a x inside segments.

    ``first`` marks the rows that begin a segment. Row i gets (local, open) of
    the maps of its segment up to i, later rows outermost; pairs of rows double
    in distance, so a segment of m rows takes log2(m) steps over whole arrays."""
    local, opened = b.copy(), a.copy()
    place = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    step = 1
    while step <= place.max(initial=0):
        i = np.flatnonzero(place >= step)
        local[i], opened[i] = local[i] + opened[i] * local[i - step], opened[i] * opened[i - step]
        step *= 2
    return local, opened


def _backward(batches):
    """Rows sorted by key, chunk and descending position; ``_row`` is 1 at
    the first of a chunk. ``_open_next`` is null where no row of the chunk
    follows."""
    carry = (0.0, 1.0)  # of the chunk that is open at a batch's start
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_scan_a", "_scan_b"))
        first = batch.column("_row").to_numpy(zero_copy_only=False) == 1
        local, opened = _compose(first, a, b)
        goes_on = np.cumsum(first) == 0
        local[goes_on], opened[goes_on] = local[goes_on] + opened[goes_on] * carry[0], opened[goes_on] * carry[1]
        before = [np.concatenate([[c], x[:-1]]) for c, x in zip(carry, (local, opened))]
        local_next = np.where(first, 0.0, before[0])
        cols = [pa.array(local), pa.array(opened), pa.array(local_next, mask=first), pa.array(before[1], mask=first)]
        if len(a):
            carry = (local[-1], opened[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *_OUT])


def _solve(df: DataFrame, keys: list[str], pos: str, chunk: int, span: Span) -> DataFrame:
    """df has keys, pos, _scan_a, _scan_b; adds _x and _x_next (null at the last row)."""
    pk = [*keys, "_c"]
    d = df.withColumn("_c", F.floor((F.col(pos) - F.lit(span.first)) / F.lit(chunk)).cast("long"))
    d = d.withColumn("_row", F.row_number().over(Window.partitionBy(*pk).orderBy(F.col(pos).desc())))
    d = d.mapInArrow(_backward, StructType([*d.schema.fields, *(StructField(c, DoubleType()) for c in _OUT)]))
    if span.width < chunk:  # one chunk
        return d.withColumn("_x", F.col("_local")).withColumn("_x_next", F.col("_local_next")).drop("_c", "_row", *_OUT)
    first = d.groupBy(*pk).agg(F.min_by(F.struct("_local", "_open"), F.col(pos)).alias("_f"))
    chunks = first.select(*keys, F.col("_c").alias("_cpos"), F.col("_f._open").alias("_scan_a"), F.col("_f._local").alias("_scan_b"))
    carry = _solve(chunks, keys, "_cpos", chunk, Span(0, span.width // chunk)) \
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cpos").alias("_kc"), F.col("_x_next").alias("_in"))
    same = F.col("_c") == F.col("_kc")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    d = d.join(carry, same, "left")
    enters = F.coalesce(F.col("_in"), F.lit(0.0))
    return d.withColumn("_x", F.col("_local") + F.col("_open") * enters).withColumn(
        "_x_next", F.when(F.col("_open_next").isNull(), F.col("_in"))
        .otherwise(F.col("_local_next") + F.col("_open_next") * enters)) \
        .drop("_c", "_row", "_in", "_kc", *[f"_k{i}" for i in range(len(keys))], *_OUT)


class Span(NamedTuple):
    """Positions of a table: the smallest, and the distance to the largest."""

    first: int
    width: int


def position_span(df: DataFrame, pos: str) -> Span:
    """Where positions lie, negative ones too; sets how often chunks nest."""
    low, high = df.agg(F.min(pos), F.max(pos)).first()
    return Span(0, 0) if low is None else Span(int(low), int(high) - int(low))


def reverse_linear_scan(df: DataFrame, keys: list[str], pos: str, a: str, b: str,
                        out: str, chunk: int = 4096, span: Span | None = None) -> DataFrame:
    """Add column ``out`` = x (see module doc). Null factors are 0, null
    addends 0. ``span`` is ``position_span`` of the same rows, if it is known."""
    span = position_span(df, pos) if span is None else span
    base = df.withColumn("_scan_a", F.coalesce(F.col(a).cast("double"), F.lit(0.0))) \
        .withColumn("_scan_b", F.coalesce(F.col(b).cast("double"), F.lit(0.0)))
    return _solve(base, keys, pos, chunk, span).withColumnRenamed("_x", out).drop("_x_next", "_scan_a", "_scan_b")


def lead_next(df: DataFrame, keys: list[str], pos: str, col: str, out: str,
              chunk: int = 4096, span: Span | None = None) -> DataFrame:
    """Value of the numeric ``col`` (null as 0) at the next row of the same
    key by ``pos``, whatever the gap; NULL at the end."""
    span = position_span(df, pos) if span is None else span
    base = df.withColumn("_scan_a", F.lit(0.0)).withColumn("_scan_b", F.coalesce(F.col(col).cast("double"), F.lit(0.0)))
    return _solve(base, keys, pos, chunk, span).withColumnRenamed("_x_next", out).drop("_x", "_scan_a", "_scan_b")
