"""The law of majority votes over draws with replacement (AG-11).

n samples are drawn from a prompt's N; the vote class with most draws wins,
ties go to the class drawn first, and the vote's value is that of the winner's
first drawn member. Two symmetries make the law of that value a sum over
classes: given which class each draw falls in, every draw is uniform over its
class's members, so the value's moments are the class's means; and of t classes
tied at the top each is the one drawn first with probability 1/t.

With p_c the share of class c and T_k(z) the exponential series cut after z^k,
the chance that c wins with k draws is

    n! [x^n] (p_c x)^k / k!  *  integral over y in 0..1 of
        prod over d != c of ( T_{k-1}(p_d x) + y (p_d x)^k / k! )

since y^(t-1) integrates to 1/t. The integrand is a polynomial in y of degree
below n / k, so Gauss-Legendre nodes give the integral exactly. Series are
scaled by Poisson weights of mean n p, which keeps every term at most 1.

The law depends on the class sizes alone. Prompts with equal sizes share one
computation, and a size that several classes have enters as a power.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

#: A number of winning draws is left out if even its bound is below this share.
NEGLIGIBLE = 1e-20


def _poisson(rate: float, top: int) -> np.ndarray:
    """exp(-rate) rate^j / j! for j = 0..top."""
    j = np.arange(top + 1)
    log = j * math.log(rate) - rate - np.array([math.lgamma(i + 1) for i in j]) if rate > 0 else np.where(j == 0, 0.0, -np.inf)
    return np.exp(log)


def _times(a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
    """Product of two series up to x^top."""
    a, b = a[:top + 1], b[:top + 1]
    if min(len(a), len(b)) < 64:
        return np.convolve(a, b)[:top + 1]
    size = 1 << (len(a) + len(b) - 2).bit_length()
    out = np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)
    return np.maximum(out[:min(top + 1, len(a) + len(b) - 1)], 0.0)


def _power(a: np.ndarray, times: int, top: int) -> np.ndarray:
    out = np.ones(1)
    while times:
        if times & 1:
            out = _times(out, a, top)
        times >>= 1
        if times:
            a = _times(a, a, top)
    return out


def majority_law(classes: list[tuple[int, int]], n: int) -> dict[int, float]:
    """Winning probability of one class of each size, for ``n`` draws.

    ``classes`` lists (size, number of classes of that size)."""
    total = sum(m * r for m, r in classes)
    rates = [(m, r, n * m / total) for m, r in classes]
    series = {m: _poisson(rate, n) for m, _, rate in rates}
    top_weight = _poisson(float(n), n)[n]  # chance that Poisson draws number n in all
    wins = {m: 0.0 for m, _ in classes}
    for k in range(1, n + 1):
        live = [m for m, r, _ in rates if r * series[m][k] > NEGLIGIBLE * top_weight]
        if not live:
            continue
        nodes, weights = np.polynomial.legendre.leggauss((n // k) // 2 + 1)
        for y, w in zip((nodes + 1) / 2, weights / 2):
            factor = {}
            for m, _, _ in rates:
                f = series[m][:k + 1].copy()
                f[k] *= y
                factor[m] = f
            for m in live:
                rest = np.ones(1)
                for d, r, _ in rates:
                    rest = _times(rest, _power(factor[d], r - (d == m), n - k), n - k)
                if len(rest) > n - k:
                    wins[m] += w * series[m][k] * rest[n - k] / top_weight
    return wins


def draw_sizes(total: Column) -> Column:
    """2, 4, 8, ... below ``total``, then ``total``; nothing for one sample."""
    doubles = F.filter(F.transform(F.sequence(F.lit(1), F.lit(62)), lambda k: F.pow(F.lit(2.0), k).cast("long")), lambda x: x < total)
    return F.when(total > 1, F.concat(doubles, F.array(total.cast("long"))))


def class_sizes(votes: DataFrame, prompt: list[str], size: str = "size", sums: tuple[str, ...] = ()) -> DataFrame:
    """(prompt, total, sizes, sums): per prompt the number of samples, its class
    sizes as a list (size, number of classes of that size, next size, ...) and,
    for each column in ``sums``, its sums over the classes of each size.

    ``votes`` has a row per prompt and class. They are read in order of size and
    classes of one size are added up as they come, so what a task holds of a
    prompt has at most sqrt(2 N) entries."""
    by_size = Window.partitionBy(*prompt).orderBy(size)
    rows = votes.select(*prompt, F.col(size).cast("long").alias("_m"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in sums],
                        (F.row_number().over(by_size) == 1).alias("_first"))
    shape = StructType([rows.schema[c] for c in prompt]).add("total", "long").add("sizes", ArrayType(LongType()))
    for c in sums:
        shape = shape.add(c, ArrayType(DoubleType()))

    def read(batches):
        held = None  # the last group so far, which may go on: its keys, sizes, numbers of classes, sums
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = pa.Table.from_batches([batch.select(prompt)])
            first = batch.column("_first").to_numpy(zero_copy_only=False)
            m, r = batch.column("_m").to_numpy(), np.ones(batch.num_rows, np.int64)
            sums_ = [batch.column(c).to_numpy() for c in sums]
            row = np.arange(batch.num_rows)
            if held is not None:
                row = np.concatenate([np.zeros(len(held[1]), np.int64), row + 1])
                keys = pa.concat_tables([held[0], keys])
                first = np.concatenate([np.arange(len(held[1])) == 0, first])
                m, r, *sums_ = [np.concatenate([a, b]) for a, b in zip(held[1:], [m, r, *sums_])]
            at = np.flatnonzero(first | (np.diff(m, prepend=-1) != 0))
            r, *sums_ = [np.add.reduceat(x, at) for x in (r, *sums_)]
            m, row, begin = m[at], row[at], np.flatnonzero(first[at])
            last = begin[-1]
            held = (keys.slice(row[last], 1), m[last:], r[last:], *[x[last:] for x in sums_])
            if last:
                yield from listed(keys.take(row[begin[:-1]]), begin, m, r, sums_)
        if held is not None:
            yield from listed(held[0], np.array([0, len(held[1])]), held[1], held[2], held[3:])

    def listed(keys, begin, m, r, sums_):
        end = begin[-1]
        total = np.add.reduceat((m * r)[:end], begin[:-1])
        lists = [pa.ListArray.from_arrays(begin.astype(np.int32) * 2, np.column_stack([m, r])[:end].ravel()),
                 *[pa.ListArray.from_arrays(begin.astype(np.int32), x[:end]) for x in sums_]]
        named = keys.append_column("total", pa.array(total))
        for c, x in zip(("sizes", *sums), lists):
            named = named.append_column(c, x)
        yield from named.combine_chunks().to_batches()

    return rows.mapInArrow(read, shape)


def laws(shapes: DataFrame) -> DataFrame:
    """(sizes, n, win): the law of each distinct ``sizes`` and draw size n, as the
    winning probability of one class of each size."""
    asked = shapes.select("sizes", "total").distinct().select("sizes", F.explode(draw_sizes(F.col("total"))).alias("n"))

    def solve(batches):
        for batch in batches:
            asked = list(zip(batch.column("sizes").to_pylist(), batch.column("n").to_pylist()))
            won = [list(majority_law(list(zip(s[::2], s[1::2])), n).values()) for s, n in asked]
            yield pa.RecordBatch.from_arrays([batch.column("sizes"), batch.column("n"), pa.array(won, pa.list_(pa.float64()))],
                                             names=["sizes", "n", "win"])

    # few rows, each of some work: deal them out one by one
    return asked.repartition("sizes", "n").mapInArrow(solve, "sizes array<long>, n long, win array<double>")


def majority_moments(long: DataFrame, prompt: list[str], var: str, vote: str, value: str) -> DataFrame:
    """(prompt, var, n, maj_mean, maj_std): moments of the majority vote's value.

    ``long`` has a row per sample and variable. A null vote is a class like any
    other. Class sizes are counted per variable, so a variable that some samples
    lack is judged by the samples it has. Rows of a prompt are reduced to one per
    class before anything is gathered, so a hot prompt costs its classes; as a
    law depends on sizes alone, one row per prompt is joined with its law. Rows
    with a null key belong to no prompt and are left out."""
    keys = [*prompt, var]
    named = reduce(and_, (F.col(k).isNotNull() for k in keys))
    per = long.where(named).groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("size"), F.avg(value).alias("_m1"),
                                        F.avg(F.col(value) * F.col(value)).alias("_m2"))
    shapes = class_sizes(per, keys, sums=("_m1", "_m2"))
    expected = lambda x: F.aggregate(F.zip_with("win", x, lambda p, m: p * m), F.lit(0.0), lambda a, b: a + b)
    return shapes.join(laws(shapes), "sizes").select(*keys, "n", expected("_m1").alias("maj_mean"), expected("_m2").alias("_sq")) \
        .withColumn("maj_std", F.sqrt(F.greatest(F.col("_sq") - F.col("maj_mean") * F.col("maj_mean"), F.lit(0.0)))).drop("_sq")
