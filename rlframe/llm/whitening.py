"""Whitening of vectors by their principal components, with Jacobi-Davidson.

The covariance matrix V of the distinct vectors is never formed. Every product
of V with a block of directions is one Spark job over the vectors: each task
centres its rows exactly (whole numbers), multiplies them with the block twice
and hands on one small sum. A search space grows until it holds the leading
eigenvectors:

1. Rayleigh-Ritz: the eigenvectors of V restricted to the space, and their
   residuals r = V u - e u;
2. pairs whose residual is at rounding level are locked;
3. for each other wanted pair the correction equation
   (1 - U U') (V - e) (1 - U U') t = -r, U all locked and wanted vectors, is
   solved roughly by a few steps of MINRES; all wanted pairs step together, so
   a step costs one job whatever their number;
4. the corrections, made orthogonal, extend the space; when it is full it
   restarts from its best vectors.

The driver holds blocks of ``dimension`` x a few dozen numbers, never a matrix
of ``dimension`` x ``dimension`` products of rows and never the vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rlframe.llm.shared import staged

#: x = floor(SCALE * entry) + SHIFT
SCALE, SHIFT = 64, 1_000_000
#: Residual, as a multiple of rounding in ``dimension`` terms, that counts as zero.
ROUNDING = 8.0
INNER_STEPS = 4
OUTER_STEPS = 60
SPARE = 8
#: A component below this share of the variance is no component.
NO_VARIANCE = 1e-12


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * SCALE).cast("long") + SHIFT)


@dataclass
class Fit:
    """The distinct vectors: a table of ``x``, their number and sums."""

    rows: DataFrame
    n: int
    sums: np.ndarray

    @property
    def dimension(self) -> int:
        return len(self.sums)


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows minus the mean: the difference n x - S is exact, then one division."""
    return (n * x - sums) / n


class Covariance:
    """Products with the covariance of the fit list, one job each."""

    def __init__(self, fit: Fit):
        self.fit = fit
        self.jobs = 0

    def _sum_over_rows(self, piece, shape: tuple[int, int]) -> np.ndarray:
        """The sum of ``piece(centred rows)`` over all rows, added up by Spark."""
        n, sums = self.fit.n, self.fit.sums

        def partial(batches):
            total = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    total += piece(_centred(_matrix(batch.column("x")), n, sums))
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["part"])

        self.jobs += 1
        parts = self.fit.rows.mapInArrow(partial, "part array<double>")
        cells = parts.select(F.posexplode("part").alias("cell", "value")).groupBy("cell").agg(F.sum("value").alias("value"))
        out = np.zeros(shape[0] * shape[1])
        for cell, value in cells.collect():  # dimension x block numbers
            out[cell] = value
        return out.reshape(shape)

    def times(self, block: np.ndarray) -> np.ndarray:
        """V times the columns of ``block``."""
        return self._sum_over_rows(lambda z: z.T @ (z @ block), block.shape) / self.fit.n

    def trace(self) -> float:
        return float(self._sum_over_rows(lambda z: np.array([[np.einsum("ij,ij->", z, z)]]), (1, 1))[0, 0]) / self.fit.n

    def of_projections(self, directions: np.ndarray) -> np.ndarray:
        """The covariance matrix of the rows' projections."""
        k = directions.shape[1]

        def piece(z):
            y = z @ directions
            return y.T @ y

        return self._sum_over_rows(piece, (k, k)) / self.fit.n


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The part of ``block`` outside ``against``, as orthonormal columns."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    if not block.size:
        return block
    q, _, _ = np.linalg.svd(block, full_matrices=False)
    rank = np.linalg.matrix_rank(block, tol=1e-10)
    q = q[:, :rank]
    for _ in range(2):
        q = q - against @ (against.T @ q)
        q, _ = np.linalg.qr(q)
    return q


def minres_block(times, shifts: np.ndarray, right: np.ndarray, project, steps: int) -> np.ndarray:
    """``steps`` of MINRES for (P (V - shift_i) P) t_i = right_i, all i in step.

    ``times`` multiplies a block by V; ``project`` applies P. Column i stops
    changing when its Lanczos vector vanishes."""
    n, k = right.shape
    v_old, v = np.zeros((n, k)), project(right)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v = np.where(live, v / np.where(live, beta, 1), 0)
    t, d_old, d_older = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    left = beta.copy()  # what is left of the residual
    cos_old = np.ones(k), np.ones(k)
    sin_old = np.zeros(k), np.zeros(k)
    beta = np.zeros(k)
    first = np.linalg.norm(project(right), axis=0)
    for _ in range(steps):
        if not live.any():
            break
        w = project(times(v) - v * shifts) - v_old * beta
        alpha = np.einsum("ij,ij->j", v, w)
        w = w - v * alpha
        beta_new = np.linalg.norm(w, axis=0)
        # the two last rotations, then a new one, on the column of the tridiagonal matrix
        (c1, c2), (s1, s2) = cos_old, sin_old
        eps = s1 * beta
        delta = c2 * (c1 * beta) + s2 * alpha
        gamma = -s2 * (c1 * beta) + c2 * alpha
        rho = np.hypot(gamma, beta_new)
        ok = live & (rho > 1e-300)
        rho1 = np.where(ok, rho, 1)
        c, s = np.where(ok, gamma / rho1, 1), np.where(ok, beta_new / rho1, 0)
        d = np.where(ok, (v - d_old * delta - d_older * eps) / rho1, 0)
        t = t + np.where(ok, d * (c * left), 0)
        left = np.where(ok, -s * left, left)
        live = ok & (beta_new > 1e-14 * first)
        v_old, v = v, np.where(live, w / np.where(live, beta_new, 1), 0)
        d_older, d_old = d_old, d
        cos_old, sin_old = (c2, c), (s2, s)
        beta = np.where(live, beta_new, 0)
    return t


def leading_pairs(times, dimension: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues (falling) and their unit eigenvectors of a
    symmetric positive map given by its products, and the largest residual as a
    share of the largest eigenvalue.

    Raises if a residual stays above rounding level after ``OUTER_STEPS``."""
    wanted = min(wanted, dimension)
    most = min(dimension, 4 * wanted + 2 * SPARE)
    space = _orthonormal(np.random.default_rng(seed).normal(size=(dimension, min(dimension, wanted + SPARE))),
                         np.zeros((dimension, 0)))
    image = times(space)
    for step in range(OUTER_STEPS + 1):
        small = space.T @ image
        values, s = np.linalg.eigh((small + small.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        ritz, ritz_image = space @ s, image @ s
        u, e = ritz[:, :wanted], values[:wanted]
        residual = ritz_image[:, :wanted] - u * e
        size = np.linalg.norm(residual, axis=0)
        limit = ROUNDING * dimension * np.finfo(float).eps * max(values[0], 0)
        if (size <= limit).all():
            residual = times(u) - u * e  # of a fresh product, not of sums of older ones
            size = np.linalg.norm(residual, axis=0)
            if (size <= limit).all() or not e[0] > 0:
                return e, u, float(size.max() / max(e[0], 1e-300))
            image = times(space)  # rounding has built up in the images
            if step and space.shape[1] == dimension:
                raise RuntimeError(f"residual {size.max():.3g} above {limit:.3g} in the whole space")
            continue
        open_ = size > limit  # locked pairs stay in U and get no correction
        project = lambda x: x - u @ (u.T @ x)
        t = minres_block(times, e[open_], -residual[:, open_], project, INNER_STEPS)
        if space.shape[1] + open_.sum() > most and space.shape[1] > wanted + SPARE:
            kept = max(wanted + SPARE, 0)
            space, image = ritz[:, :kept], ritz_image[:, :kept]
        new = _orthonormal(t, space)[:, :dimension - space.shape[1]]
        if not new.size:  # the corrections are in the space already
            new = _orthonormal(np.random.default_rng(seed + step + 1).normal(size=(dimension, int(open_.sum()))), space)
            new = new[:, :dimension - space.shape[1]]
            if not new.size:
                space, _ = np.linalg.qr(space)
                image = times(space)
                continue
        space, image = np.hstack([space, new]), np.hstack([image, times(new)])
    raise RuntimeError(f"no convergence: residual {size.max():.3g}, limit {limit:.3g}")


def fit_list(vectors: DataFrame) -> Fit:
    """The distinct ``x`` of ``vectors``, staged, with their number and sums.

    Equal vectors are merged before the shuffle, so a vector that a third of
    all rows hold costs a row per task."""
    rows = staged(vectors.select("x").distinct(), "fit-list")
    sums = rows.select(F.posexplode("x").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    got = sorted(sums.collect())  # one row a dimension
    return Fit(rows, got[0].n if got else 0, np.array([r.s for r in got], np.int64))


def common_dimension(lengths: DataFrame) -> int:
    """The most frequent length of ``lengths.size`` (ties: the larger); 0 if none."""
    got = lengths.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return got[0]["size"] if got else 0


def _exact_squares(difference: np.ndarray) -> np.ndarray:
    """Row sums of squares of whole numbers, or an error beyond 64 bits."""
    top = int(np.abs(difference).max(initial=0))
    if top * top * difference.shape[1] < 2 ** 63:
        return np.einsum("ij,ij->i", difference, difference)
    sums = [sum(int(v) * int(v) for v in row) for row in difference]
    if max(sums) >= 2 ** 63:
        raise OverflowError("a deviation exceeds 64 bits")
    return np.array(sums, np.int64)


def whitened_vectors(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component, with the fit's figures.

    ``id``, component (from 1, by falling eigenvalue), n (distinct vectors),
    deviation (exact sum of (n x - S)^2), whitened (the projection of x - S/n on
    the component, over the square root of its eigenvalue), explained (the
    eigenvalue's share of the trace), identity_error (largest entry by which
    the covariance of the whitened fit list, measured in a pass of its own,
    differs from the identity).

    Vectors that are null or hold a null or non-finite entry are dropped, as
    are vectors whose length is not the most common one (ties: the longer).
    There are as many components as asked for, or as directions with variance
    if these are fewer: one vector, or equal ones only, give no rows, like an
    empty table. Equal vectors count once in the fit and each get their rows;
    repeated and null ids stay as they are; other columns are not read.
    Entries must be below 2^40 in size."""
    spark = vectors.sparkSession
    clean = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    dimension = common_dimension(clean.select(F.size("v").alias("size")))
    rows = clean.filter(F.size("v") == dimension).select("vec_id", whole_numbers(F.col("v")).alias("x"))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, " \
             "explained double, identity_error double"
    fit = fit_list(rows) if dimension else None
    if fit is None or fit.n == 0:
        return spark.createDataFrame([], schema)
    v = Covariance(fit)
    trace = v.trace()
    values, directions, _ = leading_pairs(v.times, fit.dimension, components) if trace > 0 else (np.zeros(0), np.zeros((dimension, 0)), 0)
    real = values > NO_VARIANCE * trace
    values, directions = values[real], directions[:, real]
    if not len(values):
        return spark.createDataFrame([], schema)
    scaled = directions / np.sqrt(values)
    error = float(np.abs(v.of_projections(scaled) - np.eye(len(values))).max())
    n, sums, k = fit.n, fit.sums, len(values)
    explained = values / trace

    def project(batches):
        for batch in batches:
            m = batch.num_rows
            x = _matrix(batch.column("x")) if m else np.zeros((0, dimension), np.int64)
            difference = n * x - sums
            y = (difference / n) @ scaled
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n), pa.int64()), pa.array(np.repeat(_exact_squares(difference), k), pa.int64()),
                pa.array(y.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
