"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps the spectrum of the scatter of its own vectors and takes in
one vector at a time as a centred rank-one update: with the spectrum as it is,
new eigenvalues are the roots of a secular equation, and directions that the
update does not touch are deflated. Spectra of partitions are merged in a tree by
rank-one updates too. The directions that come out are refined by one pass over
all vectors (Rayleigh-Ritz), so rounding in long chains of updates does not stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflow.llm.words import sliced
from bibflow.runtime import materialise

SCALE = 256
_EPS = np.finfo(np.float64).eps
_FAN_IN = 8
_LARGEST = 1 << 53


def _roots(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(weights / (values - x))``: for each, the pole nearest to it and its distance from that pole.

    ``values`` rise strictly and ``weights`` are positive, so a root lies above
    each pole and below the next one. Distances from the nearest pole keep their
    relative precision. All roots are found at once: steps of a rational model of
    the equation, and halving where a step would leave the root's bracket.
    """
    n = len(values)
    upper = np.append(values[1:], values[-1] + weights.sum())
    gaps = values[:, None] - values[None, :]  # gaps[j, i]: pole j from pole i
    half = (upper - values) / 2
    at_middle = 1 + (weights[:, None] / (gaps - half[None, :])).sum(0)
    near = np.arange(n)
    near[:-1] += at_middle[:-1] <= 0  # the root is in the upper half: its nearest pole is the next
    last, left = np.arange(n) == n - 1, near == np.arange(n)
    shifted = values[:, None] - values[near][None, :]
    low = np.where(left, 0.0, -half)
    high = np.where(left, half, 0.0)
    low[-1], high[-1] = (half[-1], 2 * half[-1]) if at_middle[-1] <= 0 else (0.0, half[-1])
    x = (low + high) / 2
    below = np.arange(n)[:, None] <= np.arange(n)[None, :]
    for _ in range(100):
        gap = shifted - x[None, :]
        terms = weights[:, None] / gap
        f = 1 + terms.sum(0)
        done = np.abs(f) <= 8 * n * _EPS * (1 + np.abs(terms).sum(0))
        low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
        done |= (high - low) <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            break
        # Poles below and above the root, each side as one pole with the same value and slope.
        slopes = terms / gap
        s_low, s_high = (slopes * below).sum(0), (slopes * ~below).sum(0)
        d_low = (values - values[near]) - x
        d_high = np.where(last, 1.0, (upper - values[near]) - x)
        a, b, c = s_low * d_low ** 2, s_high * d_high ** 2, f - s_low * d_low - s_high * d_high
        with np.errstate(all="ignore"):
            # c + a / (d_low - t) + b / (d_high - t) = 0, and no pole above the last root
            lin, con = c * (d_low + d_high) + a + b, c * d_low * d_high + a * d_high + b * d_low
            root = np.sqrt(np.maximum(lin * lin - 4 * c * con, 0))
            t = np.where(lin > 0, 2 * con / (lin + root), (lin - root) / (2 * c))
            step = x + np.where(last, d_low + a / c, t)
        x = np.where(done, x, np.where((step > low) & (step < high), step, (low + high) / 2))
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, weight: float, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) after ``weight * vector * vector'`` is added; ``weight`` is positive."""
    z = vectors.T @ vector
    size = weight * float(z @ z)
    if not size > 0:
        return values, vectors
    order = np.argsort(values, kind="stable")
    values, vectors, z = values[order].copy(), vectors[:, order].copy(), z[order] * np.sqrt(weight)
    tol = 8 * _EPS * max(abs(values[-1]), abs(values[0]), size)
    # Deflation: directions that the update misses stay, and of equal values all but one are turned out of its way.
    live = [i for i in range(len(z)) if abs(z[i]) * np.sqrt(size) > tol]
    kept: list[int] = []
    for i in live:
        if kept and values[i] - values[kept[-1]] <= tol:
            j = kept.pop()
            r = np.hypot(z[i], z[j])
            c, s = z[i] / r, z[j] / r
            vectors[:, [j, i]] = np.column_stack([c * vectors[:, j] - s * vectors[:, i], s * vectors[:, j] + c * vectors[:, i]])
            z[i], z[j] = r, 0.0
        kept.append(i)
    if not kept:
        return values, vectors
    poles, w = values[kept], z[kept]
    near, away = _roots(poles, w * w)
    # gap[j, i] = pole j - root i, without cancellation
    gap = (poles[:, None] - poles[near][None, :]) - away[None, :]
    # The weights for which these roots are exact, so that the new directions are orthogonal.
    steps = poles[:, None] - poles[None, :]
    np.fill_diagonal(steps, 1.0)
    exact = np.sign(w) * np.exp(np.log(np.abs(gap / steps)).sum(1) / 2)
    mix = exact[:, None] / gap
    mix /= np.sqrt((mix * mix).sum(0))
    vectors[:, kept] = vectors[:, kept] @ mix
    values[kept] = poles[near] + away
    return values, vectors


@dataclass
class Spectrum:
    """How many vectors, their mean, and the eigenvalues and eigenvectors of the sum of their centred squares."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n / (self.n + 1), away)
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """Take in another spectrum, direction by direction, and the distance of the means."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, float(value), vector)
        both, away = self.n + other.n, other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, self.n * other.n / both, away)
        self.mean = self.mean + away * (other.n / both)
        self.n = both


@dataclass
class Whitening:
    """A fitted whitening: ``components`` are rows, by falling ``values``; fewer than asked for if the rank is lower."""

    width: int
    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def usable(vector: Column, width: int | None = None) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    there = vector.isNotNull() & (F.size(vector) > 0) if width is None else F.size(vector) == width
    return F.coalesce(there & fine, F.lit(False))


def _scaled(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and (np.abs(flat.astype(np.float64)) > _LARGEST).any():
        raise ValueError("an entry is too large for whitening: 256 times it must stay within 2**53")
    return flat.reshape(-1, width)


_SPECTRUM = "place bigint, n bigint, sums array<bigint>, mean array<double>, `values` array<double>, vectors array<double>"


def _spectrum_batch(place: int, s: Spectrum, sums: np.ndarray) -> pa.RecordBatch:
    lists = [pa.array([x.tolist()], pa.list_(k)) for x, k in (
        (sums, pa.int64()), (s.mean, pa.float64()), (s.values, pa.float64()), (s.vectors.ravel(), pa.float64()))]
    return pa.RecordBatch.from_arrays(
        [pa.array([place], pa.int64()), pa.array([s.n], pa.int64()), *lists], names=["place", "n", "sums", "mean", "values", "vectors"])


def _spectrum(row: dict, width: int) -> Spectrum:
    return Spectrum(row["n"], np.array(row["mean"]), np.array(row["values"]), np.array(row["vectors"]).reshape(width, width))


def _spectra(fit: DataFrame, width: int) -> DataFrame:
    """One spectrum and the exact sums of each partition."""
    def run(stream):
        s, sums = Spectrum.empty(width), np.zeros(width, np.int64)
        for batch in stream:
            x = _matrix(batch.column("x"), width)
            sums += x.sum(0)
            for row in x.astype(np.float64):
                s.add(row)
        if s.n:
            yield _spectrum_batch(TaskContext.get().partitionId(), s, sums)

    return fit.mapInArrow(run, _SPECTRUM)


def _merged(spectra: DataFrame, width: int) -> tuple[Spectrum, np.ndarray]:
    """All spectra as one, some at a time in a tree, so no task and not the driver holds many."""
    def run(key, table):
        table = table.sort_by("place")
        whole, sums = Spectrum.empty(width), np.zeros(width, np.int64)
        for row in table.to_pylist():
            whole.merge(_spectrum(row, width))
            sums += np.array(row["sums"], np.int64)
        return pa.Table.from_batches([_spectrum_batch(key[0].as_py(), whole, sums)])

    level = materialise(spectra, "spectra")
    while level.count() > 1:
        grouped = level.groupBy(F.floor(F.col("place") / _FAN_IN).alias("group"))
        level = materialise(grouped.applyInArrow(run, _SPECTRUM), "spectra")
    row = level.first()
    return _spectrum(row.asDict(), width), np.array(row["sums"], np.int64)


def _products(fit: DataFrame, width: int, centre: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The sum over all vectors of the products of their centred projections; partitions add theirs up first."""
    k = directions.shape[1]

    def run(stream):
        total = np.zeros((k, k))
        for batch in stream:
            y = (_matrix(batch.column("x"), width) - centre) @ directions
            total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"])

    cells = fit.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(k * k)
    out[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    return out.reshape(k, k)


def common_width(vectors: DataFrame, vector: str) -> int:
    """The length that most usable vectors have, the larger of equals; 0 if there is none."""
    lengths = vectors.where(usable(F.col(vector))).groupBy(F.size(vector).alias("width")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    return first["width"] if first else 0


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 4) -> Whitening:
    """Principal directions of ``floor(256 * entry)``, each distinct vector once.

    Takes the usable vectors of the most frequent length: not null, all entries
    finite. The covariance has divisor n. Components whose eigenvalue is below
    1e-12 of the largest are left out, so a table of one distinct vector has none,
    and an empty one neither. The driver and each task hold matrices of width x width.
    """
    width = common_width(vectors, vector)
    if not width:
        return Whitening(0, 0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    distinct = vectors.where(usable(F.col(vector), width)).select(_scaled(F.col(vector)).alias("x")).distinct()
    rows = materialise(distinct, "whitening")
    rough, sums = _merged(_spectra(rows, width), width)
    n, centre = rough.n, sums / rough.n
    directions = np.linalg.qr(rough.vectors[:, np.argsort(-rough.values)])[0]
    small = _products(rows, width, centre, directions) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(small))
    best = best[values[best] > max(1e-12 * values.max(), 0.0)]
    chosen = directions @ turn[:, best]
    chosen /= np.sqrt((chosen * chosen).sum(0))
    identity_error = 0.0
    if len(best):
        cov = _products(rows, width, centre, chosen / np.sqrt(values[best])) / n
        identity_error = float(np.abs(cov - np.eye(len(best))).max())
    return Whitening(width, n, sums, chosen.T, values[best], values[best] / trace if len(best) else values[best], identity_error)


def transform(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """All columns of the usable vectors, ``deviation`` and ``whitened`` (a number per component).

    ``deviation`` is the sum over dimensions of ``(n * x - sum)^2``, exact; it raises
    if that is beyond a long. Vectors that took no part in ``fit`` for their length or
    entries have no row. Added columns replace ones of their name.
    """
    kept = [c for c in vectors.columns if c not in ("deviation", "whitened")]
    source = vectors.select(*kept).where(usable(F.col(vector), model.width) if model.width else F.lit(False))
    source = source.withColumn("_llm_x", _scaled(F.col(vector)))
    out = source.select(*kept, F.lit(0).cast("bigint").alias("deviation"), F.array().cast("array<double>").alias("whitened")).schema
    n, width, sums = model.n, model.width, model.sums
    centre = sums / max(1, n)
    directions = (model.components / np.sqrt(model.values)[:, None]).T if len(model.values) else np.zeros((width, 0))

    def run(stream):
        for batch in sliced(stream):
            x = _matrix(batch.column("_llm_x"), width).astype(np.int64)
            bound = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max())
            if bound * bound * width < 1 << 62:
                deviation = ((n * x - sums) ** 2).sum(1).tolist()
            else:
                deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]
            whitened = (x - centre) @ directions
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(deviation, pa.int64()), pa.array(list(whitened), pa.list_(pa.float64()))],
                names=[*kept, "deviation", "whitened"])

    return source.mapInArrow(run, out)
