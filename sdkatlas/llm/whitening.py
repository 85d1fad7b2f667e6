"""Whitening of embeddings by an incremental eigendecomposition.

Vectors become integers, floor(SCALE * x). Each distinct vector is fitted on once. A task holds the spectrum of the scatter of what it has seen:
eigenvalues, eigenvectors, the exact count and sums. A new vector adds one centred rank-one term; its eigenvalues are the roots of the secular
equation between the old ones, its eigenvectors follow from them. Deflation comes first: components that the vector doesn't touch keep their
eigenvalue, equal eigenvalues are turned so that one of them is not touched. Spectra of tasks are combined FAN at a time, round by round: one is
added to the other as rank-one terms, one for each eigenvector and one for the distance of their means. At last the basis is refined: every task
projects its exactly centred vectors on it (Rayleigh-Ritz), the small matrices are added up, and one small eigenproblem turns the basis.

What a task holds is one spectrum (dimensions squared numbers), and so is what the driver gets, whatever the number of rows.

Rows whose vector is null or has a null or non-finite entry are dropped, and so are those whose length is not the commonest one (the longer of
equally common ones), since they have no covariance with the others. Repeated rows and equal vectors count once in the fit and all come back; null
vec_ids stay null. Fewer dimensions than COMPONENTS: so many components. A component without variance (a single distinct vector, or vectors in a
plane) has whitened 0, and identity_error is then 1. Equal eigenvalues: any basis of their plane, the same for all rows. A deviation beyond a long is null.
An integer beyond a long is the nearest long. Without rows the result is empty. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sdkatlas.llm import common

SCALE, COMPONENTS = 256, 4
FAN = 16  # parts that are combined at once
EPS = np.finfo(np.float64).eps
STEPS, PRECISE = 60, 1e-13  # of the secular equation; rounding is PRECISE of the sum of its terms
LONGEST = (1 << 63) - 1
#: An eigenvalue below this share of the largest is none: rounding alone makes as much.
LEAST_VARIANCE = 1e-12
PART = "part long, n long, sums binary, matrix binary"


def deflate(values: np.ndarray, vectors: np.ndarray, w: np.ndarray, rho: float) -> np.ndarray:
    """Turns vectors with (almost) equal values so that only one of them has a weight in w; returns the places that stay in the problem.
    values ascend; vectors and w are changed in place."""
    size = rho * float(w @ w)
    tolerance = 8 * EPS * max(float(np.abs(values).max(initial=0.0)), size)
    w[rho * np.abs(w) * np.sqrt(max(float(w @ w), 0.0)) <= tolerance] = 0.0
    used = np.flatnonzero(w)
    for i, j in zip(used[:-1].tolist(), used[1:].tolist(), strict=True):
        if values[j] - values[i] <= tolerance:
            r = np.hypot(w[i], w[j])
            c, s = w[j] / r, w[i] / r
            vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
            w[i], w[j] = 0.0, r
    return np.flatnonzero(w)


def secular_roots(values: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 = sum of squares / (root - values), one above each of the ascending values and the last at most their sum above it:
    as (place of the nearer value, distance from it). Newton's steps on a pair of poles, kept inside shrinking brackets."""
    n = len(values)
    right = np.r_[values[1:], values[-1] + squares.sum()]
    gap = right - values
    middle = 1 - (squares[None, :] / ((values[:, None] - values[None, :]) + gap[:, None] / 2)).sum(1)
    near_left = (middle >= 0) | (np.arange(n) == n - 1)  # the function rises between two poles
    origin = np.where(near_left, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    poles = values[None, :] - values[origin][:, None]
    # brackets of the distance from the origin
    low = np.where(near_left, 0.0, -gap / 2)
    high = np.where(near_left, np.where(middle >= 0, gap / 2, gap), 0.0)
    low[-1] = 0.0 if middle[-1] >= 0 else gap[-1] / 2
    at = (low + high) / 2
    open_ = np.arange(n)
    column = np.arange(n)
    for _ in range(STEPS):
        t, p, place = at[open_], poles[open_], open_
        inverse = 1 / (t[:, None] - p)
        parts = squares * inverse
        below = column <= place[:, None]
        left, all_ = (parts * below).sum(1), parts.sum(1)
        value, size = 1 - all_, 1 + 2 * left - all_  # parts are positive up to the pole on the left, negative beyond it
        parts *= inverse
        slope_left, slopes = (parts * below).sum(1), parts.sum(1)
        slope_right = slopes - slope_left
        rising = value > 0
        low[open_], high[open_] = np.where(rising, low[open_], t), np.where(rising, t, high[open_])
        # the function as c - a / (distance from the pole on the left) + b / (distance to the one on the right), equal in value and slopes;
        # s is the step to its root: c (d1 + s)(d2 - s) - slope_left d1^2 (d2 - s) + slope_right d2^2 (d1 + s) = 0
        last, row = place == n - 1, np.arange(len(place))
        d1 = t - p[row, place]
        d2 = np.where(last, 0.0, p[row, np.minimum(place + 1, n - 1)] - t)
        a, b = slope_left * d1 * d1, slope_right * d2 * d2
        c = value + slope_left * d1 - slope_right * d2
        with np.errstate(all="ignore"):
            half, constant = (c * (d2 - d1) + a + b) / 2, value * d1 * d2
            q = -(half + np.copysign(np.sqrt(np.maximum(half * half + c * constant, 0.0)), half))
            step = np.where(last, -value * d1 / c, constant / q)
            other = np.where(last, np.nan, -q / c)
        inside = lambda v: (v > low[open_]) & (v < high[open_])
        new = np.where(inside(t + step), t + step, np.where(inside(t + other), t + other, (low[open_] + high[open_]) / 2))
        done = (np.abs(value) <= PRECISE * size) | (high[open_] - low[open_] <= 2 * EPS * np.maximum(np.abs(low[open_]), np.abs(high[open_])))
        at[open_] = np.where(done, t, new)
        open_ = open_[~done]
        if not len(open_):
            break
    return origin, at


def rank_one(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of vectors @ diag(values) @ vectors.T + rho z z.T, values ascending."""
    w = vectors.T @ z
    if rho <= 0 or not w.any():
        return values, vectors
    vectors = vectors.copy()
    used = deflate(values, vectors, w, rho)
    if not len(used):
        return values, vectors
    d, squares = values[used], rho * w[used] ** 2
    origin, distance = secular_roots(d, squares)
    roots = d[origin] + distance
    apart = (d[origin][None, :] - d[:, None]) + distance[None, :]  # root k minus value i, from the nearer pole so that nothing cancels
    # the weights for which these roots are exact, so that the vectors are orthogonal
    n = len(d)
    difference = d[None, :] - d[:, None]
    ratio = np.abs(apart) / np.where(np.eye(n, dtype=bool), 1.0, np.abs(np.where(difference == 0, 1.0, difference)))
    exact = np.sqrt(np.prod(ratio, axis=1)) * np.sign(w[used])
    turned = exact[:, None] / np.where(apart == 0, EPS, apart)
    turned /= np.sqrt((turned * turned).sum(0))
    values, found = values.copy(), vectors[:, used] @ turned
    values[used], vectors[:, used] = roots, found
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Of the scatter about the mean of n vectors; sums are exact integers."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(size: int) -> Spectrum:
        return Spectrum(0, [0] * size, np.zeros(size), np.eye(size))

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def add(self, x: np.ndarray, mean: np.ndarray) -> None:
        """One vector (its sums are kept by the caller); mean is that of the n vectors before it."""
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, x - mean, self.n / (self.n + 1))
        self.n += 1

    def combine(self, other: Spectrum) -> None:
        if not other.n:
            return
        if not self.n:
            self.n, self.sums, self.values, self.vectors = other.n, other.sums, other.values, other.vectors
            return
        apart = self.mean() - other.mean()
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * other.n / (self.n + other.n))
        self.n, self.sums = self.n + other.n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]


def _numbers(sums: list[int]) -> bytes:
    return ",".join(map(str, sums)).encode()


def _integers(data) -> list[int]:
    return [int(v) for v in bytes(data).split(b",")]


def _columns_sum(x: np.ndarray) -> list[int]:
    if np.abs(x).max(initial=0) < LONGEST // max(1, len(x)):
        return [int(v) for v in x.sum(0)]
    return [sum(int(v) for v in column) for column in x.T]


def spectra(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The spectrum of a task's vectors."""
    found, mean = Spectrum.empty(size), np.zeros(size)
    for batch in batches:
        if not len(batch):
            continue
        x = np.stack(list(batch["x"]))
        for row in x.astype(np.float64):
            found.add(row, mean)
            mean = mean + (row - mean) / found.n
        found.sums = [a + b for a, b in zip(found.sums, _columns_sum(x), strict=True)]
        mean = found.mean()  # from the exact sums again
    if found.n:
        yield _part(TaskContext.get().partitionId(), found.n, found.sums, np.vstack([found.values, found.vectors]))


def _part(part: int, n: int, sums: list[int], matrix: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "n": [n], "sums": [_numbers(sums)], "matrix": [matrix.astype("<f8").tobytes()]})


def _spectrum(row, size: int) -> Spectrum:
    matrix = np.frombuffer(bytes(row.matrix), "<f8").reshape(size + 1, size)
    return Spectrum(int(row.n), _integers(row.sums), matrix[0], matrix[1:])


def combined(parts: DataFrame, merge: Callable[[pd.DataFrame], pd.DataFrame]):
    """Parts (PART) merged FAN at a time until one is left; that row, or None. The number of tasks sets the number of rounds."""
    parts = common.saved(parts, "parts")
    last = parts.agg(F.max("part")).first()[0]
    while last is not None:
        last //= FAN
        parts = parts.groupBy(F.floor(F.col("part") / FAN).cast("long").alias("group")).applyInPandas(merge, PART)
        if last == 0:
            return parts.first()
    return None


def combine_spectra(group: pd.DataFrame, size: int) -> pd.DataFrame:
    group = group.sort_values("part")
    first, *others = [_spectrum(row, size) for row in group.itertuples()]
    for other in others:
        first.combine(other)
    return _part(int(group["part"].iloc[0]) // FAN, first.n, first.sums, np.vstack([first.values, first.vectors]))


def add_matrices(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")
    total = sum(np.frombuffer(bytes(m), "<f8") for m in group["matrix"])
    return _part(int(group["part"].iloc[0]) // FAN, int(group["n"].sum()), [0], total)


def projected(vectors: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) of the vectors, centred exactly and then projected on the columns of basis; summed task by task."""
    mean, width = np.array([s / n for s in sums]), basis.shape[1]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, many = np.zeros((width, width)), 0
        for batch in batches:
            if len(batch):
                y = (np.stack(list(batch["x"])) - mean) @ basis
                total, many = total + y.T @ y, many + len(batch)
        if many:
            yield _part(TaskContext.get().partitionId(), many, [0], total)

    row = combined(vectors.mapInPandas(project, PART), add_matrices)
    return np.frombuffer(bytes(row.matrix), "<f8").reshape(width, width) / n


@dataclass
class Whitening:
    n: int
    sums: list[int]
    axes: np.ndarray  # dimensions x components, unit
    values: np.ndarray  # variances, falling
    trace: float
    identity_error: float

    @property
    def divisors(self) -> np.ndarray:
        """Square roots of the variances; infinite where there is none, so that whitened is 0."""
        there = self.values > LEAST_VARIANCE * max(self.trace, 0.0)
        return np.where(there, np.sqrt(np.where(there, self.values, 1.0)), np.inf)


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """From the distinct vectors (x, array of long, all of `size`)."""
    row = combined(vectors.mapInPandas(lambda batches: spectra(batches, size), PART), lambda group: combine_spectra(group, size))
    if row is None:
        return None
    found = _spectrum(row, size)
    basis = np.linalg.qr(found.vectors[:, ::-1])[0]  # rounding off the perpendicular goes
    ritz = projected(vectors, found.n, found.sums, basis)
    values, turned = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(values, kind="stable")[::-1]
    axes = np.linalg.qr(basis @ turned[:, order])[0]
    made = Whitening(found.n, found.sums, axes[:, :components], np.maximum(values[order], 0.0)[:components], float(np.trace(ritz)), 0.0)
    white = projected(vectors, found.n, found.sums, made.axes / made.divisors)
    made.identity_error = float(np.abs(white - np.eye(len(made.values))).max())
    return made


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n x - S)^2, exact; None beyond a long."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if largest * largest * x.shape[1] <= LONGEST:
        past = n * x - np.array(sums)
        return (past * past).sum(1).tolist()
    totals = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x)
    return [t if t <= LONGEST else None for t in totals]


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int | None]:
    """vec_id, x (array of long) of the remaining rows, saved, and their length."""
    v = F.col("v")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = embeddings.select("vec_id", F.col("embedding").alias("v")).filter(v.isNotNull()).filter(~bad)
    rows = common.saved(kept.select("vec_id", F.transform(v, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("x")), "vectors")
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None or not lengths[0]:
        return rows.limit(0), None
    return rows.filter(F.size("x") == lengths[0]), lengths[0]


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, size = whole_vectors(embeddings, scale)
    made = None if size is None else fit(common.saved(rows.select("x").distinct(), "fit-list"), size, components)
    if made is None:
        return embeddings.sparkSession.createDataFrame([], schema)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, axes, k = np.array([s / made.n for s in made.sums]), made.axes / made.divisors, len(made.values)
        explained = made.values / made.trace if made.trace > 0 else np.zeros(k)
        for batch in batches:
            if len(batch):
                x = np.stack(list(batch["x"]))
                yield pd.DataFrame({
                    "vec_id": np.repeat(batch["vec_id"].array, k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": made.n,
                    "deviation": pd.array(np.repeat(np.array(deviations(x, made.n, made.sums), dtype=object), k), dtype="Int64"),
                    "whitened": ((x - mean) @ axes).ravel(), "explained": np.tile(explained, len(x)), "identity_error": made.identity_error})

    return rows.mapInPandas(judge, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))
