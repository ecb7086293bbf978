"""Whitening of embeddings by an incremental eigendecomposition.

1. Every task keeps count, mean and the spectrum (eigenvalues, eigenvectors) of the scatter of the vectors
   it has read. A further vector is a centred rank-one update: its difference from the mean is turned into
   the eigenvector basis, entries of no weight and equal eigenvalues are deflated, the secular equation gives
   the new eigenvalues, and weights recomputed from these give orthogonal eigenvectors.
2. Spectra are combined in a tree, a bounded number by a task: an eigenpair of one is a rank-one update of
   the other, and so is the difference of their means.
3. The combined basis is made orthonormal, and one distributed Rayleigh-Ritz step over all vectors projects
   the covariance into it. Its eigenvectors turn the basis into the components; as the basis spans the whole
   space, they are exact to rounding however the updates have drifted.

Entries are integers, x = floor(1024 * c) + 100000, so count, sums and deviations are exact.

A task holds some matrices of dimension x dimension; a state of that size is all that is shuffled or sent to
the driver, whatever the number of vectors. The work of an update grows with the cube of the dimension.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped. Where
lengths differ, the most frequent length counts (of equally frequent ones the longest) and other rows are
dropped. Entries beyond 2 ** 42 count as 2 ** 42 with their sign. Rows with equal or null identifiers are rows
of their own. Components without variance have a null ``whitened`` and are left out of ``identity_error``; a
deviation beyond a long is null. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.session import materialized

SCALE, SHIFT, LIMIT = 1024.0, 100_000, 2.0**42
BLOCK_ROWS = 4096
COMBINED_AT_ONCE = 8
MERGE_TASKS = 1024
COMPONENTS = 8
EPS = float(np.finfo(np.float64).eps)

STATE = "part long, n long, total array<decimal(38,0)>, mean array<double>, values array<double>, basis array<double>"


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - x)) = 0 for rising poles and positive weights.

    Root i lies between pole i and the next one (the last: pole + sum of weights). Each is found as an offset
    from its nearer pole, all at once, by interpolation with two poles inside a shrinking bracket. Returns the
    roots and the matrix poles[j] - root[i] (row i), which does not suffer from cancellation.
    """
    size = len(poles)
    upper = np.append(poles[1:], poles[-1] + weights.sum())
    gaps = upper - poles
    below = np.arange(size)[None, :] <= np.arange(size)[:, None]
    apart = poles[None, :] - poles[:, None]
    # the sign at the middle of the interval tells which end is nearer
    rising = 1.0 + (weights / (apart - 0.5 * gaps[:, None])).sum(1) < 0.0
    rising[-1] = False
    shift = np.where(rising, gaps, 0.0)
    apart = apart - shift[:, None]
    if size > 1:
        at = np.flatnonzero(rising)
        apart[at, at + 1] = 0.0
    low, high = np.where(rising, -0.5 * gaps, 0.0), np.where(rising, 0.0, 0.5 * gaps)
    high[-1] = gaps[-1]
    offset = np.where(rising, 0.5 * low, 0.5 * high)
    left = np.diagonal(apart).copy()
    right = np.append(apart[np.arange(size - 1), np.arange(1, size)], gaps[-1])
    for _ in range(60):
        inverse = 1.0 / (apart - offset[:, None])
        parts = weights * inverse
        lower = np.where(below, parts, 0.0).sum(1)  # all negative; the rest is positive
        rest = parts.sum(1) - lower
        value = 1.0 + lower + rest
        slopes = parts * inverse
        slope_below = np.where(below, slopes, 0.0).sum(1)
        slope_above = slopes.sum(1) - slope_below
        low = np.where(value < 0.0, offset, low)
        high = np.where(value > 0.0, offset, high)
        bound = 4.0 * EPS * size * (1.0 - lower + rest)
        done = (np.abs(value) <= bound) | (high - low <= 2.0 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        one, two = left - offset, right - offset
        a = (one + two) * value - one * two * (slope_below + slope_above)
        b = one * two * value
        c = value - one * slope_below - two * slope_above
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4.0 * b * c, 0.0))
            step = np.where(a <= 0.0, (a - root) / (2.0 * c), 2.0 * b / (a + root))
        found = offset + step
        inside = np.isfinite(found) & (found > low) & (found < high)
        offset = np.where(done, offset, np.where(inside, found, 0.5 * (low + high)))
    return poles + shift + offset, apart - offset[:, None]


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of basis diag(values) basis' + vector vector', the values rising."""
    turned = vector @ basis
    weight = float(turned @ turned)
    if weight == 0.0:
        return values, basis
    tolerance = 8.0 * EPS * max(abs(float(values[-1])), weight)
    # equal eigenvalues: turn their eigenvectors so that one of them takes the whole weight
    edges = np.flatnonzero(np.diff(values) > tolerance) + 1
    if len(edges) < len(values) - 1:
        basis, turned = basis.copy(), turned.copy()
        for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True):
            if stop - start > 1:
                part = turned[start:stop]
                length = float(np.sqrt(part @ part))
                if length > 0.0:
                    signed = np.copysign(length, part[-1])
                    mirror = part.copy()
                    mirror[-1] += signed
                    mirror /= np.sqrt(mirror @ mirror)
                    basis[:, start:stop] -= 2.0 * np.outer(basis[:, start:stop] @ mirror, mirror)
                    turned[start:stop] = 0.0
                    turned[stop - 1] = -signed
    live = np.abs(turned) * np.sqrt(weight) > tolerance
    if not live.any():
        return values, basis
    poles, kept = values[live], turned[live]
    roots, apart = secular_roots(poles, kept * kept)
    # weights for which these roots are exact, so that the eigenvectors come out orthogonal
    gaps = poles[None, :] - poles[:, None]
    np.fill_diagonal(gaps, 1.0)
    ratios = -apart / np.where(gaps == 0.0, EPS, -gaps)
    np.fill_diagonal(ratios, -np.diagonal(apart))
    exact = np.sqrt(np.abs(np.prod(ratios, axis=0))) * np.sign(kept)
    vectors = exact[:, None] / apart.T
    vectors /= np.sqrt((vectors * vectors).sum(0))
    if live.all():
        return roots, basis @ vectors
    new_values, new_basis = values.copy(), basis.copy()
    new_values[live], new_basis[:, live] = roots, basis[:, live] @ vectors
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_basis[:, order]


@dataclass
class Spectrum:
    """Count, exact sums of x, mean of x - SHIFT, and the spectrum of the scatter around it."""

    n: int
    total: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size, object), np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, block: np.ndarray) -> None:
        """Take in the rows of ``block``, one centred rank-one update each."""
        for row in block:
            away = row - self.mean
            share = 1.0 / (self.n + 1)
            if self.n:
                self.values, self.basis = rank_one(
                    self.values, self.basis, away * np.sqrt(self.n * share)
                )
            self.mean = self.mean + away * share
            self.n += 1
        self.total = self.total + block.astype(np.int64).astype(object).sum(0) + SHIFT * len(block)

    def combine(self, other: Spectrum) -> Spectrum:
        """Both together: the eigenpairs of the smaller one and the means' difference are updates."""
        if other.n > self.n:
            return other.combine(self)
        if other.n == 0:
            return self
        values, basis = self.values, self.basis
        least = EPS * float(other.values[-1])
        for value, column in zip(other.values[::-1], other.basis.T[::-1], strict=True):
            if value > least:
                values, basis = rank_one(values, basis, column * np.sqrt(value))
        n = self.n + other.n
        away = other.mean - self.mean
        values, basis = rank_one(values, basis, away * np.sqrt(self.n * (other.n / n)))
        return Spectrum(n, self.total + other.total, self.mean + away * (other.n / n), values, basis)

    def record(self, part: int) -> pa.RecordBatch:
        decimals = pa.array([[*map(int, self.total)]], pa.list_(pa.decimal128(38, 0)))
        rows = [pa.array([[*map(float, np.ravel(v))]], pa.list_(pa.float64()))
                for v in (self.mean, self.values, self.basis)]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([self.n], pa.int64()), decimals, *rows],
            names=["part", "n", "total", "mean", "values", "basis"],
        )

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        size = len(row["mean"])
        return cls(row["n"], np.array([int(v) for v in row["total"]], object), np.array(row["mean"]),
                   np.array(row["values"]), np.array(row["basis"]).reshape(size, size))


@dataclass
class Components:
    """Unit components (columns) of all vectors, by falling variance, with the exact sums behind them."""

    n: int
    total: list[int]
    centre: np.ndarray  # of x - SHIFT
    vectors: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def scaled(self) -> np.ndarray:
        """The components over the roots of their variances; NaN where there is no variance."""
        roots = np.where(self.live, np.sqrt(np.maximum(self.variances, 0.0)), np.nan)
        return self.vectors / roots

    @property
    def live(self) -> np.ndarray:
        return self.variances > len(self.total) * 16.0 * EPS * max(self.trace, 0.0)


def _finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def usable(vectors: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """The rows that take part, and the length of their vectors (0 where there are none)."""
    rows = vectors.filter(_finite(F.col(vector_col)))
    lengths = rows.groupBy(F.size(vector_col).alias("d")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.filter(F.size(vector_col) == first["d"]), first["d"]) if first else (rows, 0)


def blocks(batch: pa.RecordBatch, column: str, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with x - SHIFT of their vectors, as doubles without a fraction."""
    for start in range(0, batch.num_rows, BLOCK_ROWS):
        part = batch.slice(start, BLOCK_ROWS)
        flat = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield part, np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).reshape(-1, size)


def spectra(rows: DataFrame, vector_col: str, size: int) -> DataFrame:
    """One state of the whole table, combined from the spectra of its tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Spectrum.empty(size)
        for batch in batches:
            for _, block in blocks(batch, vector_col, size):
                state.add(block)
        if state.n:
            yield state.record(TaskContext.get().partitionId())

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        states = sorted(table.to_pylist(), key=lambda r: r["part"])
        whole = Spectrum.of(states[0])
        for state in states[1:]:
            whole = whole.combine(Spectrum.of(state))
        return pa.Table.from_batches([whole.record(key[0].as_py())])

    tree = materialized(rows.select(vector_col).mapInArrow(read, STATE))
    parts = (tree.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // COMBINED_AT_ONCE)
        grouped = tree.withColumn("group", F.floor(F.col("part") / COMBINED_AT_ONCE))
        # a merge is work for a task of its own, however few bytes it reads
        tree = grouped.repartition(min(parts, MERGE_TASKS), "group").groupBy("group").applyInArrow(merge, STATE)
    return tree


def _gram(
    rows: DataFrame, vector_col: str, size: int, turned: Callable[[np.ndarray], np.ndarray], width: int
) -> np.ndarray:
    """Sum over all rows of z z', z = turned(x - SHIFT); every task adds up its own rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for batch in batches:
            for _, block in blocks(batch, vector_col, size):
                z = turned(block)
                gram += z.T @ z
        upper = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(gram[upper])],
            names=["i", "j", "v"],
        )

    partial = rows.select(vector_col).mapInArrow(work, "i int, j int, v double")
    out = np.zeros((width, width))
    for row in partial.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # width squared numbers
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["v"]
    return out


def fit(vectors: DataFrame, vector_col: str = "embedding", k: int = COMPONENTS) -> Components | None:
    """The first ``k`` components of all usable rows; None where there are none."""
    rows, size = usable(vectors, vector_col)
    state = spectra(rows, vector_col, size).first() if size else None
    if state is None:
        return None
    whole = Spectrum.of(state.asDict())
    n, total = whole.n, [int(v) for v in whole.total]
    centre = np.array([float(Fraction(t, n) - SHIFT) for t in total])
    basis = np.linalg.qr(whole.basis[:, ::-1])[0]
    # Rayleigh-Ritz: the covariance as the basis sees it, over all rows
    seen = _gram(rows, vector_col, size, lambda x: (x - centre) @ basis, size) / n
    variances, turn = np.linalg.eigh((seen + seen.T) / 2.0)
    turn = turn[:, ::-1][:, :k]
    found = Components(n, total, centre, basis @ turn, variances[::-1][:k], float(np.trace(seen)))
    if found.live.any():
        live = found.scaled[:, found.live]
        covariance = _gram(rows, vector_col, size, lambda x: (x - centre) @ live, live.shape[1]) / n
        found.identity_error = float(np.abs(covariance - np.eye(live.shape[1])).max())
    return found


def deviations(n: int, total: list[int], block: np.ndarray) -> list[int | None]:
    """For each row the exact sum of (n * x - S) ** 2; None where it is beyond a long."""
    rest = [t - n * SHIFT for t in total]
    bound = n * float(np.abs(block).max(initial=0.0)) + max(map(abs, rest), default=0)
    if bound * bound * max(len(total), 1) < 2.0**62:
        away = n * block.astype(np.int64) - np.array(rest, np.int64)
        return (away * away).sum(1).tolist()
    exact = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in block.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS
) -> DataFrame:
    """One row for each usable row and component up to ``k``: ``id_col``, ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    found = fit(vectors, vector_col, k)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows, size = usable(vectors, vector_col)
    scaled, centre, count = found.scaled, found.centre, len(found.variances)
    shares = np.maximum(found.variances, 0.0) / found.trace if found.trace > 0.0 else np.zeros(count)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch, vector_col, size):
                many = len(block)
                ids = part.column(id_col).take(pa.array(np.repeat(np.arange(many), count)))
                away = pa.array(deviations(found.n, found.total, block), pa.int64())
                error = pa.array([found.identity_error], pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), many)),
                        pa.array(np.full(many * count, found.n, np.int64)),
                        away.take(pa.array(np.repeat(np.arange(many), count))),
                        pa.array(((block - centre) @ scaled).ravel(), from_pandas=True),
                        pa.array(np.tile(shares, many)),
                        error.take(pa.array(np.zeros(many * count, np.int32))),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(id_col, vector_col).mapInArrow(work, schema)
