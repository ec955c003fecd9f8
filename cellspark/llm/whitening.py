"""Whitening of embedding vectors: Welford moments of partitions, merged as a tree, and a symmetric QR eigen-solve."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, stash

#: Entries become whole numbers: this many steps a unit, and this much added.
STEPS, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Moments merged by one task in one round of the tree.
FAN = 32
#: Entries beyond have no whole number of 64 bits.
_FAR = float(1 << 62)


class Moments:
    """Count, exact sums, mean and scatter (sums of centred products) of rows seen so far."""

    def __init__(self, n: int, sums: list[int], mean: np.ndarray, scatter: np.ndarray):
        self.n, self.sums, self.mean, self.scatter = n, sums, mean, scatter

    @classmethod
    def none(cls, dim: int) -> Moments:
        return cls(0, [0] * dim, np.zeros(dim), np.zeros((dim, dim)))

    def add(self, rows: np.ndarray) -> None:
        """Welford's rank-one update by each row."""
        mean, scatter = self.mean, self.scatter
        for row in rows:
            self.n += 1
            before = row - mean
            mean += before / self.n
            scatter += np.multiply.outer(before, row - mean)

    def merge(self, other: Moments) -> None:
        """The parallel form: the scatter between both means joins the scatters within."""
        n = self.n + other.n
        if n:
            apart = other.mean - self.mean
            self.scatter = self.scatter + other.scatter + np.multiply.outer(apart, apart) * (self.n * other.n / n)
            self.mean = self.mean + apart * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]


_STATE = "dim int, part int, n long, sums array<decimal(38,0)>, mean binary, scatter binary"
_KINDS = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.binary()), ("scatter", pa.binary())])


def _packed(found: dict[int, Moments], part: int) -> pa.RecordBatch:
    rows = [{"dim": d, "part": part, "n": m.n, "sums": [Decimal(s) for s in m.sums], "mean": m.mean.tobytes(), "scatter": m.scatter.tobytes()} for d, m in sorted(found.items())]
    return pa.RecordBatch.from_pylist(rows, _KINDS)


def _unpacked(row) -> Moments:
    mean = np.frombuffer(row["mean"])
    return Moments(row["n"], [int(s) for s in row["sums"]], mean.copy(), np.frombuffer(row["scatter"]).reshape(len(mean), len(mean)).copy())


def _matrices(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, floor of ``STEPS`` times their entries), for each length of vectors in the batch."""
    off = vectors.offsets.to_numpy()
    flat = np.floor(STEPS * np.asarray(vectors.values.to_numpy(zero_copy_only=False), float))
    size = np.diff(off)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield int(dim), rows, flat[off[rows][:, None] + np.arange(dim)]


def _whole(flat: np.ndarray) -> np.ndarray:
    return flat.astype(np.int64) + SHIFT


def _column_sums(x: np.ndarray) -> list[int]:
    fits = np.abs(x).max(initial=0) < (1 << 62) // max(1, len(x))
    return [int(s) for s in (x if fits else x.astype(object)).sum(axis=0)]


def moments(rows: DataFrame, of: Callable[[int, np.ndarray], np.ndarray] | None = None) -> dict[int, Moments]:
    """Moments by length of ``rows`` (one column of arrays of doubles), or of what ``of`` makes of the rows of a length.

    Each partition gives one state a length; states are merged ``FAN`` at a time, in their order, by
    tasks, and one state a length comes to the driver.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for batch in batches:
            for dim, _, flat in _matrices(batch.column(0)):
                values = of(dim, flat) if of else flat
                into = found.setdefault(dim, Moments.none(values.shape[1]))
                into.add(values)
                if not of:
                    into.sums = [a + b for a, b in zip(into.sums, _column_sums(_whole(flat)), strict=True)]
        yield _packed(found, TaskContext.get().partitionId())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], Moments] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key, state = (row["part"], row["dim"]), _unpacked(row)
                found[key].merge(state) if key in found else found.update({key: state})
        for part in sorted({p for p, _ in found}):
            yield _packed({d: m for (p, d), m in found.items() if p == part}, part)

    states = stash(rows.mapInArrow(task, _STATE))
    parts = (states.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // FAN)
        into = states.withColumn("__at", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        ordered = into.repartition(parts, "part").sortWithinPartitions("part", "dim", "__at").drop("__at")
        after = stash(ordered.mapInArrow(merge, _STATE))
        discard(states)
        states = after
    out = {r["dim"]: _unpacked(r) for r in states.collect()}
    discard(states)
    return out


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in rows, by Householder tridiagonal form and implicit QR steps with Wilkinson's shift.

    The largest entry of each vector is positive.
    """
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += math.copysign(float(np.linalg.norm(v)), v[0])
        size = float(np.linalg.norm(v))
        if size == 0:
            continue
        v /= size
        a[k + 1 :, k:] -= 2 * np.multiply.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.multiply.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.multiply.outer(q[:, k + 1 :] @ v, v)
    d, e = [float(x) for x in np.diag(a)], [float(x) for x in np.diag(a, 1)]
    q = np.ascontiguousarray(q.T)  # eigenvectors as rows
    high, eps = n - 1, np.finfo(float).eps
    while high > 0:
        if abs(e[high - 1]) <= eps * (abs(d[high - 1]) + abs(d[high])):
            e[high - 1] = 0.0
            high -= 1
            continue
        low = high - 1
        while low > 0 and abs(e[low - 1]) > eps * (abs(d[low - 1]) + abs(d[low])):
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        x, z = d[low] - (d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half))), e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            first, second, off = d[k], d[k + 1], e[k]
            d[k] = c * c * first + 2 * c * s * off + s * s * second
            d[k + 1] = s * s * first - 2 * c * s * off + c * c * second
            e[k] = c * s * (second - first) + (c * c - s * s) * off
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[[k, k + 1]] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-np.array(d), kind="stable")
    vectors = q[order]
    sign = np.sign(vectors[np.arange(n), np.abs(vectors).argmax(axis=1)]) if n else np.ones(0)
    return np.array(d)[order], vectors * sign[:, None]


@dataclass
class Whitening:
    """What whitens vectors of one length: ``weights`` has a row a component, NaN where there is no variance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    weights: np.ndarray
    explained: np.ndarray

    def project(self, flat: np.ndarray) -> np.ndarray:
        return (flat - self.mean) @ self.weights.T


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each length of ``rows`` (one column of arrays of finite doubles)."""
    out = {}
    for dim, m in moments(rows).items():
        values, vectors = symmetric_qr(m.scatter / m.n)
        k, trace = min(components, dim), float(np.trace(m.scatter)) / m.n
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(values[:k] > 1e-12 * trace, 1 / np.sqrt(np.maximum(values[:k], 0)), np.nan)
        mean = np.array([float((s - SHIFT * m.n) // m.n) + (s - SHIFT * m.n) % m.n / m.n for s in m.sums])
        out[dim] = Whitening(m.n, m.sums, mean, vectors[:k] * scale[:, None], np.maximum(values[:k], 0) / trace if trace > 0 else np.zeros(k))
    return out


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector (now an array of doubles) is not null or empty and holds neither nulls nor anything that isn't finite."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _FAR / STEPS))
    return df.withColumn(vector, v).where(F.coalesce(fine & (F.size(v) > 0), F.lit(False)))


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector of ``df`` and component.

    Columns: key, component (from 1 by falling variance), n, deviation, whitened, explained, identity_error, deviation_exact.
    Vectors that are null or empty, or hold a null, a number that isn't finite or one of 2**52 or more, give no rows.  Vectors of
    different lengths are spaces of their own, each with its n and components (fewer than asked for where it is
    shorter); a component without variance has a null ``whitened``.  Keys may be null or repeat; rows that
    repeat count and come back as often as they are there.  ``deviation`` is the exact sum of (n*x - S)**2,
    null where it needs more than 64 bits (from about three million unit vectors on), ``deviation_exact`` the same in 38 digits.
    Further columns are ignored, an empty table gives an empty one.  The table is read three times: moments,
    moments of the result, result.
    """
    rows = usable(df.select(F.col(key), F.col(vector).alias("__vector")), "__vector")
    vectors = rows.select("__vector")
    models = fit(vectors, components)

    def projected(dim: int, flat: np.ndarray) -> np.ndarray:
        return np.nan_to_num(models[dim].project(flat))

    errors = {}
    for dim, m in moments(vectors, projected).items():
        real = ~np.isnan(models[dim].weights).any(axis=1)
        apart = np.abs(m.scatter / m.n - np.eye(len(real)))[np.ix_(real, real)]
        errors[dim] = float(apart.max(initial=0.0))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, flat in _matrices(batch.column(1)):
                model, k = models[dim], len(models[dim].weights)
                white = model.project(flat).ravel()
                sums = deviations(_whole(flat), model.n, model.sums)
                each = np.repeat(np.arange(len(at)), k)
                exact = pa.array([Decimal(s) if abs(s) < 10**38 else None for s in sums], pa.decimal128(38, 0))
                small = pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(white), model.n)), small.take(pa.array(each)),
                        pa.array(white, mask=np.isnan(white)), pa.array(np.tile(model.explained, len(at))), pa.array(np.full(len(white), errors[dim])), exact.take(pa.array(each)),
                    ],
                    names,
                )

    names = [key, *(c.split()[0] for c in _OUT.split(", "))]
    return rows.mapInArrow(task, f"`{key}` {df.schema[key].dataType.simpleString()}, {_OUT}")


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum of (n*x - S)**2 of each row, exact: in 64 bits where that holds it."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if most < 1 << 62:
        apart = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(apart).max(initial=0)) ** 2 < 1 << 63:
            return (apart * apart).sum(axis=1).tolist()
    wide = n * x.astype(object) - np.array(sums, object)
    return (wide * wide).sum(axis=1).tolist()
