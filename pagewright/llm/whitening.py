"""Whitening of embeddings: projections on the leading components of their covariance, scaled to unit variance.

Method: each task runs through its distinct vectors once and updates count, mean and the matrix of centred products with
a rank-one step a vector (Welford); the states of tasks are merged pairwise by the parallel update formula, as a tree; the
covariance is then reduced to three diagonals by reflections and diagonalised by implicitly shifted QR steps.

Shape at scale: one shuffle, of distinct quantised vectors in as few bytes as they need, equal ones already merged before it;
states and components have the size of one covariance, whatever the number of rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.session import stored

#: Steps of a vector's entry.
STEPS = 256
#: States that one task merges.
FAN_IN = 8
#: The largest double below 2**63, and its negative: entries beyond are held there.
_MOST = 2.0**63 - 1024


class Moments:
    """Count, mean and centred products of vectors of one length, and exact sums if they are integers."""

    def __init__(self, d: int) -> None:
        self.n, self.mean, self.m2, self.sums = 0, np.zeros(d), np.zeros((d, d)), [0] * d

    def add(self, x: np.ndarray) -> None:
        """One rank-one update."""
        self.n += 1
        step = x - self.mean
        self.mean += step / self.n
        self.m2 += np.outer(step, x - self.mean)

    def merge(self, other: Moments) -> None:
        """The parallel update formula."""
        n = self.n + other.n
        step = other.mean - self.mean
        self.m2 += other.m2 + np.outer(step, step) * (self.n * other.n / n)
        self.mean += step * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums)]

    def covariance(self) -> np.ndarray:
        return self.m2 / self.n


def _reflect(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """diagonal, subdiagonal and q of a symmetric matrix q t q', by Householder reflections."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        norm = math.copysign(np.linalg.norm(v), v[0])
        v[0] += norm
        size = v @ v
        if size == 0:
            continue
        a[k + 1 :] -= np.outer(v, (2 / size) * (v @ a[k + 1 :]))
        a[:, k + 1 :] -= np.outer((2 / size) * (a[:, k + 1 :] @ v), v)
        q[:, k + 1 :] -= np.outer((2 / size) * (q[:, k + 1 :] @ v), v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    scale = float(np.abs(a).max()) if a.size else 0.0
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = _reflect((a + a.T) / (2 * scale))
    q = np.ascontiguousarray(q.T)  # rows are turned, which lie together in memory
    eps, high = np.finfo(float).eps, len(d) - 1
    while high > 0:
        small = np.abs(e[:high]) <= eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0
        if e[high - 1] == 0:
            high -= 1
            continue
        zeros = np.flatnonzero(e[:high] == 0)
        low = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (d[high - 1] - d[high]) / 2  # Wilkinson's shift
        off = e[high - 1]
        shift = d[high] - off * off / (half + math.copysign(math.hypot(half, off), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):  # chase the bulge
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, m, t = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * t + s * s * m, s * s * p - 2 * c * s * t + c * c * m
            e[k] = c * s * (m - p) + (c * c - s * s) * t
            if k + 1 < high:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order] * scale, q[order].T


def _quantised(vectors: pa.Array) -> list[np.ndarray | None]:
    """floor(STEPS * entry) of each vector as long; None for a null vector and one that holds null or no finite number."""
    flat = vectors.values
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    good = np.isfinite(values)
    steps = np.clip(np.floor(np.where(good, values, 0) * STEPS), -_MOST, _MOST).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~good)])
    at, there = vectors.offsets.to_numpy(), vectors.is_valid().to_numpy(zero_copy_only=False)
    return [steps[a:b] if ok and bad[a] == bad[b] else None for ok, a, b in zip(there, at[:-1], at[1:])]


def _packed(x: np.ndarray) -> bytes:
    """The vector in the narrowest integers that hold it; equal vectors give equal bytes."""
    low, high = int(x.min()), int(x.max())
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind[-1].encode() + x.astype(kind).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<i{packed[:1].decode()}", offset=1).astype(np.int64)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_packed(x) for x in _quantised(batch.column(0)) if x is not None and len(x)], pa.binary())], names=["x"])


def _rows(states: dict[int, Moments]) -> Iterator[pa.RecordBatch]:
    for d, state in states.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["d", "state"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states: dict[int, Moments] = {}
    for batch in batches:
        for d, packed in zip(*(c.to_pylist() for c in batch.columns)):
            state = pickle.loads(packed)
            if d in states:
                states[d].merge(state)
            else:
                states[d] = state
    yield from _rows(states)


_STATE = "d long, state binary"


def _gather(fit: DataFrame, states: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> dict[int, Moments]:
    """The states of all tasks, merged as a tree into one for each length of vectors."""
    rows, tasks = fit.mapInArrow(states, _STATE), fit.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        rows = rows.repartition(tasks).mapInArrow(_merge, _STATE)
    return {r["d"]: pickle.loads(r["state"]) for r in rows.collect()}  # one row for each length


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Welford over a task's vectors; sums stay exact, as longs while a batch cannot overflow them."""
    states: dict[int, Moments] = {}
    for batch in batches:
        by: dict[int, list[np.ndarray]] = {}
        for packed in batch.column(0).to_pylist():
            x = _unpacked(packed)
            by.setdefault(len(x), []).append(x)
            states.setdefault(len(x), Moments(len(x))).add(x)
        for d, xs in by.items():
            block = np.stack(xs)
            safe = max(-int(block.min()), int(block.max())) * len(xs) < 2**63
            states[d].sums = [a + b for a, b in zip(states[d].sums, (block if safe else block.astype(object)).sum(axis=0).tolist())]
    yield from _rows(states)


@dataclass
class Whitening:
    """What is learned of vectors of one length. components: rows, with their eigenvalues; flat ones have no variance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of vectors (rows); not a number for flat components."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (x - self.mean) @ self.components.T / np.sqrt(self.values), np.nan)


def fit_whitening(fit: DataFrame, components: int) -> dict[int, Whitening]:
    """The components of distinct packed vectors, by length, and how far their whitened covariance is from the identity."""
    models = {}
    for d, state in _gather(fit, _sums).items():
        values, vectors = symmetric_qr(state.covariance())
        k = min(components, d)
        values = np.where(values[:k] > d * np.finfo(float).eps * max(values[0], 0), values[:k], 0.0)
        models[d] = Whitening(state.n, state.sums, np.array([s / state.n for s in state.sums]), vectors[:, :k].T.copy(), values, float(np.trace(state.covariance())))
    shared = fit.sparkSession.sparkContext.broadcast(models)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Moments] = {}
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                x = _unpacked(packed)
                m = shared.value[len(x)]
                live = m.values > 0
                if live.any():
                    states.setdefault(len(x), Moments(int(live.sum()))).add(m.project(x)[live])
        yield from _rows(states)

    for d, state in _gather(fit, whitened).items():
        models[d].error = float(np.abs(state.covariance() - np.eye(len(state.mean))).max())
    return models


_OUT = "component int, n long, deviation long, deviation_digits string, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and, for each of the first components, its number, n, deviation, whitened, explained and identity_error.

    Rows whose vector is null or holds null or non-finite entries are dropped. Entries become floor(256 * entry), held
    within long's range. The model is fitted on each distinct vector once; repeated rows, null ids and ties all get rows.
    Vectors of different lengths are different spaces, each with a model of its own; an empty vector has no component and no
    row. A component without variance (all, if one vector is alone) has whitened null, and explained is null if
    nothing varies; identity_error is over the others, null if there is none. deviation is null where it exceeds a long;
    deviation_digits has it at any size. An empty table gives none. Other columns are not read.
    """
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    fit = stored(given.select("embedding").mapInArrow(_distinct, "x binary").distinct())
    models = fit_whitening(fit, components)
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    kind = given.schema["vec_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[int]] = {}
            all_x = _quantised(batch.column(1))
            for i, x in enumerate(all_x):
                if x is not None and len(x):
                    by.setdefault(len(x), []).append(i)
            for d, at in by.items():
                m, block = shared.value[d], np.stack([all_x[i] for i in at])
                k = len(m.values)
                most = max(map(abs, m.sums)) + m.n * max(-int(block.min()), int(block.max()))
                safe = most * most * d < 2**63
                exact = block if safe else block.astype(object)
                gap = ((exact * m.n - np.array(m.sums, None if safe else object)) ** 2).sum(axis=1).tolist()
                white = m.project(block).ravel()
                columns = [
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array([m.n] * (k * len(at)), pa.int64()),
                    pa.array([g if g < 2**63 else None for g in gap for _ in range(k)], pa.int64()), pa.array([str(g) for g in gap for _ in range(k)]),
                    pa.array(white, pa.float64(), from_pandas=True), pa.array([float(v) / m.trace if m.trace > 0 else None for v in m.values] * len(at), pa.float64()),
                    pa.array([m.error] * (k * len(at)), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", *[c.split()[0] for c in _OUT.split(", ")]])

    return given.mapInArrow(rows, T.StructType([kind, *T.StructType.fromDDL(_OUT)]))
