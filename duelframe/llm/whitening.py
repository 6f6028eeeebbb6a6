"""Whitening of embeddings through a covariance found by polarisation.

Entries become integers, so everything that is summed is exact. Tasks add up the
squares of every centred dimension and of the sum of every pair of dimensions;
differences of these variances are the covariances, as
2 cov(a, b) = var(a + b) - var(a) - var(b). What reaches the driver is one number
for each pair of dimensions, whatever the number of vectors. Eigenvectors of that
matrix, divided by the root of their eigenvalue, whiten the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from duelframe.layout import c

#: The integer of an entry ``c`` is floor(64 * c) + 1000000.
SCALE = 64
OFFSET = 1_000_000

COMPONENTS = 32
#: Eigenvalues below this share of the largest, for each dimension, are zero in double precision.
ZERO = 1e-14

_EXACT = 1 << 62  # sums of machine integers stay below this, others are taken with Python's integers
_ROWS = 4_096
_DECIMAL = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """Count, exact sums by dimension, and the kept components of the rows it was fitted on."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray  # falling
    vectors: np.ndarray  # one column for each eigenvalue
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def _integers(entry: Column) -> Column:
    scaled = entry.cast("double") * SCALE
    outside = F.raise_error(F.concat(F.lit("embedding entry out of range: "), entry.cast("string"))).cast("long")
    return F.when(F.abs(scaled) < float(1 << 62), F.floor(scaled).cast("long") + F.lit(OFFSET).cast("long")).otherwise(outside)


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``_k``, ``_x``: keys and integer vectors of the rows whose vector is there and has only finite entries."""
    rows = df.select(c(key).alias("_k"), c(vector).alias("_v"))
    broken = F.exists("_v", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return rows.where(F.col("_v").isNotNull() & ~broken).select("_k", F.transform("_v", _integers).alias("_x"))


# --------------------------------------------------------------------------- exact sums inside tasks


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in slices of bounded size, each with its vectors as a matrix."""
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            x = batch.column("_x")
            lengths = pc.unique(pc.list_value_length(x)).to_pylist()
            if len(lengths) != 1:
                raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
            yield batch, x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, lengths[0])


def _largest(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if values.size else 0


def _shifted(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """Vectors minus whole numbers, as machine integers where those hold the result."""
    if _largest(x) + max((abs(s) for s in shift), default=0) < _EXACT:
        return x - np.array(shift, np.int64)
    return x.astype(object) - np.array(shift, object)


def _safe(values: np.ndarray, terms: int, factor: int = 1) -> np.ndarray:
    """The values as Python integers if ``terms`` squares of ``factor`` times them could leave the machine's."""
    small = values.dtype != object and (factor * _largest(values)) ** 2 * max(terms, 1) < _EXACT
    return values if small else values.astype(object)


def _squares(rows: np.ndarray) -> np.ndarray:
    """Sum of squares of every row."""
    return (rows * rows).sum(axis=1) if rows.dtype == object else np.einsum("ij,ij->i", rows, rows)


def _sent(d: int, i: int, js: range, values: list) -> pa.RecordBatch:
    columns = [pa.array([d] * len(values), pa.int32()), pa.array([i] * len(values), pa.int32()), pa.array(js, pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([Decimal(int(v)) for v in values], _DECIMAL)], ["d", "i", "j", "v"])


_SENT = "d int, i int, j int, v decimal(38,0)"


def _summed(sent: DataFrame) -> tuple[int, dict[tuple[int, int], int]]:
    """Dimension and totals by pair; one row for each pair of dimensions reaches the driver."""
    rows = sent.groupBy("d", "i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()
    found = {r["d"] for r in rows}
    if len(found) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(found)}")
    return (found.pop() if found else 0), {(r["i"], r["j"]): int(r["v"]) for r in rows}


def _totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in _blocks(batches):
            if total is not None and len(total) != x.shape[1]:
                raise ValueError(f"vectors of different lengths: {sorted((len(total), x.shape[1]))}")
            exact = x if _largest(x) * len(x) < _EXACT else x.astype(object)
            part = exact.sum(axis=0).astype(object)
            n, total = n + len(x), part if total is None else total + part
        if total is not None:
            yield _sent(len(total), -1, range(1), [n])
            yield _sent(len(total), 0, range(len(total)), list(total))

    d, found = _summed(rows.select("_x").mapInArrow(run, _SENT))
    return found.get((-1, 0), 0), [found[0, j] for j in range(d)]


def _squared(rows: DataFrame, shift: list[int]) -> dict[tuple[int, int], int]:
    """Sums of squares of every shifted dimension (i, i) and of the sum of every pair (i, j), i < j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(shift)
        total = [np.zeros(d - i, object) for i in range(d)]
        for _, x in _blocks(batches):
            y = np.ascontiguousarray(_safe(_shifted(x, shift), len(x), 2).T)
            own = _squares(y)
            for i in range(d):
                total[i][0] += int(own[i])
                total[i][1:] += _squares(y[i + 1 :] + y[i]).astype(object)
        for i in range(d):
            yield _sent(d, i, range(i, d), list(total[i]))

    return _summed(rows.select("_x").mapInArrow(run, _SENT))[1]


# --------------------------------------------------------------------------- fit


def covariance(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, exact sums by dimension, and the covariance with divisor n.

    Vectors are centred on the whole number next to the mean; what is left of the mean is
    taken off the exact sums, so every entry is a ratio of integers, rounded once.
    """
    n, sums = _totals(rows)
    d = len(sums)
    if not n or not d:
        return n, sums, np.zeros((d, d))
    shift = [round(s / n) if abs(s) < 1 << 52 else s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, shift)]
    squares = _squared(rows, shift)
    # Sums of (n * x - S) squared, by dimension and by sum of two dimensions.
    own = [n * n * squares[i, i] - n * rest[i] ** 2 for i in range(d)]
    v = np.zeros((d, d))
    for i in range(d):
        v[i, i] = own[i] / n**3
        for j in range(i + 1, d):
            both = n * n * squares[i, j] - n * (rest[i] + rest[j]) ** 2
            v[i, j] = v[j, i] = (both - own[i] - own[j]) / (2 * n**3)
    return n, sums, v


def fit_whitening(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Fitted on all usable rows; keeps at most ``components`` components, those with a variance above zero in double precision."""
    n, sums, v = covariance(usable(df, key, vector))
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > ZERO * len(sums) * values.max(initial=0.0)]
    return Whitening(n, tuple(sums), values[order], vectors[:, order], float(np.trace(v)))


# --------------------------------------------------------------------------- apply


def _projector(model: Whitening):
    """Function from integer vectors to (whitened, n * x - S)."""
    shift = [round(s / model.n) if abs(s) < 1 << 52 else s // model.n for s in model.sums]
    rest = [s - model.n * m for s, m in zip(model.sums, shift)]
    weights = model.vectors / np.sqrt(model.eigenvalues)
    fraction = np.array([r / model.n for r in rest])

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if x.shape[1] != len(shift):
            raise ValueError(f"vectors of length {x.shape[1]}, fitted on {len(shift)}")
        y = _shifted(x, shift)
        fits = model.n * _largest(y) + max(map(abs, rest)) < _EXACT
        z = (y if fits else y.astype(object)) * model.n - np.array(rest, np.int64 if fits else object)
        return (y.astype(float) - fraction) @ weights, z

    return project


def whiten(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, ``whitened`` (a double for each component), ``deviation`` (sum of squares of n * x - S, exact decimal).

    Rows whose vector is null or holds null or non-finite entries are left out; a null key
    stays and repeated rows repeat. Vectors of different lengths and entries beyond 2^56 are
    errors. Other columns are not looked at. Without rows, or without any variance, the
    model has no component: ``whitened`` is empty.
    """
    rows = usable(df, key, vector)
    kind = rows.schema["_k"].dataType.simpleString()
    schema = f"_k {kind}, whitened array<double>, deviation decimal(38,0)"
    if not model.n:
        return rows.where(F.lit(False)).select(F.col("_k").alias(key), F.array().cast("array<double>").alias("whitened"), F.lit(0).cast("decimal(38,0)").alias("deviation"))
    project = _projector(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches):
            w, z = project(x)
            sums = _squares(_safe(z, z.shape[1]))
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            whitened = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(w).ravel()))
            deviation = pa.array([Decimal(int(s)) for s in sums], _DECIMAL)
            yield pa.RecordBatch.from_arrays([batch.column("_k"), whitened, deviation], ["_k", "whitened", "deviation"])

    return rows.mapInArrow(run, schema).withColumnRenamed("_k", key)


def identity_error(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows, measured over all of them, minus the identity."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    project = _projector(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, x in _blocks(batches):
            w, _ = project(x)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        columns = [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "v"])

    sent = usable(df, key, vector).select("_x").mapInArrow(run, "i int, j int, v double")
    total = np.zeros((k + 1, k))
    for r in sent.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # (k + 1) * k numbers
        total[r["i"], r["j"]] = r["v"] / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
