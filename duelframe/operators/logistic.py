"""Ridge logistic regressions on all folds at once, for dense features of bounded width.

Every pass over the rows takes one Newton step of every fit that still moves: tasks add up
losses, gradients and curvatures of their rows, Spark sums them, and the driver solves one
small system per fit. A step that makes the loss larger is halved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

#: Features up to which curvatures are added up; their number grows with the square of the width.
DENSE_WIDTH = 64
#: Rows are collapsed where on average at least as many are equal.
EQUAL_ROWS = 8

_CHUNK = 512  # rows whose products are held at a time; they stay in the cache of a core
_BLOCK = 4_096  # rows that are stored as one
_ROUNDING = 1e-12  # a loss that is larger by this share is the same loss

Fit = tuple[float, int]


def narrow(features: DataFrame) -> int | None:
    """Width of the feature vectors, if it is at most ``DENSE_WIDTH``."""
    first = features.select(F.size(vector_to_array("features")).alias("width")).first()
    return first["width"] if first and first["width"] <= DENSE_WIDTH else None


def collapsed(table: DataFrame, by: Sequence[str], rows: int, distinct: int) -> DataFrame:
    """``by, n``: equal rows once with their number, if there are few different ones; otherwise every row with 1."""
    if distinct * EQUAL_ROWS <= rows:
        return table.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return table.select(*by, F.lit(1.0).alias("n"))


def packed(table: DataFrame) -> DataFrame:
    """``fold, y, n, x``: the rows of ``fold, target, x, n``, up to ``_BLOCK`` of a fold in one, each column as the bytes of its doubles.

    Every pass reads the rows as they are here, without making each of them again.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            fold, y, n = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("fold", "target", "n"))
            for f in np.unique(fold):
                at = np.flatnonzero(fold == f)
                for rows in (at[i : i + _BLOCK] for i in range(0, len(at), _BLOCK)):
                    doubles = [np.ascontiguousarray(v, dtype=np.float64).tobytes() for v in (y[rows], n[rows], x[rows].T)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(f)], pa.int32()), *[pa.array([v], pa.binary()) for v in doubles]], names=["fold", "y", "n", "x"])

    return table.mapInArrow(pack, "fold int, y binary, n binary, x binary")


def _blocks(width: int) -> Callable:
    """Reader of the blocks of ``packed``: fold, labels, weights and features, a feature in each line. Tasks get it by value."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for row in batch.to_pylist():
                y, n, x = (np.frombuffer(row[c]) for c in ("y", "n", "x"))
                yield row["fold"], y, n, x.reshape(width, len(y))

    return read


def _summing(fits: Sequence[Fit], beta: np.ndarray, weights: np.ndarray) -> Callable:
    """Task of one pass over ``packed`` rows: by fit the loss, the gradient and the upper triangle of the curvature."""
    read = _blocks(beta.shape[0] - 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = beta.shape[0]
        held = np.array([f for _, f in fits])
        left, right = np.triu_indices(k)
        values = np.zeros((1 + k + len(left), len(fits)))
        for f, y, n, x in read(batches):
            of = np.flatnonzero(held != f)
            total = np.zeros((len(values), len(of)))
            for i in range(0, len(y), _CHUNK):
                label, part = y[i : i + _CHUNK, None], slice(i, i + _CHUNK)
                one = np.vstack([x[:, part], np.ones(len(label))])
                share = weights[of][:, y[part].astype(np.int64)].T * n[part, None]
                z = one.T @ beta[:, of]
                small = np.exp(-np.abs(z))
                p = np.where(z < 0, small, 1.0) / (1 + small)
                total[0] += (share * (np.maximum(z, 0.0) + np.log1p(small) - label * z)).sum(axis=0)
                total[1 : 1 + k] += one @ (share * (p - label))
                total[1 + k :] += (one[left] * one[right]) @ (share * (p * (1 - p)))
            values[:, of] += total
        m, slot = np.meshgrid(np.arange(len(fits), dtype=np.int32), np.arange(len(values), dtype=np.int32), indexing="ij")
        yield pa.RecordBatch.from_arrays([pa.array(m.ravel()), pa.array(slot.ravel()), pa.array(values.T.ravel())], names=["m", "slot", "v"])

    return sums


def scored_by_fits(blocks: DataFrame, width: int, fits: Mapping[Fit, Sequence[float]]) -> DataFrame:
    """``fold, target, n, penalty, prob_red_win``: every ``packed`` row scored by the fits that did not see its fold, a row for each."""
    held, read = {f: sorted(p for p, g in fits if g == f) for _, f in fits}, _blocks(width)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, y, n, x in read(batches):
            beta = np.array([fits[p, f] for p in held[f]]).T
            with np.errstate(over="ignore"):
                score = 1 / (1 + np.exp(-(x.T @ beta[:width] + beta[width])))
            each = len(held[f])
            columns = [np.full(score.size, f, np.int32), np.repeat(y.astype(np.int32), each), np.repeat(n, each), np.tile(held[f], len(y)), score.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["fold", "target", "n", "penalty", "prob_red_win"])

    return blocks.mapInArrow(scores, "fold int, target int, n double, penalty double, prob_red_win double")


def fold_fits(
    table: DataFrame, width: int, penalties: Sequence[float], weights: Mapping[int, Mapping[int, float]], tol: float, max_iter: int
) -> dict[Fit, list[float]]:
    """Coefficients and intercept by ``(C, fold)``, of the rows outside the fold.

    ``table`` has ``fold, target, x, n`` with labels 0 and 1, or is its stored ``packed`` form; ``weights`` gives the weight of each class outside
    a fold. A fit minimises ``|w|^2 / 2 + C * sum of weighted losses`` and stops where a further step would
    lower that by less than ``tol`` squared of it. Where only one class is left the intercept is infinite, as in Spark ML.
    """
    table = packed(table) if "target" in table.columns else table
    k = width + 1
    ridge = np.diag([1.0] * width + [0.0])
    upper = np.triu_indices(k)
    found: dict[Fit, list[float]] = {}
    moving: dict[Fit, np.ndarray] = {}
    for p in penalties:
        for f, of in weights.items():
            if len(of) == 1:
                found[p, f] = [0.0] * width + [math.inf if 1 in of else -math.inf]
            else:
                moving[p, f] = np.zeros(k)
    best: dict[Fit, tuple[float, np.ndarray]] = {}  # least loss so far and where it is
    for _ in range(max_iter):
        if not moving:
            break
        fits = sorted(moving)
        beta = np.array([moving[m] for m in fits]).T
        of_class = np.array([[weights[f].get(y, 0.0) for y in (0, 1)] for _, f in fits])
        parts = table.mapInArrow(_summing(fits, beta, of_class), "m int, slot int, v double")
        values = np.zeros((len(fits), 1 + k + len(upper[0])))
        for r in parts.groupBy("m", "slot").agg(F.sum("v").alias("v")).collect():  # bounded by fits and width
            values[r["m"], r["slot"]] = r["v"]
        for m, own in zip(fits, values):
            at = moving[m]
            loss = m[0] * own[0] + 0.5 * float(at[:width] @ at[:width])
            if m in best and loss > best[m][0] + _ROUNDING * abs(best[m][0]):
                moving[m] = (at + best[m][1]) / 2
                if np.abs(moving[m] - best[m][1]).max() <= _ROUNDING * (1 + np.abs(at).max()):
                    found[m] = best[m][1].tolist()
                    del moving[m]
                continue
            best[m] = loss, at
            slope = m[0] * own[1 : 1 + k] + ridge @ at
            curvature = np.zeros((k, k))
            curvature[upper] = own[1 + k :]
            curvature = m[0] * (np.triu(curvature) + np.triu(curvature, 1).T) + ridge
            step = np.linalg.lstsq(curvature, slope, rcond=None)[0]
            moving[m] = at - step
            if 0.5 * abs(float(slope @ step)) <= max(tol * tol, _ROUNDING) * max(abs(loss), 1e-300):
                found[m] = moving.pop(m).tolist()
    return found | {m: best[m][1].tolist() for m in moving}
