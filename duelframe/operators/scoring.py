"""From probabilities to ranked predictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from duelframe.functions import confidence, predicted_winner
from duelframe.layout import DEFAULT, Layout, c

# How near one half counts as undecided, and how many rows a short list shows.
UNDECIDED_MARGIN = 0.1
TOP = 5


def positive_probability(df: DataFrame, probability: str = "probability", out: str = "prob_red_win") -> DataFrame:
    """Probability of a red win from a fitted classifier's probability vector."""
    return df.withColumn(out, vector_to_array(c(probability))[1])


def score_by_nodes(df: DataFrame, nodes: DataFrame, trees: int, depth: int, key: str = DEFAULT.key, out: str = "prob_red_win") -> DataFrame:
    """``key, out``: probability of a red win by walking ``nodes`` (see ``tree_nodes``), ``depth`` steps from the roots to the leaves.

    The table of nodes is bounded by the number and depth of the trees and goes to every task, which takes a batch of
    rows through one tree after the other: no row is copied for each tree.
    """
    walks: dict[int, dict] = {}
    for r in nodes.filter(F.col("tree") < trees).collect():
        walks.setdefault(r["tree"], {})[r["node"]] = r
    ensemble = []
    for _, own in sorted(walks.items()):
        size = max(own) + 1
        feature, left, right = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        threshold, value, sets = np.full(size, np.nan), np.zeros(size), {}
        for i, r in own.items():
            feature[i], left[i], right[i], value[i] = max(r["feature"], 0), r["left"], r["right"], r["weight"] * r["prediction"]
            if r["threshold"] is not None:
                threshold[i] = r["threshold"]
            elif r["left"] >= 0:
                sets[i] = np.array(r["categories"] or [])
        ensemble.append((feature, threshold, sets, left, right, value))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            rows, margin = np.arange(len(x)), np.zeros(len(x))
            for feature, threshold, sets, left, right, value in ensemble:
                at = np.zeros(len(x), np.int64)
                for _ in range(depth):
                    v = x[rows, feature[at]]
                    goes_left = v <= threshold[at]
                    for node, categories in sets.items():
                        goes_left |= (at == node) & np.isin(v, categories)
                    following = np.where(goes_left, left[at], right[at])
                    at = np.where(following < 0, at, following)
                margin += value[at]
            # Boosting sums margins, of which the logistic function of the double is the probability.
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-2 * margin)))], names=["_k", "_p"])

    at = df.select(c(key).alias("_k"), vector_to_array("features").alias("_x"))
    scored = at.mapInArrow(walk, f"_k {df.schema[key].dataType.simpleString()}, _p double")
    return scored.select(F.col("_k").alias(key), F.col("_p").alias(out))


def predictions(df: DataFrame, layout: Layout = DEFAULT, prob: str = "prob_red_win", extra=()) -> DataFrame:
    """``red entity, blue entity, prob_red_win, predicted_winner, confidence``, after any ``extra`` columns."""
    p = c(prob)
    return df.select(
        *[c(n) for n in extra],
        c(layout.red_entity),
        c(layout.blue_entity),
        p.alias("prob_red_win"),
        predicted_winner(p, layout.red_label, layout.blue_label).alias("predicted_winner"),
        confidence(p).alias("confidence"),
    )


def by_confidence(df: DataFrame, key: str | None = None, top: int | None = None) -> DataFrame:
    """Most confident first; ``top`` keeps a short list."""
    order = [F.desc("confidence")] + ([c(key)] if key else [])
    ranked = df.orderBy(*order)
    return ranked if top is None else ranked.limit(top)


def score_summary(df: DataFrame, prob: str = "prob_red_win") -> DataFrame:
    p = c(prob)
    return df.agg(
        F.count(p).alias("n"),
        F.min(p).alias("min_prob"),
        F.max(p).alias("max_prob"),
        F.avg(p).alias("mean_prob"),
        F.stddev_pop(p).alias("std_prob"),
        F.count_if(F.abs(p - 0.5) < UNDECIDED_MARGIN).alias("near_half"),
    )


def score_wide(df: DataFrame, prob: str = "prob_red_win") -> DataFrame:
    """All columns plus ``prob_f1_win`` and the hard label ``pred_f1_win``."""
    return df.withColumns({"prob_f1_win": c(prob), "pred_f1_win": (c(prob) >= 0.5).cast("int")})
