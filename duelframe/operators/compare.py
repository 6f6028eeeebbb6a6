"""Two models side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from duelframe.functions import bout_label, confidence_tier
from duelframe.layout import DEFAULT, Layout, c

# Histogram of confidence over [0.5, 1], and the lengths of the short lists.
HISTOGRAM_FROM = 0.5
HISTOGRAM_BINS = 20
HISTOGRAM_WIDTH = 0.025
TOP_DISAGREEMENTS = 3

VALUES = ("prob_red_win", "predicted_winner", "confidence")


def compare_join(
    a: DataFrame,
    b: DataFrame,
    on: Sequence[str],
    suffixes: tuple[str, str] = ("_logreg", "_gbdt"),
    values: Sequence[str] = VALUES,
) -> DataFrame:
    """Inner join of two prediction tables, each value column suffixed by its model.

    ``on`` must identify a prediction: name both competitors, and the bout key as
    well wherever a pairing can occur more than once.
    """
    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*[c(n) for n in on], *[c(v).alias(v + suffix) for v in values])

    return side(a, suffixes[0]).join(side(b, suffixes[1]), list(on), "inner")


def with_agreement(df: DataFrame, suffixes: tuple[str, str] = ("_logreg", "_gbdt")) -> DataFrame:
    a, b = suffixes
    return df.withColumns(
        {
            "agree": c("predicted_winner" + a) == c("predicted_winner" + b),
            "prob_diff": F.abs(c("prob_red_win" + a) - c("prob_red_win" + b)),
        }
    )


def agreement_rate(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("agree").alias("agreements"),
        F.count_if(~F.col("agree")).alias("disagreements"),
        F.avg(F.col("agree").cast("double")).alias("rate"),
    )


def top_disagreements(df: DataFrame, key: str, top: int = TOP_DISAGREEMENTS) -> DataFrame:
    return df.orderBy(F.desc("prob_diff"), c(key)).limit(top)


def model_kpis(df: DataFrame, suffixes: tuple[str, str] = ("_logreg", "_gbdt")) -> DataFrame:
    means = [F.avg(c("confidence" + s)).alias("mean_confidence" + s) for s in suffixes]
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if("agree").alias("agreements"), *means)


def _tall(df: DataFrame, suffixes: tuple[str, str], value: str) -> DataFrame:
    pairs = [F.struct(F.lit(s.lstrip("_")).alias("model"), c(value + s).alias(value)) for s in suffixes]
    return df.select(F.inline(F.array(*pairs)))


def confidence_histogram(df: DataFrame, suffixes: tuple[str, str] = ("_logreg", "_gbdt")) -> DataFrame:
    """``model, bin, n`` over twenty equal bins from one half to one."""
    raw = F.floor((F.col("confidence") - HISTOGRAM_FROM) / HISTOGRAM_WIDTH)
    bin_ = F.least(raw, F.lit(HISTOGRAM_BINS - 1)).cast("int").alias("bin")
    return _tall(df, suffixes, "confidence").groupBy("model", bin_).agg(F.count(F.lit(1)).alias("n"))


def tier_counts(df: DataFrame, suffixes: tuple[str, str] = ("_logreg", "_gbdt")) -> DataFrame:
    tier = confidence_tier(F.col("confidence")).alias("tier")
    return _tall(df, suffixes, "confidence").groupBy("model", tier).agg(F.count(F.lit(1)).alias("n"))


def enrich(df: DataFrame, details: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join of descriptive columns; unmatched predictions keep nulls."""
    return df.join(details.select(*[c(n) for n in [*on, *columns]]), list(on), "left")


def with_label(df: DataFrame, layout: Layout = DEFAULT, name: str = "bout") -> DataFrame:
    return df.withColumn(name, bout_label(c(layout.red_entity), c(layout.blue_entity)))


def sorted_by_confidence(
    df: DataFrame, model_suffix: str, key: str, descending: bool = True, agree: bool | None = None
) -> DataFrame:
    """Comparison rows ordered by one model's confidence, optionally only (dis)agreements."""
    rows = df if agree is None else df.filter(F.col("agree") == F.lit(agree))
    conf = c("confidence" + model_suffix)
    return rows.orderBy(conf.desc() if descending else conf.asc(), c(key))
