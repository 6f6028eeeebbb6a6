"""Profiles of training against upcoming data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from duelframe.layout import c, literal_rows, string_columns


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, value, n`` of every non-null value, counted map side first."""
    pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), c(n).alias("value")) for n in columns]))
    tall = df.select(pairs).filter(F.col("value").isNotNull())
    return tall.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_profile(frames: Mapping[str, DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """``dataset, column_name, n_distinct`` per text column of each dataset."""
    parts = []
    for name, df in frames.items():
        names = [n for n in string_columns(df) if columns is None or n in columns]
        seen = category_counts(df, names).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
        every = literal_rows(df.sparkSession, ["column_name"], [(n,) for n in names])
        parts.append(
            every.join(seen, "column_name", "left").select(
                F.lit(name).alias("dataset"), "column_name", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def category_drift(train: DataFrame, upcoming: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each (column, value) with where it occurs: ``both``, ``only_train`` or ``only_upcoming``."""
    a = category_counts(train, columns).withColumnRenamed("n", "n_train")
    b = category_counts(upcoming, columns).withColumnRenamed("n", "n_upcoming")
    where = (
        F.when(F.col("n_upcoming").isNull(), "only_train")
        .when(F.col("n_train").isNull(), "only_upcoming")
        .otherwise("both")
    )
    return a.join(b, ["column_name", "value"], "full").select(
        "column_name",
        "value",
        F.coalesce("n_train", F.lit(0)).alias("n_train"),
        F.coalesce("n_upcoming", F.lit(0)).alias("n_upcoming"),
        where.alias("found"),
    )


def stage_shapes(stages: Mapping[str, DataFrame]) -> DataFrame:
    """``stage, n_rows, n_columns`` of each DataFrame; columns come from the schema."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("stage"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns")
        )
        for name, df in stages.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_gap(train_columns: Sequence[str], upcoming_columns: Sequence[str]) -> dict[str, float]:
    """Feature counts of both sides and the share of training features upcoming data lacks."""
    missing = set(train_columns) - set(upcoming_columns)
    return {
        "n_train": len(train_columns),
        "n_upcoming": len(upcoming_columns),
        "n_missing": len(missing),
        "share_missing": len(missing) / len(train_columns) if train_columns else 0.0,
    }
