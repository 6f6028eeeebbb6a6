"""Data-quality rules. Each rule reports ``rule, checked, violations``.

Row rules are plain conditions and share one pass over the table; only the
duplicate rule needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from duelframe.layout import DEFAULT, Layout, c, literal_rows
from duelframe.operators.clean import MISSING_THRESHOLD, sparse_columns

# Plausible ranges of the physical stats, ends included.
PLAUSIBLE_RANGES: dict[str, tuple[float, float]] = {"Age": (18, 60), "Height": (150, 220), "Weight": (100, 350)}


@dataclass(frozen=True)
class RowRule:
    """Violated wherever ``bad`` holds; rows where ``applies`` is false are not checked."""

    name: str
    bad: Column
    applies: Column = field(default_factory=lambda: F.lit(True))


def domain(column: str, allowed: Sequence) -> RowRule:
    return RowRule(f"domain:{column}", F.coalesce(~c(column).isin(*allowed), F.lit(True)))


def non_blank(column: str) -> RowRule:
    return RowRule(f"non_blank:{column}", c(column).isNull() | (F.trim(c(column).cast("string")) == ""))


def sides_differ(layout: Layout = DEFAULT) -> RowRule:
    return RowRule("sides_differ", F.coalesce(c(layout.red_entity) == c(layout.blue_entity), F.lit(False)))


def in_range(column: str, low: float, high: float) -> RowRule:
    return RowRule(f"range:{column}", ~c(column).between(low, high), c(column).isNotNull())


def plausible_ranges(
    df: DataFrame, layout: Layout = DEFAULT, ranges: Mapping[str, tuple[float, float]] = PLAUSIBLE_RANGES
) -> list[RowRule]:
    present = set(df.columns)
    return [
        in_range(p + base, low, high)
        for base, (low, high) in ranges.items()
        for p in (layout.red, layout.blue)
        if p + base in present
    ]


def binary_target(column: str = "target") -> RowRule:
    return RowRule(f"binary:{column}", F.coalesce(~c(column).isin(0, 1), F.lit(True)))


def finite(df: DataFrame, columns: Sequence[str] | None = None) -> list[RowRule]:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return [
        RowRule(f"finite:{n}", F.abs(c(n)) == float("inf"), c(n).isNotNull())
        for n in (columns or floats)
    ]


def difference_holds(layout: Layout, base: str, tolerance: float = 1e-9) -> RowRule:
    red, blue, diff = c(layout.red + base), c(layout.blue + base), c(f"{base}_diff")
    return RowRule(f"difference:{base}", F.abs(red - blue - diff) > tolerance, (red - blue).isNotNull())


def at_least(column: str, low: float) -> RowRule:
    return RowRule(f"at_least:{column}", c(column) < low, c(column).isNotNull())


def probabilities(red: str, blue: str | None = None, tolerance: float = 1e-9) -> list[RowRule]:
    rules = [in_range(n, 0.0, 1.0) for n in (red, blue) if n]
    if blue:
        rules.append(RowRule("sums_to_one", F.abs(c(red) + c(blue) - 1) > tolerance))
    return rules


def check_rows(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """All row rules in one aggregation."""
    counted = df.agg(
        *[F.count_if(r.applies).alias(f"checked{i}") for i, r in enumerate(rules)],
        *[F.count_if(r.applies & r.bad).alias(f"violations{i}") for i, r in enumerate(rules)],
    )
    report = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.col(f"checked{i}").alias("checked"),
            F.col(f"violations{i}").alias("violations"),
        )
        for i, r in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*report)))


def duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one; the counts are combined map side."""
    names = list(columns or df.columns)
    counts = df.groupBy(*[c(n) for n in names]).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.lit("duplicates").alias("rule"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations"),
    )


def _static(df: DataFrame, rows: Sequence[tuple[str, int, int]]) -> DataFrame:
    table = literal_rows(df.sparkSession, ["rule", "checked", "violations"], list(rows))
    return table.select("rule", F.col("checked").cast("long"), F.col("violations").cast("long"))


def missing_values(df: DataFrame, threshold: float = MISSING_THRESHOLD) -> DataFrame:
    """Columns whose null share reaches the threshold."""
    return _static(df, [("missing_values", len(df.columns), len(sparse_columns(df, threshold)))])


def column_types(
    df: DataFrame,
    required: Sequence[str] = (),
    numeric: Sequence[str] = (),
    text: Sequence[str] = (),
) -> DataFrame:
    """Required columns present, numeric ones numeric, text ones text; schema only, absent columns skip the type check."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wrong_number = [n for n in numeric if n in kinds and not isinstance(kinds[n], NumericType)]
    wrong_text = [n for n in text if n in kinds and not isinstance(kinds[n], StringType)]
    return _static(
        df,
        [
            ("required_columns", len(required), len([n for n in required if n not in kinds])),
            ("numeric_columns", len(numeric), len(wrong_number)),
            ("text_columns", len(text), len(wrong_text)),
        ],
    )


def some_date(df: DataFrame, column: str) -> DataFrame:
    """Violated once when not a single date is known."""
    return df.agg(
        F.lit(f"some_date:{column}").alias("rule"),
        F.count(F.lit(1)).alias("checked"),
        F.when(F.count(c(column)) == 0, 1).otherwise(0).cast("long").alias("violations"),
    )


def rows_preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Violations = difference in row counts."""
    sides = before.select(F.lit(1).alias("_s")).unionByName(after.select(F.lit(-1).alias("_s")))
    return sides.agg(
        F.lit("rows_preserved").alias("rule"),
        F.count_if(F.col("_s") == 1).alias("checked"),
        F.abs(F.coalesce(F.sum("_s"), F.lit(0))).alias("violations"),
    )


def quality_report(df: DataFrame, rules: Sequence[RowRule], tables: Sequence[DataFrame] = ()) -> DataFrame:
    """Row rules of ``df`` together with the reports of table rules."""
    parts = [check_rows(df, rules)] if rules else []
    return reduce(DataFrame.unionByName, [*parts, *tables])
