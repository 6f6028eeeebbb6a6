"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Tier edges and label widths.
HIGH_CONFIDENCE = 0.7
MEDIUM_CONFIDENCE = 0.55
LABEL_WIDTH = 34
LABEL_KEEP = 31


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` with a zero denominator giving null, also under ANSI mode."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def is_below(value: Column, threshold: float) -> Column:
    """``value < threshold`` where null counts as false."""
    return F.coalesce(value < F.lit(threshold), F.lit(False))


def gap_days(red: Column, blue: Column) -> Column:
    return F.datediff(red, blue)


def predicted_winner(p: Column, red: str = "Red", blue: str = "Blue") -> Column:
    """Hard label; one half goes to red everywhere."""
    return F.when(p >= 0.5, F.lit(red)).when(p < 0.5, F.lit(blue))


def confidence(p: Column) -> Column:
    return F.greatest(p, F.lit(1.0) - p)


def confidence_tier(conf: Column) -> Column:
    return F.when(conf > HIGH_CONFIDENCE, "high").when(conf > MEDIUM_CONFIDENCE, "medium").otherwise("low")


def bout_label(red: Column, blue: Column) -> Column:
    label = F.concat_ws(" vs ", red.cast("string"), blue.cast("string"))
    return F.when(F.length(label) > LABEL_WIDTH, F.concat(F.substring(label, 1, LABEL_KEEP), F.lit("..."))).otherwise(label)


def r6(x: Column) -> Column:
    """Round to six places in plain double arithmetic, without a negative zero.

    The rounding point lies a ten-thousandth off the half: means of decimal data
    often end exactly on a half, where the order of summation would decide.
    """
    return millionths(x) / 1e6


def millionths(x: Column) -> Column:
    """The whole number of millionths that ``r6`` rounds to."""
    return F.floor(x * 1e6 + 0.5001)
