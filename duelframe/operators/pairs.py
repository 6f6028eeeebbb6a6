"""Algebra on mirrored columns: differences, ratios and context flags."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DateType, StringType, TimestampNTZType, TimestampType

from duelframe.functions import gap_days, is_below, safe_ratio
from duelframe.layout import DEFAULT, NUMERIC_TYPES, Layout, c

# Exact base names with a physical difference, the bases behind the
# named differences, flag thresholds, and the suffixes of engineered columns.
PHYSICAL_BASES = ("Height", "Reach", "Weight", "Age")
NAMED_DIFFS: dict[str, str] = {
    "WinStreakDif": "CurrentWinStreak",
    "LoseStreakDif": "CurrentLoseStreak",
    "WinDif": "Wins",
    "LossDif": "Losses",
    "HeightDif": "HeightCms",
    "ReachDif": "ReachCms",
    "AgeDif": "Age",
    "SigStrDif": "AvgSigStrLanded",
    "AvgSubAttDif": "AvgSubAtt",
    "AvgTDDif": "AvgTDLanded",
    "TotalRoundDif": "TotalRoundsFought",
    "TotalTitleBoutDif": "TotalTitleBouts",
    "KODif": "WinsByKO",
    "SubDif": "WinsBySubmission",
    "LongestWinStreakDif": "LongestWinStreak",
}
SHORT_NOTICE_DAYS = 14
HIGH_ALTITUDE = 1500
FEATURE_SUFFIXES = ("_diff", "_streak", "_win_rate", "_ratio", "_flag")

DATE_TYPES = (DateType, TimestampType, TimestampNTZType)


def shared_bases(df: DataFrame, layout: Layout = DEFAULT, numeric_only: bool = False) -> list[str]:
    """Base names present on both sides and not text, sorted. Reads the schema only."""

    def bases(prefix: str) -> set[str]:
        return {
            f.name[len(prefix):]
            for f in df.schema.fields
            if f.name.startswith(prefix)
            and not isinstance(f.dataType, StringType)
            and (isinstance(f.dataType, NUMERIC_TYPES) or not numeric_only)
        }

    return sorted((bases(layout.red) & bases(layout.blue)) - {layout.entity})


def _difference(df: DataFrame, base: str, layout: Layout, direction: str = "red-blue") -> Column:
    red, blue = c(layout.red + base), c(layout.blue + base)
    kind = df.schema[layout.red + base].dataType
    if isinstance(kind, BooleanType):
        red, blue = red.cast("int"), blue.cast("int")
    if direction == "blue-red":
        red, blue = blue, red
    return gap_days(red, blue) if isinstance(kind, DATE_TYPES) else red - blue


def pair_diffs(
    df: DataFrame,
    layout: Layout = DEFAULT,
    bases: Iterable[str] | None = None,
    numeric_only: bool = False,
    drop_original: bool = False,
) -> DataFrame:
    """``<base>_diff`` = red minus blue for every shared base, in one projection."""
    names = list(bases) if bases is not None else shared_bases(df, layout, numeric_only)
    out = df.withColumns({f"{b}_diff": _difference(df, b, layout) for b in names})
    return drop_pairs(out, names, layout) if drop_original else out


def drop_pairs(df: DataFrame, bases: Iterable[str], layout: Layout = DEFAULT) -> DataFrame:
    return df.drop(*[p + b for b in bases for p in (layout.red, layout.blue)])


def physical_diffs(
    df: DataFrame, layout: Layout = DEFAULT, bases: Iterable[str] = PHYSICAL_BASES
) -> DataFrame:
    """``phys_<base>_diff`` for the bases present on both sides under their exact names."""
    present = set(df.columns)
    return df.withColumns(
        {
            f"phys_{b.lower()}_diff": c(layout.red + b) - c(layout.blue + b)
            for b in bases
            if {layout.red + b, layout.blue + b} <= present
        }
    )


def safe_ratios(
    df: DataFrame,
    layout: Layout = DEFAULT,
    strikes: str = "AvgSigStrLanded",
    takedowns: str = "AvgTDPct",
    accuracy: str = "AvgSigStrPct",
    pct_scale: float = 100,
) -> DataFrame:
    """Red-to-blue ratios; ``pct_scale`` is the value that stands for all strikes landed."""
    present = set(df.columns)
    out: dict[str, Column] = {}

    def both(base: str) -> bool:
        return {layout.red + base, layout.blue + base} <= present

    if both(strikes):
        out["strikes_lpm_ratio"] = safe_ratio(c(layout.red + strikes), c(layout.blue + strikes))
    if both(takedowns):
        out["td_success_ratio"] = safe_ratio(c(layout.red + takedowns), c(layout.blue + takedowns))
    if both(accuracy):
        out["striking_def_ratio"] = safe_ratio(
            F.lit(pct_scale) - c(layout.red + accuracy), F.lit(pct_scale) - c(layout.blue + accuracy)
        )
    return df.withColumns(out)


def short_notice_flag(
    df: DataFrame, layout: Layout = DEFAULT, threshold: int = SHORT_NOTICE_DAYS, base: str = "NoticeDays"
) -> DataFrame:
    red, blue = layout.red + base, layout.blue + base
    if {red, blue} <= set(df.columns):
        short = is_below(c(red), threshold) | is_below(c(blue), threshold)
    elif base in df.columns:
        short = is_below(c(base), threshold)
    else:
        return df
    return df.withColumn("short_notice_flag", short.cast("int"))


def altitude_features(df: DataFrame, altitude: str = "EventAltitude", threshold: int = HIGH_ALTITUDE) -> DataFrame:
    if altitude not in df.columns:
        return df
    high = F.coalesce(c(altitude) >= threshold, F.lit(False)).cast("int")
    return df.withColumns({"altitude_diff": c(altitude), "high_altitude_flag": high})


def named_diffs(
    df: DataFrame,
    layout: Layout = DEFAULT,
    names: Mapping[str, str] = NAMED_DIFFS,
    direction: str = "blue-red",
) -> DataFrame:
    """Differences under given names; the recorded data counts them as blue minus red."""
    if direction not in ("blue-red", "red-blue"):
        raise ValueError(f"direction must be 'blue-red' or 'red-blue', not {direction!r}")
    present = set(df.columns)
    return df.withColumns(
        {
            name: _difference(df, base, layout, direction)
            for name, base in names.items()
            if {layout.red + base, layout.blue + base} <= present
        }
    )


def engineered_columns(df: DataFrame) -> list[str]:
    return sorted(n for n in df.columns if n.endswith(FEATURE_SUFFIXES))
