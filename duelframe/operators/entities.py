"""Competitor profiles and hypothetical matchups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, functions as F

from duelframe.layout import DEFAULT, Layout, c, numeric_columns

# Context of a hypothetical bout and the stand-ins for unknown stats.
MATCHUP_CONTEXT: dict[str, object] = {
    "TitleBout": False,
    "WeightClass": "Welterweight",
    "Gender": "MALE",
    "NumberOfRounds": 3,
    "Location": "Las Vegas, Nevada, USA",
    "Country": "USA",
    "RedStance": "Orthodox",
    "BlueStance": "Orthodox",
    "BetterRank": "neither",
    "EmptyArena": False,
    "TotalFightTimeSecs": 900,
    "Finish": "No",
    "FinishDetails": "",
    "FinishRound": 3,
    "FinishRoundTime": "5:00",
}
SIDE_DEFAULTS: dict[str, float] = {
    "Age": 30,
    "HeightCms": 175,
    "ReachCms": 180,
    "WeightLbs": 170,
    "Wins": 10,
    "Losses": 3,
    "Draws": 0,
    "CurrentWinStreak": 2,
    "CurrentLoseStreak": 0,
    "LongestWinStreak": 3,
    "AvgSigStrLanded": 4.0,
    "AvgSigStrPct": 0.45,
    "AvgSubAtt": 0.5,
    "AvgTDLanded": 1.5,
    "AvgTDPct": 0.4,
    "TotalTitleBouts": 0,
    "TotalRoundsFought": 30,
    "WinsByKO": 3,
    "WinsBySubmission": 2,
    "WinsByTKODoctorStoppage": 1,
    "WinsByDecisionUnanimous": 3,
    "WinsByDecisionMajority": 1,
    "WinsByDecisionSplit": 0,
}
ODDS_DEFAULTS: dict[str, float] = {
    "RedOdds": -150,
    "BlueOdds": 130,
    "RedExpectedValue": 150.0,
    "BlueExpectedValue": 130.0,
    "RedDecOdds": 200,
    "BlueDecOdds": 250,
    "RSubOdds": 500,
    "BSubOdds": 600,
    "RKOOdds": 300,
    "BKOOdds": 350,
}


def matchup_stat_defaults(layout: Layout = DEFAULT) -> dict[str, float]:
    both = {p + base: v for base, v in SIDE_DEFAULTS.items() for p in (layout.red, layout.blue)}
    return both | ODDS_DEFAULTS


def profile_bases(df: DataFrame, layout: Layout = DEFAULT) -> list[str]:
    """Numeric base names of either side; only the leading prefix is stripped."""
    numeric = numeric_columns(df)
    bases = {n[len(p):] for p in (layout.red, layout.blue) for n in numeric if n.startswith(p)}
    return sorted(bases - {layout.entity})


def entity_profile(
    df: DataFrame,
    layout: Layout = DEFAULT,
    stats: Sequence[str] | None = None,
    entities: Sequence | None = None,
) -> DataFrame:
    """Mean of each stat per competitor over both sides, as ``entity, <stats>``.

    ``entities`` restricts the profile; the filter reaches the scan. The averages
    are combined map side, so a competitor with very many bouts is no hot task.
    """
    stats = list(stats) if stats is not None else profile_bases(df, layout)
    present = set(df.columns)
    red, blue = c(layout.red_entity), c(layout.blue_entity)
    if entities is not None:
        df = df.filter(red.isin(*entities) | blue.isin(*entities))

    def side(prefix: str) -> Column:
        values = [(c(prefix + s) if prefix + s in present else F.lit(None)).cast("double").alias(s) for s in stats]
        return F.struct(c(prefix + layout.entity).alias("entity"), *values)

    long = df.select(F.explode(F.array(side(layout.red), side(layout.blue))).alias("s")).select("s.*")
    named = F.col("entity").isNotNull() if entities is None else F.col("entity").isin(*entities)
    return long.filter(named).groupBy("entity").agg(*[F.avg(c(s)).alias(s) for s in stats])


def entity_directory(df: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Sorted distinct competitors of both sides."""
    pair = F.explode(F.array(c(layout.red_entity), c(layout.blue_entity))).alias("entity")
    return df.select(pair).filter(F.col("entity").isNotNull()).distinct().orderBy("entity")


def _folded(profiles: DataFrame) -> DataFrame:
    """Profiles keyed by lower-cased name; names that differ only in case resolve to the greatest."""
    stats = F.struct(*[c(n) for n in profiles.columns])
    return profiles.groupBy(F.lower("entity").alias("_name")).agg(F.max_by(stats, F.col("entity")).alias("_p"))


def matchups(
    requests: DataFrame,
    profiles: DataFrame,
    layout: Layout = DEFAULT,
    on: Date | None = None,
    unknown: str = "raise",
) -> DataFrame:
    """One row per request ``(red entity, blue entity, ...)`` with both profiles side by side.

    Names match without regard to case and come back in their canonical form.
    ``unknown="raise"`` refuses names without a profile and counts them;
    ``unknown_entities`` lists them. ``"keep"`` returns such requests too, with null
    stats, the name as asked for, and true in a column ``missing``; ``"drop"`` leaves them out.
    """
    if unknown not in ("raise", "keep", "drop"):
        raise ValueError(f"unknown must be 'raise', 'keep' or 'drop', not {unknown!r}")
    if unknown == "raise" and (n := unknown_entities(requests, profiles, layout).count()):
        raise KeyError(f"{n} requested competitors have no profile; unknown_entities lists them")
    how = "left" if unknown == "keep" else "inner"
    stats = [n for n in profiles.columns if n != "entity"]
    folded = _folded(profiles)
    extra = [n for n in requests.columns if n not in (layout.red_entity, layout.blue_entity)]
    out = requests.withColumns(
        {"_red": F.lower(c(layout.red_entity)), "_blue": F.lower(c(layout.blue_entity))}
    )
    out = out.join(folded.select(F.col("_name").alias("_red"), F.col("_p").alias("_rp")), "_red", how)
    out = out.join(folded.select(F.col("_name").alias("_blue"), F.col("_p").alias("_bp")), "_blue", how)
    when = F.current_date() if on is None else F.lit(on)
    sides = [
        F.col(p)[n].alias(prefix + n)
        for n in stats
        for p, prefix in (("_rp", layout.red), ("_bp", layout.blue))
    ]
    return out.select(
        *[c(n) for n in extra],
        F.coalesce(F.col("_rp")["entity"], c(layout.red_entity)).alias(layout.red_entity),
        F.coalesce(F.col("_bp")["entity"], c(layout.blue_entity)).alias(layout.blue_entity),
        when.alias(layout.date),
        *sides,
        *([(F.col("_rp").isNull() | F.col("_bp").isNull()).alias("missing")] if unknown == "keep" else []),
    )


def unknown_entities(requests: DataFrame, profiles: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Distinct requested names that no profile carries in any case."""
    names = requests.select(
        F.explode(F.array(c(layout.red_entity), c(layout.blue_entity))).alias("entity")
    ).distinct()
    known = profiles.select(F.lower("entity").alias("_name"))
    return names.withColumn("_name", F.lower("entity")).join(known, "_name", "left_anti").select("entity")


def fill_matchup(
    df: DataFrame,
    stats: Mapping[str, float] | None = None,
    context: Mapping[str, object] = MATCHUP_CONTEXT,
) -> DataFrame:
    """Context constants for absent columns, and a stand-in wherever a stat is absent or null."""
    stats = matchup_stat_defaults() if stats is None else stats
    present = set(df.columns)
    filled = {
        n: F.coalesce(c(n).cast("double"), F.lit(float(v))) if n in present else F.lit(float(v))
        for n, v in stats.items()
    }
    return df.withColumns(filled | {n: F.lit(v) for n, v in context.items() if n not in present})
