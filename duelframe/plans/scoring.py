"""Scoring upcoming bouts and hypothetical matchups with a saved model."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date as Date

from pyspark.sql import DataFrame, functions as F

from duelframe.layout import DEFAULT, Layout, c
from duelframe.operators.clean import IMPORTANT_COLUMNS, SCORE_TIME_DEFAULTS, clean, with_defaults
from duelframe.operators.entities import fill_matchup, matchups
from duelframe.operators.pairs import named_diffs
from duelframe.operators.scoring import predictions
from duelframe.plans.features import engineer
from duelframe.sources.models import ModelBundle


def score_upcoming(
    upcoming: DataFrame,
    model: ModelBundle,
    layout: Layout = DEFAULT,
    history: DataFrame | None = None,
    mode: str = "simple",
    defaults: Mapping[str, object] = SCORE_TIME_DEFAULTS,
    **features,
) -> DataFrame:
    """Predictions for undecided bouts: clean, engineer with real history, default, align, score."""
    ready = clean(with_defaults(upcoming, defaults), layout, keep=IMPORTANT_COLUMNS, require_outcome=False)
    table, _ = engineer(ready, layout, mode, history=history, **features)
    return predictions(model.score(table), layout, extra=[layout.key])


def score_matchups(
    requests: DataFrame,
    profiles: DataFrame,
    model: ModelBundle,
    layout: Layout = DEFAULT,
    on: Date | None = None,
    unknown: str = "raise",
    differences: Mapping[str, str] | None = None,
    stat_defaults: Mapping[str, float] | None = None,
    context: Mapping[str, object] | None = None,
    **features,
) -> DataFrame:
    """``red, blue, prob_f1_win, prob_f2_win, winner`` per requested pair; one half goes to the first.

    A hypothetical bout has no past of its own, so history features stay null and
    the fitted medians stand in for them. ``differences`` adds named differences
    (name to base), the built-in ones by default. With ``unknown="keep"`` a request
    without profiles comes back with null probabilities and ``missing`` set.
    """
    rows = matchups(requests, profiles, layout, on, unknown)
    if stat_defaults is not None or context is not None:
        rows = fill_matchup(rows, stat_defaults or {}, context or {})
    table, _ = engineer(rows.drop(layout.date), layout, "simple", **features)
    table = named_diffs(table, layout, **({} if differences is None else {"names": differences}))
    missing = unknown == "keep"
    p = F.when(~c("missing"), F.col("prob_red_win")) if missing else F.col("prob_red_win")
    scored = model.score(table)
    kept = [c(n) for n in requests.columns if n not in (layout.red_entity, layout.blue_entity)]
    red, blue = c(layout.red_entity), c(layout.blue_entity)
    return scored.select(
        *kept,
        red,
        blue,
        p.alias("prob_f1_win"),
        (1 - p).alias("prob_f2_win"),
        F.when(p >= 1 - p, red).when(p < 1 - p, blue).alias("winner"),
        *([c("missing")] if missing else []),
    )
