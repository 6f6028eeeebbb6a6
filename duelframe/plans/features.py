"""All features of a bout table in one call."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from duelframe.layout import DEFAULT, Layout, c
from duelframe.operators import history as H
from duelframe.operators import pairs as P


def engineer(
    df: DataFrame,
    layout: Layout = DEFAULT,
    mode: str = "full",
    stats: Sequence[str] | None = None,
    history: DataFrame | None = None,
    drop_original: bool = False,
    ratio_bases: dict[str, str] | None = None,
    physical_bases: Sequence[str] = P.PHYSICAL_BASES,
    window: int = H.ROLLING_WINDOW,
    span: int = H.EWMA_SPAN,
    recent: int = H.RECENT_BOUTS,
    hot_rows: int = H.HOT_ROWS,
    finish: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, list[str]]:
    """``df`` with its engineered columns, and their sorted names.

    ``mode="simple"`` leaves out rolling means and EWMA. ``history`` holds earlier
    bouts that count as the past of ``df`` without being part of the result, which
    is what upcoming bouts need. Raw pairs go last, so ``drop_original`` disables
    no other feature. ``finish``, such as a rounding, is applied to every history feature
    that is a double before it meets its bout: together with the join and all other
    columns it would be one generated method, too long for the JVM to compile.
    """
    if mode not in ("full", "simple"):
        raise ValueError(f"mode must be 'full' or 'simple', not {mode!r}")
    bases = list(stats) if stats is not None else P.shared_bases(df, layout)
    numeric = [b for b in P.shared_bases(df, layout, numeric_only=True) if b in bases]
    out = P.pair_diffs(df, layout, bases)
    out = P.physical_diffs(out, layout, physical_bases)
    out = P.safe_ratios(out, layout, **(ratio_bases or {}))
    features = _history(df, history, layout, mode, numeric, window, span, recent, hot_rows)
    if features is not None and finish is not None:
        features = features.select([finish(c(n)).alias(n) if t == "double" and n != layout.key else c(n) for n, t in features.dtypes])
    if features is not None:
        out = out.join(features, layout.key, "left")
    out = P.altitude_features(P.short_notice_flag(out, layout))
    if drop_original:
        out = P.drop_pairs(out, bases, layout)
    return out, P.engineered_columns(out)


def _history(df, history, layout, mode, stats, window, span, recent, hot_rows) -> DataFrame | None:
    tables = [t for t in (df, history) if t is not None]
    if not all(layout.date in t.columns for t in tables):
        if history is None:
            return None
        raise ValueError(f"both tables need the column {layout.date!r}")
    wanted = [layout.key, layout.date, layout.red_entity, layout.blue_entity, layout.outcome]
    wanted += [p + s for s in stats for p in (layout.red, layout.blue)]
    narrow, past = ([t.select(*[c(n) for n in wanted if n in t.columns]) for t in tables] + [None])[:2]
    decided = any(layout.outcome in t.columns for t in tables)
    if mode == "simple":
        return H.momentum_features(narrow, layout, recent, hot_rows, past) if decided else None
    if decided:
        return H.history_features(narrow, layout, stats, window, span, recent, hot_rows=hot_rows, history=past)
    return H.form_features(narrow, layout, stats, window, span, hot_rows=hot_rows, history=past) if stats else None
