"""Queries on per-competitor history and on the one-call feature plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelframe.catalog.fixtures import BOUTS_SQL, DRAWN_SQL, GAPPY_SQL, LAYOUT, STATS, bouts, drawn, gappy
from duelframe.catalog.registry import dated, query, r6_sql, rounded, with_sql
from duelframe.functions import r6
from duelframe.operators import history as H
from duelframe.plans import engineer as engineer_plan
from duelframe.session import materialised

ALPHA = "(2.0e0 / 11)"
MOMENTUM = ("win_streak", "last3_win_rate")


def long_sql(source: str, stats=STATS) -> str:
    side = lambda label, p: (
        f"SELECT bout_id AS key, bout_date AS date, '{label}' AS side, {p}_id AS entity,"
        f" CASE WHEN winner = '{label}' THEN 1 ELSE 0 END AS is_win" + "".join(f", {p}_{s} AS {s}" for s in stats)
        + f" FROM {source}"
    )
    return f"h AS ({side('Red', 'red')} UNION ALL {side('Blue', 'blue')})"


MOMENTUM_SQL = """numbered AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date, key, side DESC) AS rn FROM h),
mom AS (SELECT *,
  CAST(rn - 1 - coalesce(max(CASE WHEN is_win = 0 THEN rn END) OVER (PARTITION BY entity ORDER BY rn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS win_streak,
  coalesce(avg(is_win) OVER (PARTITION BY entity ORDER BY rn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0.5e0) AS last3_win_rate
 FROM numbered)"""


def rolling_sql(source: str, stats, window: int = 5, name: str = "rolled") -> str:
    cols = ", ".join(
        f"avg({s}) OVER (PARTITION BY entity, side ORDER BY date, key ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
        f" AS {s}_roll{window}"
        for s in stats
    )
    return f"{name} AS (SELECT key, side, {cols} FROM {source})"


def ewma_sql(source: str, stats, name: str = "ewm") -> str:
    """Sequential walk over each competitor and side, one bout per recursion step."""
    base = "".join(f", CAST({s} AS DOUBLE) AS y_{s}, 1e0 AS w_{s}" for s in stats)
    step = "".join(
        f", CASE WHEN e.y_{s} IS NULL THEN CAST(n.{s} AS DOUBLE) WHEN n.{s} IS NULL THEN e.y_{s}"
        f" ELSE (e.w_{s} * (1 - {ALPHA}) * e.y_{s} + {ALPHA} * n.{s}) / (e.w_{s} * (1 - {ALPHA}) + {ALPHA}) END"
        f", CASE WHEN n.{s} IS NULL THEN e.w_{s} * (1 - {ALPHA}) ELSE 1e0 END"
        for s in stats
    )
    cols = ", ".join(f"e.y_{s} AS {s}_ewm10" for s in stats)
    kept = ", ".join(stats)
    return (
        f"{name}_pos AS MATERIALIZED (SELECT key, entity, side, {kept},"
        f" row_number() OVER (PARTITION BY entity, side ORDER BY date, key) AS p FROM {source}),\n"
        f"{name}_walk AS (SELECT entity, side, p{base} FROM {name}_pos WHERE p = 1"
        f" UNION ALL SELECT n.entity, n.side, n.p{step} FROM {name}_walk e"
        f" JOIN {name}_pos n ON n.entity = e.entity AND n.side = e.side AND n.p = e.p + 1),\n"
        f"{name} AS (SELECT n.key, n.side, {cols} FROM {name}_pos n LEFT JOIN {name}_walk e"
        f" ON e.entity = n.entity AND e.side = n.side AND e.p = n.p - 1)"
    )


def paired_sql(source: str, columns, diffs: bool, key: str = "key", raw=()) -> str:
    out = [f"{key} AS bout_id"]
    for n in columns:
        red, blue = (f"max(CASE WHEN side = '{s}' THEN {n} END)" for s in ("Red", "Blue"))
        wrap = (lambda x: x) if n in raw else r6_sql
        out += [f"{wrap(red)} AS red_{n}", f"{wrap(blue)} AS blue_{n}"]
        if diffs:
            out.append(f"{wrap(f'{red} - {blue}')} AS {n}_diff")
    return f"SELECT {', '.join(out)} FROM {source} GROUP BY key"


def _sided(df: DataFrame, stats=STATS) -> DataFrame:
    """The columns histories need, written out once: histories read their input more than once."""
    names = ["bout_id", "bout_date", "red_id", "blue_id", "winner", *[f"{p}_{s}" for s in stats for p in ("red", "blue")]]
    return materialised(df.select(names), codec="zstd")


_DRAWN = (BOUTS_SQL, DRAWN_SQL, long_sql("drawn"))


@query(
    with_sql(
        "SELECT key, CAST(date AS DATE) AS date, side, entity, is_win, qty FROM h", BOUTS_SQL, DRAWN_SQL, long_sql("drawn", ["qty"])
    )
)
def entity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(H.entity_history(drawn(bouts(spark, sf_dir)), LAYOUT, ["qty"]), "date")


@query(with_sql(paired_sql("mom", ["win_streak"], False, raw=MOMENTUM), *_DRAWN, MOMENTUM_SQL))
def win_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.win_streak(_sided(drawn(bouts(spark, sf_dir)), ()), LAYOUT)


@query(with_sql(paired_sql("mom", ["last3_win_rate"], False), *_DRAWN, MOMENTUM_SQL))
def last3_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.last_win_rate(_sided(drawn(bouts(spark, sf_dir)), ()), LAYOUT))


@query(with_sql(paired_sql("mom", MOMENTUM, True, raw=("win_streak",)), *_DRAWN, MOMENTUM_SQL))
def momentum_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.momentum_features(_sided(drawn(bouts(spark, sf_dir)), ()), LAYOUT))


#: Bouts get a time of day that runs against the order of their keys.
_TIMED_SQL = "timed AS (SELECT * REPLACE (bout_date + to_minutes(1439 - bout_id % 1440) AS bout_date) FROM drawn)"
_TIMED = (BOUTS_SQL, DRAWN_SQL, _TIMED_SQL, long_sql("timed"))
_SLICE = 20  # bouts per slice, so that every competitor is cut


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("bout_date", F.expr("bout_date + make_dt_interval(0, 0, CAST(1439 - bout_id % 1440 AS INT), 0)"))


@query(with_sql(paired_sql("mom", MOMENTUM, True, raw=("win_streak",)), *_TIMED, MOMENTUM_SQL))
def momentum_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sided(_timed(drawn(bouts(spark, sf_dir))), ())
    return rounded(H.momentum_features(df, LAYOUT, hot_rows=_SLICE))


#: A year's bouts are of one time and ordered by text keys that start alike.
_CROWDED_SQL = (
    "crowded AS (SELECT * REPLACE (date_trunc('year', bout_date) AS bout_date, 'bout-' || lpad(CAST(bout_id AS VARCHAR), 16, '0') AS bout_id) FROM drawn)"
)
_CROWDED = (BOUTS_SQL, DRAWN_SQL, _CROWDED_SQL, long_sql("crowded"))


def _crowded(df: DataFrame) -> DataFrame:
    key = F.concat(F.lit("bout-"), F.lpad(F.col("bout_id").cast("string"), 16, "0"))
    return df.withColumns({"bout_date": F.date_trunc("year", "bout_date"), "bout_id": key})


@query(
    with_sql(
        paired_sql("(SELECT * FROM mom JOIN ewm USING (key, side))", [*MOMENTUM, "qty_ewm10"], False, raw=("win_streak",)),
        *_CROWDED, MOMENTUM_SQL, ewma_sql("h", ["qty"]),
    )
)
def crowded_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sided(_crowded(drawn(bouts(spark, sf_dir))))
    momentum = H.momentum_features(df, LAYOUT, hot_rows=_SLICE).drop("win_streak_diff", "last3_win_rate_diff")
    form = H.form_features(df, LAYOUT, ["qty"], window=None, diffs=False, hot_rows=_SLICE)
    return rounded(momentum.join(form, "bout_id"))


_TIMED_FORM = [f"{s}_{k}" for s in ("qty", "disc") for k in ("roll5", "ewm10")]


@query(
    with_sql(
        paired_sql("(SELECT * FROM rolled JOIN ewm USING (key, side))", _TIMED_FORM, False),
        *_TIMED, rolling_sql("h", ["qty", "disc"]), ewma_sql("h", ["qty", "disc"]),
    )
)
def form_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sided(_timed(drawn(bouts(spark, sf_dir))))
    return rounded(H.form_features(df, LAYOUT, ["qty", "disc"], diffs=False, hot_rows=_SLICE))


#: A table as wide as a real one: 28 stats a side, made of the three that bouts have.
WIDE = [f"stat{i}" for i in range(28)]


def _wide_sql(prefix: str) -> str:
    return ", ".join(f"({prefix}_qty * {i + 3}) % {i + 11} + {prefix}_disc AS {prefix}_stat{i}" for i in range(28))


_WIDE = (BOUTS_SQL, f"wide AS (SELECT *, {_wide_sql('red')}, {_wide_sql('blue')} FROM bouts)", long_sql("wide", WIDE))


@query(
    with_sql(
        paired_sql("(SELECT * FROM rolled JOIN ewm USING (key, side))", [f"{s}_{k}" for s in WIDE for k in ("roll5", "ewm10")], False),
        *_WIDE, rolling_sql("h", WIDE), ewma_sql("h", WIDE),
    )
)
def form_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = {f"{p}_stat{i}": (F.col(f"{p}_qty") * (i + 3)) % (i + 11) + F.col(f"{p}_disc") for p in ("red", "blue") for i in range(28)}
    df = _sided(bouts(spark, sf_dir).withColumns(stats), WIDE)
    return H.form_features(df, LAYOUT, WIDE, diffs=False, rounded=True)


_PLAIN = (BOUTS_SQL, long_sql("bouts"))
_GAPPY = (BOUTS_SQL, GAPPY_SQL, long_sql("gappy"))


@query(with_sql(paired_sql("rolled", [f"{s}_roll5" for s in STATS], False), *_GAPPY, rolling_sql("h", STATS)))
def rolling_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sided(gappy(bouts(spark, sf_dir)))
    return rounded(H.form_features(df, LAYOUT, STATS, span=None, diffs=False))


@query(with_sql(paired_sql("rolled", [f"{s}_roll3" for s in STATS], False), *_GAPPY, rolling_sql("h", STATS, 3)))
def rolling_form_w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sided(gappy(bouts(spark, sf_dir)))
    return rounded(H.form_features(df, LAYOUT, STATS, window=3, span=None, diffs=False))


@query(with_sql(paired_sql("ewm", [f"{s}_ewm10" for s in STATS], False), *_PLAIN, ewma_sql("h", STATS)))
def ewma_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.form_features(_sided(bouts(spark, sf_dir)), LAYOUT, STATS, window=None, diffs=False))


@query(with_sql(paired_sql("ewm", ["disc_ewm10", "tax_ewm10"], False), *_GAPPY, ewma_sql("h", ["disc", "tax"])))
def ewma_form_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sided(gappy(bouts(spark, sf_dir)))
    return rounded(H.form_features(df, LAYOUT, ["disc", "tax"], window=None, diffs=False))


_FORM = [f"{s}_roll5" for s in STATS] + [f"{s}_ewm10" for s in STATS]


@query(
    with_sql(
        paired_sql("(SELECT * FROM rolled JOIN ewm USING (key, side))", _FORM, True),
        *_GAPPY, rolling_sql("h", STATS), ewma_sql("h", STATS),
    )
)
def form_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.form_features(_sided(gappy(bouts(spark, sf_dir))), LAYOUT, STATS))


_MOMENTUM_FORM = [f"{m}_{k}" for k in ("roll5", "ewm10") for m in MOMENTUM]


@query(
    with_sql(
        paired_sql("(SELECT * FROM mom JOIN rolled USING (key, side) JOIN ewm USING (key, side))",
                   [*MOMENTUM, *_MOMENTUM_FORM], True, raw=("win_streak",)),
        *_DRAWN, MOMENTUM_SQL, rolling_sql("mom", MOMENTUM), ewma_sql("mom", MOMENTUM),
    )
)
def momentum_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.history_features(_sided(drawn(bouts(spark, sf_dir)), ()), LAYOUT, []))


# --------------------------------------------------------------------------- one-call features

_RATIOS = {"strikes": "disc", "takedowns": "tax", "accuracy": "qty", "pct_scale": 100}
_CONTEXT = (
    ", ".join(f"{r6_sql(f'd.red_{b} - d.blue_{b}')} AS {b}_diff" for b in STATS)
    + f", {r6_sql('d.red_disc / nullif(d.blue_disc, 0)')} AS strikes_lpm_ratio"
    f", {r6_sql('d.red_tax / nullif(d.blue_tax, 0)')} AS td_success_ratio"
    f", {r6_sql('(100 - d.red_qty) / nullif(100 - d.blue_qty, 0)')} AS striking_def_ratio"
    f", {r6_sql('d.red_qty - d.blue_qty')} AS phys_qty_diff"
    ", CASE WHEN d.red_qty < 14 THEN 1 ELSE 0 END AS short_notice_flag"
    ", d.red_tax AS altitude_diff, CASE WHEN d.red_tax >= 1500 THEN 1 ELSE 0 END AS high_altitude_flag"
)


def _context(df: DataFrame) -> DataFrame:
    return _sided(drawn(df)).withColumns({"NoticeDays": F.col("red_qty"), "EventAltitude": F.col("red_tax")})


def _engineered(df: DataFrame, mode: str) -> DataFrame:
    out, names = engineer_plan(df, LAYOUT, mode, ratio_bases=_RATIOS, physical_bases=["qty"], finish=r6)
    extra = [n for n in out.columns if n.endswith(("_roll5", "_ewm10"))]
    keep = ["bout_id", *names, *[n for n in extra if n not in names]]
    done = ("_roll5", "_ewm10", *MOMENTUM)
    return rounded(out.select(keep), *[n for n, t in out.select(keep).dtypes if t == "double" and n != "altitude_diff" and not any(d in n for d in done)])


@query(
    with_sql(
        f"SELECT p.*, {_CONTEXT} FROM drawn d JOIN ({paired_sql('mom', MOMENTUM, True, raw=('win_streak',))}) p"
        " ON p.bout_id = d.bout_id",
        *_DRAWN, MOMENTUM_SQL,
    )
)
def engineer_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engineered(_context(bouts(spark, sf_dir)), "simple")


_BASES = [*STATS, *MOMENTUM]
_FULL = [*MOMENTUM, *[f"{b}_roll5" for b in _BASES], *[f"{b}_ewm10" for b in _BASES]]


@query(
    with_sql(
        f"SELECT p.*, {_CONTEXT} FROM drawn d JOIN ("
        + paired_sql("(SELECT * FROM mom JOIN rolled USING (key, side) JOIN ewm USING (key, side))", _FULL, True, raw=("win_streak",))
        + ") p ON p.bout_id = d.bout_id",
        *_DRAWN, MOMENTUM_SQL, rolling_sql("mom", _BASES), ewma_sql("mom", _BASES),
    )
)
def engineer_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engineered(_context(bouts(spark, sf_dir)), "full")
