"""Queries on fitted models. The SQL fits the same model: Newton steps over all rows, each step a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelframe.catalog.fixtures import (
    BOUTS_SQL, DECIDED_SQL, DRAWN_SQL, LAYOUT, NAMED, NAMED_SQL, STATS, bouts, decided, drawn, named_bouts, past, upcoming,
)
from duelframe.catalog.modelling import ON, _CODE, _FOLD, _PROFILES_SQL, _UP, _auc_sql, _profiles, _requests
from duelframe.catalog.registry import query, r4, r4_sql, with_sql
from duelframe.layout import literal_rows
from duelframe.operators import clean as C, prep as T, scoring as R, split as S
from duelframe.plans import engineer, score_matchups, score_upcoming as score_upcoming_plan, train
from duelframe.plans.training import CV_PENALTIES, GBT_DEPTH, cross_validated_logreg, fit_gbt, fit_logreg, prepared
from duelframe.session import materialised, shared_folder
from duelframe.sources import ModelBundle, first_loadable, tree_nodes

_TOL = 1e-14  # fits that are compared by value run until nothing changes
_SKIP = ["bout_id", "winner"]

# --------------------------------------------------------------------------- fixtures


def _engineered(df: DataFrame) -> DataFrame:
    out, _ = engineer(df, LAYOUT, "simple", stats=STATS)
    return out.drop("red_id", "blue_id")


def _training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engineered(C.create_target(materialised(past(drawn(bouts(spark, sf_dir)))), LAYOUT))


def _features(spark: SparkSession, sf_dir: str, data: DataFrame | None = None) -> tuple[DataFrame, T.Preprocessor]:
    if data is None:
        data = materialised(_training_table(spark, sf_dir))
    prep = T.fit_preprocessor(data, exclude=_SKIP)
    return materialised(prepared(data, prep, LAYOUT)), prep


#: Two features, one of the bout and one of the past of both, so that SQL can invert the matrix of a Newton step.
_PAIR = ("qty_diff", "last3_win_rate_diff")


def _paired_table(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> DataFrame:
    """Decided bouts whose outcome follows the stats, with the two features; ``every`` is the stored table of all bouts, if there is one."""
    earlier = materialised(past(decided(bouts(spark, sf_dir)))) if every is None else past(every)
    table = _engineered(C.create_target(earlier, LAYOUT))
    return materialised(table.select("bout_id", "winner", "target", *_PAIR))


def _paired_model(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> tuple[ModelBundle, DataFrame]:
    data = _paired_table(spark, sf_dir, every)
    prep = T.fit_preprocessor(data, exclude=_SKIP)
    features = materialised(prepared(data, prep, LAYOUT))
    return ModelBundle(prep, fit_logreg(features, tol=_TOL)), features


# --------------------------------------------------------------------------- the same in SQL


def _rates_sql(source: str, name: str) -> str:
    """``name``: bout and difference of the win rates over the last three bouts with an outcome, before the bout."""
    side = "SELECT bout_id, bout_date, '{l}' AS side, {p}_id AS entity, CASE WHEN winner IS NOT NULL THEN CASE WHEN winner = '{l}' THEN 1 ELSE 0 END END AS is_win FROM {s}"
    both = " UNION ALL ".join(side.format(l=label, p=p, s=source) for label, p in (("Red", "red"), ("Blue", "blue")))
    rate = (
        "coalesce(avg(is_win) OVER (PARTITION BY entity ORDER BY bout_date, bout_id, side DESC ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0.5e0)"
    )
    return (
        f"{name} AS (SELECT bout_id, max(CASE WHEN side = 'Red' THEN rate END) - max(CASE WHEN side = 'Blue' THEN rate END) AS rates"
        f" FROM (SELECT bout_id, side, {rate} AS rate FROM ({both})) GROUP BY bout_id)"
    )


_ROWS = (
    BOUTS_SQL,
    DECIDED_SQL,
    f"tr AS (SELECT * FROM decided WHERE NOT {_UP} AND winner IN ('Red', 'Blue'))",
    _rates_sql("tr", "tr_rates"),
    "raw AS MATERIALIZED (SELECT bout_id, CASE WHEN winner = 'Red' THEN 1 ELSE 0 END AS target, red_qty - blue_qty AS q, rates AS l FROM tr JOIN tr_rates USING (bout_id))",
)


def _scale_sql(source: str = "raw", name: str = "sc") -> str:
    return f"{name} AS MATERIALIZED (SELECT avg(q) AS aq, stddev_pop(q) AS sq, avg(l) AS al, stddev_pop(l) AS sl, median(l) AS ml FROM {source})"


def _newton_sql(rows: str, name: str = "fit", by: str = "", penalty: str = "1e0", steps: int = 9) -> tuple[str, ...]:
    """``name``: intercept and coefficients (b0, b1, b2) of the ridge logistic regression on ``rows`` (y, x1, x2, weight cw, and the groups ``by``)."""
    keys = [k.strip() for k in by.split(",") if k.strip()]
    keep = "".join(f"{k}, " for k in keys)
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    own = "".join(f"r.{k} AS {k}, " for k in keys)
    on = " AND ".join(f"r.{k} = n.{k}" for k in keys) or "TRUE"
    out = [f"{name}0 AS (SELECT {keep}0e0 AS b0, 0e0 AS b1, 0e0 AS b2 FROM {rows}{group or ' LIMIT 1'})"]
    for i in range(steps):
        out += [
            f"{name}_p{i} AS (SELECT {own}b0, b1, b2, y, x1, x2, cw, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM {rows} r JOIN {name}{i} n ON {on})",
            f"{name}_h{i} AS (SELECT {keep}any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,"
            f" sum(cw * (p - y)) * {penalty} AS g0, sum(cw * (p - y) * x1) * {penalty} + any_value(b1) AS g1, sum(cw * (p - y) * x2) * {penalty} + any_value(b2) AS g2,"
            f" sum(cw * p * (1 - p)) * {penalty} AS h00, sum(cw * p * (1 - p) * x1) * {penalty} AS h01, sum(cw * p * (1 - p) * x2) * {penalty} AS h02,"
            f" sum(cw * p * (1 - p) * x1 * x1) * {penalty} + 1 AS h11, sum(cw * p * (1 - p) * x1 * x2) * {penalty} AS h12,"
            f" sum(cw * p * (1 - p) * x2 * x2) * {penalty} + 1 AS h22 FROM {name}_p{i}{group})",
            f"{name}_c{i} AS (SELECT *, h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02,"
            f" h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22 FROM {name}_h{i})",
            f"{name}{i + 1} AS MATERIALIZED (SELECT {keep}b0 - (c00 * g0 + c01 * g1 + c02 * g2) / (h00 * c00 + h01 * c01 + h02 * c02) AS b0,"
            f" b1 - (c01 * g0 + c11 * g1 + c12 * g2) / (h00 * c00 + h01 * c01 + h02 * c02) AS b1,"
            f" b2 - (c02 * g0 + c12 * g1 + c22 * g2) / (h00 * c00 + h01 * c01 + h02 * c02) AS b2 FROM {name}_c{i})",
        ]
    return (*out, f"{name} AS (SELECT * FROM {name}{steps})")


def _rows_sql(source: str, scale: str, name: str, centred: bool = True, first: bool = True) -> str:
    """Scaled and balanced rows; without ``first`` the first feature is left out."""
    aq, al = (f"{scale}.aq", f"{scale}.al") if centred else ("0", "0")
    x1 = f"(q - {aq}) / sq" if first else "0e0"
    return (
        f"{name} AS MATERIALIZED (SELECT bout_id, target, target AS y, {x1} AS x1, (l - {al}) / sl AS x2,"
        f" count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY target)) AS cw FROM {source}, {scale})"
    )


_FIT = (*_ROWS, _scale_sql(), _rows_sql("raw", "sc", "x"), *_newton_sql("x"))


def _logistic(x1: str, x2: str, fit: str = "fit") -> str:
    return f"1 / (1 + exp(-({fit}.b0 + {fit}.b1 * ({x1}) + {fit}.b2 * ({x2}))))"


# --------------------------------------------------------------------------- logistic regression


@query(
    with_sql(
        " UNION ALL ".join(f"SELECT '{n}' AS feature, {r4_sql(b)} AS coefficient FROM fit" for n, b in zip((*_PAIR, "(intercept)"), ("b1", "b2", "b0"))),
        *_FIT,
    )
)
def logreg_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted coefficients by feature."""
    bundle, _ = _paired_model(spark, sf_dir)
    model = bundle.classifier.stages[-1]
    rows = list(zip([*bundle.preprocessor.names, "(intercept)"], [*map(float, model.coefficients), float(model.intercept)]))
    return literal_rows(spark, ["feature", "coefficient"], rows).withColumn("coefficient", r4(F.col("coefficient")))


@query()
def logreg_fit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted coefficients of every feature the plan makes; the tests compare such a fit with a solver of their own."""
    features, prep = _features(spark, sf_dir)
    model = fit_logreg(features).stages[-1]
    rows = list(zip([*prep.names, "(intercept)"], [*map(float, model.coefficients), float(model.intercept)]))
    return literal_rows(spark, ["feature", "coefficient"], rows)


_PENALTIES = ", ".join(f"({p!r}::DOUBLE)" for p in CV_PENALTIES)
_GRID = (
    *_ROWS,
    _scale_sql(),
    f"folded AS MATERIALIZED (SELECT *, (q - aq) / sq AS x1, (l - al) / sl AS x2, {_FOLD} AS f FROM raw, sc)",
    f"fits AS (SELECT * FROM (VALUES {_PENALTIES}) v(penalty) CROSS JOIN range(5) t(fold))",
    "grid AS MATERIALIZED (SELECT penalty, fold, f, bout_id, target, target AS y, x1, x2,"
    " count(*) OVER (PARTITION BY penalty, fold) / (2e0 * count(*) OVER (PARTITION BY penalty, fold, target)) AS cw FROM folded JOIN fits ON f <> fold)",
    *_newton_sql("grid", by="penalty, fold", penalty="any_value(penalty)"),
    f"tested AS (SELECT n.penalty, n.fold, target, {_logistic('x1', 'x2', 'n')} AS score FROM folded JOIN fit n ON f = n.fold)",
    f"areas AS ({_auc_sql('score', 'tested', 'penalty, fold')})",
)


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _, features = _paired_model(spark, sf_dir)
    _, _, scores = cross_validated_logreg(features, tol=_TOL)
    return literal_rows(spark, ["penalty", "fold", "roc_auc"], scores), features


@query(
    with_sql(
        f"SELECT penalty, {r4_sql('avg(roc_auc)', 3)} AS mean, {r4_sql('stddev_pop(roc_auc)', 3)} AS std FROM areas GROUP BY penalty", *_GRID
    )
)
def logreg_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of ROC-AUC per penalty over five stratified folds."""
    fits, _ = _grid(spark, sf_dir)
    return fits.groupBy("penalty").agg(r4(F.avg("roc_auc"), 3).alias("mean"), r4(F.stddev_pop("roc_auc"), 3).alias("std"))


@query(
    with_sql(
        f"SELECT a.penalty, a.fold::INTEGER AS fold, n AS tested, {r4_sql('roc_auc', 3)} AS roc_auc FROM areas a"
        " JOIN (SELECT f, count(*) AS n FROM folded GROUP BY f) t ON t.f = a.fold",
        *_GRID,
    )
)
def logreg_cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows tested per penalty and fold, and how that fit ranks them, to three places: in small folds a pair of rows
    whose scores nearly tie can change the fourth from run to run, as sums of doubles depend on the order of tasks."""
    fits, features = _grid(spark, sf_dir)
    tested = S.stratified_folds(features).groupBy("fold").agg(F.count(F.lit(1)).alias("tested"))
    return fits.join(tested, "fold").select("penalty", "fold", "tested", r4(F.col("roc_auc"), 3).alias("roc_auc"))


# --------------------------------------------------------------------------- training with a champion

_HELD = (
    *_ROWS,
    f"parts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {_CODE}) <= ceil(0.15e0 * count(*) OVER (PARTITION BY target)) AS held FROM raw)",
    "seen AS (SELECT * FROM parts WHERE NOT held)",
    _scale_sql("seen"),
    _rows_sql("seen", "sc", "x", centred=False),
    *_newton_sql("x"),
    _rows_sql("seen", "sc", "xw", centred=False, first=False),
    *_newton_sql("xw", "weak"),
    f"judged AS (SELECT target, {_logistic('q / sq', 'l / sl')} AS strong, {_logistic('0', 'l / sl', 'weak')} AS feeble FROM parts, sc, fit, weak WHERE held)",
    f"a AS ({_auc_sql('strong')}), b AS ({_auc_sql('feeble')})",
    "acc AS (SELECT avg(CASE WHEN (strong > 0.5) = (target = 1) THEN 1e0 ELSE 0e0 END) AS s, avg(CASE WHEN (feeble > 0.5) = (target = 1) THEN 1e0 ELSE 0e0 END) AS f FROM judged)",
)


@query(
    with_sql(
        f"SELECT 'both features' AS challenger, {r4_sql('s')} AS accuracy, {r4_sql('a.roc_auc')} AS roc_auc, a.roc_auc >= b.roc_auc AS promoted FROM a, b, acc"
        f" UNION ALL SELECT 'one feature', {r4_sql('f')}, {r4_sql('b.roc_auc')}, b.roc_auc >= a.roc_auc FROM a, b, acc",
        *_HELD,
    )
)
def train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main route in one call, 15 % hold-out, scaling without centring, text of any width: each of two models as challenger of the other."""
    table = _paired_table(spark, sf_dir)

    def run(exclude: list[str], champion: ModelBundle | None):
        path = shared_folder(spark)
        made = train(
            table, LAYOUT, "logreg", fraction=0.15, exclude=[*_SKIP, *exclude], max_categories=None, center=False, tol=_TOL, champion=champion, promote_to=path
        )
        return made, path

    _, strong = run([], None)
    _, weak = run([_PAIR[0]], None)
    rows = []
    for name, exclude, other in (("both features", [], weak), ("one feature", [_PAIR[0]], strong)):
        made, _ = run(exclude, ModelBundle.load(other, spark))
        rows.append((name, made.accuracy, made.roc_auc, made.promoted))
    found = literal_rows(spark, ["challenger", "accuracy", "roc_auc", "promoted"], rows)
    return found.withColumns({n: r4(F.col(n)) for n in ("accuracy", "roc_auc")})


@query(
    with_sql(
        f"SELECT CAST(target AS VARCHAR) AS class, count(*) AS support FROM (SELECT target, row_number() OVER (PARTITION BY target ORDER BY {_CODE}) AS rn,"
        " count(*) OVER (PARTITION BY target) AS n FROM"
        f" (SELECT bout_id, CASE WHEN winner = 'Red' THEN 1 ELSE 0 END AS target FROM drawn WHERE NOT {_UP} AND winner IN ('Red', 'Blue')))"
        " WHERE rn <= ceil(0.15e0 * n) GROUP BY target",
        BOUTS_SQL, DRAWN_SQL,
    )
)
def train_cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main route with all features and a cross-validated penalty; the hold-out it was judged on."""
    result = train(
        _training_table(spark, sf_dir), LAYOUT, "logreg", fraction=0.15, exclude=_SKIP, max_categories=None, cross_validate=True, center=False
    )
    return result.report.filter(F.col("class").isin("0", "1")).select("class", "support")


# --------------------------------------------------------------------------- boosted trees


@query()
def gbt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature importances of gradient boosted trees."""
    features, prep = _features(spark, sf_dir)
    importances = fit_gbt(features).stages[-1].featureImportances.toArray()
    return literal_rows(spark, ["feature", "importance"], [(n, float(v)) for n, v in zip(prep.names, importances)])


@query(
    with_sql(
        f"SELECT count(*) AS rows, 0::BIGINT AS differing, 1e0 AS importance FROM drawn WHERE NOT {_UP} AND winner IN ('Red', 'Blue')", BOUTS_SQL, DRAWN_SQL
    )
)
def gbt_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the full ensemble next to a walk over its saved table of nodes, and the sum of its importances."""
    features, prep = _features(spark, sf_dir)
    bundle, path = ModelBundle(prep, fit_gbt(features)), shared_folder(spark)
    bundle.save(path, spark)
    model = bundle.classifier.stages[-1]
    walked = R.score_by_nodes(features, tree_nodes(path, spark), model.getNumTrees, GBT_DEPTH, "bout_id", "walked")
    both = R.positive_probability(bundle.classifier.transform(features)).join(walked, "bout_id")
    total = F.lit(float(model.featureImportances.toArray().sum()))
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("prob_red_win") - F.col("walked")) > 1e-9).alias("differing"), r4(total).alias("importance")
    )


_STUMPS = 4  # trees of one split


def _stumps_sql() -> tuple[str, ...]:
    """Boosting by hand: every round takes the split of either feature with the least squares, then the margins move by its means."""
    out = ["t0 AS MATERIALIZED (SELECT bout_id, a, b, 2e0 * target - 1 AS y, 0e0 AS m FROM stepped)"]
    for r in range(_STUMPS):
        residual, weight = ("y", 1.0) if r == 0 else ("4 * y / (1 + exp(2 * y * m))", 0.1)
        sides = " UNION ALL ".join(
            f"SELECT '{f}' AS f, v, sum(sum(z)) OVER w AS left_sum, sum(sum(n)) OVER w AS left_n, sum(sum(z)) OVER () AS s, sum(sum(n)) OVER () AS n"
            f" FROM (SELECT {f} AS v, z, 1 AS n FROM z{r}) GROUP BY v WINDOW w AS (ORDER BY v)"
            for f in "ab"
        )
        out += [
            f"z{r} AS MATERIALIZED (SELECT *, {residual} AS z FROM t{r})",
            f"best{r} AS MATERIALIZED (SELECT f, v, left_sum / left_n AS lo, (s - left_sum) / (n - left_n) AS hi FROM ({sides}) WHERE left_n < n"
            " ORDER BY left_sum * left_sum / left_n + (s - left_sum) * (s - left_sum) / (n - left_n) DESC LIMIT 1)",
            f"t{r + 1} AS MATERIALIZED (SELECT bout_id, a, b, y, m + {weight}e0 * CASE WHEN (CASE f WHEN 'a' THEN a ELSE b END) <= v THEN lo ELSE hi END AS m FROM z{r}, best{r})",
        ]
    return tuple(out)


@query(
    with_sql(
        f"SELECT bout_id, {r4_sql('1 / (1 + exp(-2 * m))')} AS prob_red_win FROM t{_STUMPS}",
        *_ROWS,
        "stepped AS MATERIALIZED (SELECT bout_id, CASE WHEN winner = 'Red' THEN 1 ELSE 0 END AS target, floor((red_qty - blue_qty) / 10) AS a,"
        " floor(round(red_disc * 100) / 2) - floor(round(blue_disc * 100) / 2) AS b FROM tr)",
        *_stumps_sql(),
    )
)
def gbt_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few boosted trees of one split on two features of few values, where the best split can be found by hand."""
    df = C.create_target(past(decided(bouts(spark, sf_dir))), LAYOUT)
    halves = [F.floor(F.round(F.col(f"{p}_disc") * 100) / 2) for p in ("red", "blue")]
    steps = {"a": F.floor((F.col("red_qty") - F.col("blue_qty")) / 10), "b": halves[0] - halves[1]}
    data = materialised(df.select("bout_id", "target", *[x.cast("double").alias(n) for n, x in steps.items()]))
    features = materialised(prepared(data, T.fit_preprocessor(data, exclude=["bout_id"]), LAYOUT))
    scored = R.positive_probability(fit_gbt(features, trees=_STUMPS, depth=1).transform(features))
    return scored.select("bout_id", r4(F.col("prob_red_win")).alias("prob_red_win"))


# --------------------------------------------------------------------------- scoring with a fitted model


@query(
    with_sql(
        f"SELECT count(*) AS rows, 0::BIGINT AS differing FROM drawn WHERE NOT {_UP} AND winner IN ('Red', 'Blue')", BOUTS_SQL, DRAWN_SQL
    )
)
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a saved and reloaded model next to those of the model in memory."""
    data = materialised(_training_table(spark, sf_dir))  # fitted on and scored: made once
    features, prep = _features(spark, sf_dir, data)
    bundle = ModelBundle(prep, fit_logreg(features))
    path = shared_folder(spark)
    bundle.save(path, spark)
    again = first_loadable([f"{path}-absent", path], spark)
    both = again.score(bundle.score(data, out="before"), out="after")
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("before") - F.col("after")) > 1e-12).alias("differing")
    )


_UPCOMING = f"all_bouts AS (SELECT * REPLACE (CASE WHEN NOT ({_UP}) THEN winner END AS winner) FROM decided)"
_SCORE = _logistic("(n.red_qty - n.blue_qty - aq) / sq", "(rates - al) / sl")


@query(
    with_sql(
        f"SELECT bout_id, red_id, blue_id, {r4_sql('p')} AS prob_red_win, CASE WHEN p >= 0.5 THEN 'Red' ELSE 'Blue' END AS predicted_winner,"
        f" {r4_sql('greatest(p, 1 - p)')} AS confidence FROM (SELECT n.*, {_SCORE} AS p FROM all_bouts n JOIN up_rates USING (bout_id), sc, fit WHERE {_UP})",
        *_FIT, _UPCOMING, _rates_sql("all_bouts", "up_rates"),
    )
)
def score_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecided bouts, with the past of their competitors."""
    every = materialised(decided(bouts(spark, sf_dir)))  # fitted on, looked up and scored: made once
    bundle, _ = _paired_model(spark, sf_dir, every)
    found = score_upcoming_plan(upcoming(every), bundle, LAYOUT, history=past(every), stats=STATS)
    return found.withColumns({n: r4(F.col(n)) for n in ("prob_red_win", "confidence")})


_MATCHED = _logistic("(r.qty - u.qty - aq) / sq", "(ml - al) / sl")


@query(
    with_sql(
        f"SELECT bout_id, red_name, blue_name, {r4_sql('p')} AS prob_f1_win, {r4_sql('1 - p')} AS prob_f2_win, CASE WHEN p >= 1 - p THEN red_name ELSE blue_name END AS winner"
        f" FROM (SELECT n.bout_id, r.entity AS red_name, u.entity AS blue_name, {_MATCHED} AS p FROM named n JOIN profiles r ON r.entity = n.red_name"
        f" JOIN profiles u ON u.entity = n.blue_name, sc, fit WHERE n.{_UP})",
        *_FIT, NAMED_SQL, _PROFILES_SQL,
    )
)
def matchup_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypothetical bouts have no past of their own: the fitted median stands in."""
    every = materialised(bouts(spark, sf_dir))
    bundle, _ = _paired_model(spark, sf_dir, decided(every))
    # Requests and profiles are read more than once, so the names are joined once.
    named = materialised(named_bouts(spark, sf_dir, every).select("bout_id", "bout_date", *[f"{p}_{n}" for n in ("name", *STATS) for p in ("red", "blue")]))
    found = score_matchups(_requests(spark, sf_dir, named), _profiles(spark, sf_dir, named=named), bundle, NAMED, on=ON, stats=STATS)
    return found.withColumns({n: r4(F.col(n)) for n in ("prob_f1_win", "prob_f2_win")})
