"""Queries on profiles and matchups, fitted preprocessing, splits, models, metrics and scoring."""

from __future__ import annotations

from datetime import date

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from duelframe.catalog.fixtures import (
    BOUTS_SQL, DRAWN_SQL, GAPPY_SQL, LAYOUT, NAMED, NAMED_SQL, SCORED_SQL, STATS, UPCOMING_FROM, bouts, drawn, gappy,
    named_bouts, past, scored, table, upcoming,
)
from duelframe.catalog.registry import query, r6_sql, rounded, with_sql
from duelframe.operators import clean as C, entities as E, metrics as M, prep as T, scoring as R, split as S
from duelframe.session import materialised

# --------------------------------------------------------------------------- profiles and matchups

_SIDES = (
    "SELECT red_{e} AS entity, red_qty AS qty, red_disc AS disc, red_tax AS tax{r} FROM {src}"
    " UNION ALL SELECT blue_{e}, blue_qty, blue_disc, blue_tax{b} FROM {src}"
)
_MEANS = ", ".join(f"{r6_sql(f'avg({s})')} AS {s}" for s in STATS)
_BY_ID = _SIDES.format(e="id", src="gappy", r="", b="")


@query(with_sql(f"SELECT entity, {_MEANS} FROM ({_BY_ID}) GROUP BY entity", BOUTS_SQL, GAPPY_SQL))
def entity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.entity_profile(gappy(bouts(spark, sf_dir)), LAYOUT, STATS))


_CHOSEN = [f"Supplier#{i:09d}" for i in (1, 2, 3, 5, 8)]
_CHOSEN_SQL = ", ".join(f"'{n}'" for n in _CHOSEN)


@query(
    with_sql(
        f"SELECT entity, {_MEANS} FROM ({_SIDES.format(e='name', src='named', r='', b='')})"
        f" WHERE entity IN ({_CHOSEN_SQL}) GROUP BY entity",
        BOUTS_SQL, NAMED_SQL,
    )
)
def entity_profile_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of a few named competitors, which is what this operator is for."""
    return rounded(E.entity_profile(named_bouts(spark, sf_dir), NAMED, STATS, entities=_CHOSEN))


@query(
    with_sql(
        "SELECT red_name AS entity FROM named UNION SELECT blue_name FROM named ORDER BY 1", BOUTS_SQL, NAMED_SQL
    )
)
def entity_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.entity_directory(named_bouts(spark, sf_dir), NAMED)


ON = date(2002, 1, 1)
_UP = f"bout_date >= TIMESTAMP '{UPCOMING_FROM}'"


def _requests(spark: SparkSession, sf_dir: str, named: DataFrame | None = None) -> DataFrame:
    """The pairings of upcoming bouts, asked for in upper and lower case."""
    return upcoming(named_bouts(spark, sf_dir) if named is None else named).select(
        "bout_id", F.upper("red_name").alias("red_name"), F.lower("blue_name").alias("blue_name")
    )


def _profiles(spark: SparkSession, sf_dir: str, stats=STATS, named: DataFrame | None = None) -> DataFrame:
    return E.entity_profile(past(named_bouts(spark, sf_dir) if named is None else named), NAMED, stats)


_PROFILES_SQL = (
    "profiles AS (SELECT entity, avg(qty) AS qty, avg(disc) AS disc, avg(tax) AS tax, avg(peak) AS peak FROM ("
    + _SIDES.format(e="name", src="named", r=", red_peak AS peak, bout_date", b=", blue_peak, bout_date")
    + f") WHERE NOT {_UP} GROUP BY entity)"
)
_PAIR = ", ".join(f"{r6_sql(f'{a}.{s}')} AS {p}_{s}" for s in STATS for a, p in (("r", "red"), ("u", "blue")))
_JOINED = "FROM named n JOIN profiles r ON r.entity = n.red_name JOIN profiles u ON u.entity = n.blue_name WHERE n." + _UP


@query(
    with_sql(
        f"SELECT n.bout_id, r.entity AS red_name, u.entity AS blue_name, DATE '2002-01-01' AS bout_date, {_PAIR} {_JOINED}",
        BOUTS_SQL, NAMED_SQL, _PROFILES_SQL,
    )
)
def matchup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.matchups(_requests(spark, sf_dir), _profiles(spark, sf_dir), NAMED, ON))


@query("SELECT c_name AS entity FROM customer")
def matchup_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is asked for next to one of the first ten suppliers; customers have no profile, suppliers have one."""
    customers = table(spark, sf_dir, "customer")
    suppliers = table(spark, sf_dir, "supplier")
    asked = customers.join(suppliers, F.col("s_suppkey") == F.col("c_custkey") % 10).select(
        F.upper("s_name").alias("red_name"), F.col("c_name").alias("blue_name")
    )
    known = suppliers.select(F.col("s_name").alias("entity"))
    return E.unknown_entities(asked, known, NAMED)


_FILLED = ", ".join(
    f"{r6_sql(f'coalesce({a}.peak, {v})')} AS {p}_peak, {v2} AS {p}_reach"
    for a, p, v, v2 in (("r", "red", "0.5e0", "180e0"), ("u", "blue", "0.25e0", "181e0"))
)


@query(
    with_sql(
        f"SELECT n.bout_id, {_FILLED}, 'Welterweight' AS WeightClass, 3 AS NumberOfRounds, FALSE AS TitleBout {_JOINED}",
        BOUTS_SQL, NAMED_SQL, _PROFILES_SQL,
    )
)
def matchup_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.matchups(_requests(spark, sf_dir), _profiles(spark, sf_dir, ["peak"]), NAMED, ON)
    stand_ins = {"red_peak": 0.5, "blue_peak": 0.25, "red_reach": 180, "blue_reach": 181}
    filled = E.fill_matchup(rows, stand_ins)
    names = ["red_peak", "blue_peak", "red_reach", "blue_reach"]
    return rounded(filled.select("bout_id", *names, "WeightClass", "NumberOfRounds", "TitleBout"), *names)


# --------------------------------------------------------------------------- fitted preprocessing


def _gappy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(gappy(bouts(spark, sf_dir)).select("bout_id", "red_disc", "blue_tax", "red_qty", "red_rare"))


_NUMBERS = ("red_disc", "blue_tax", "red_qty", "red_rare")


@query(
    with_sql(
        "SELECT bout_id, "
        + ", ".join(f"{r6_sql(f'coalesce({n}, (SELECT median({n}) FROM gappy))')} AS {n}" for n in _NUMBERS)
        + " FROM gappy",
        BOUTS_SQL, GAPPY_SQL,
    )
)
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.impute_medians(_gappy_stats(spark, sf_dir), _NUMBERS))


@query(
    with_sql(
        "SELECT bout_id, grp, coalesce(red_flag, (SELECT red_flag FROM gappy WHERE red_flag IS NOT NULL GROUP BY red_flag"
        " ORDER BY count(*) DESC, red_flag LIMIT 1)) AS red_flag FROM gappy",
        BOUTS_SQL, GAPPY_SQL,
    )
)
def mode_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.impute_modes(gappy(bouts(spark, sf_dir)).select("bout_id", "grp", "red_flag"), ["grp", "red_flag"])


def _scaled_sql(center: bool) -> str:
    cols = ", ".join(
        r6_sql(f"({n}{f' - (SELECT avg({n}) FROM gappy)' if center else ''}) / (SELECT stddev_pop({n}) FROM gappy)")
        + f" AS {n}"
        for n in _NUMBERS
    )
    return with_sql(f"SELECT bout_id, {cols} FROM gappy", BOUTS_SQL, GAPPY_SQL)


@query(_scaled_sql(True))
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.standardise(_gappy_stats(spark, sf_dir), _NUMBERS))


@query(_scaled_sql(False))
def scale_no_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.standardise(_gappy_stats(spark, sf_dir), _NUMBERS, center=False))


def unpacked(df: DataFrame, names: list[str], keep=("bout_id",)) -> DataFrame:
    """The feature vector as one column per slot."""
    values = vector_to_array("features")
    return df.select(*keep, *[values[i].alias(n) for i, n in enumerate(names)])


_GRP = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_HOT_GRP = ", ".join(f"CASE WHEN grp = '{v}' THEN 1e0 ELSE 0e0 END AS \"grp={v}\"" for v in _GRP)


@query(
    with_sql(
        f"SELECT bout_id, {_HOT_GRP}, CASE WHEN red_flag = 'A' THEN 1e0 ELSE 0e0 END AS \"red_flag=A\","
        " CASE WHEN red_flag = 'N' THEN 1e0 ELSE 0e0 END AS \"red_flag=N\" FROM bouts",
        BOUTS_SQL,
    )
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on rows that never show flag R, so R is an unknown category here."""
    df = bouts(spark, sf_dir).select("bout_id", "grp", "red_flag", F.lit(1).alias("target"))
    prep = T.fit_preprocessor(df.filter(F.col("red_flag") != "R"), exclude=["bout_id"])
    return unpacked(prep.transform(df), prep.names)


@query(
    "SELECT column_name, n_distinct, n_distinct <= 20 AS kept FROM ("
    "SELECT 'lang' AS column_name, count(DISTINCT lang) AS n_distinct FROM documents"
    " UNION ALL SELECT 'source', count(DISTINCT source) FROM documents"
    " UNION ALL SELECT 'text', count(DISTINCT text) FROM documents)"
)
def cardinality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.category_sizes(table(spark, sf_dir, "documents"), ["lang", "source", "text"])


_LINE = "concat('line-', CAST(bout_id AS VARCHAR))"


@query(
    with_sql(
        f"SELECT bout_id, concat_ws(',', CAST(g.slot AS VARCHAR), CAST(l.slot AS VARCHAR)) AS slots, (SELECT count(*) FROM vocab)::INTEGER AS width"
        f" FROM bouts LEFT JOIN vocab g ON g.column_name = 'grp' AND g.value = grp LEFT JOIN vocab l ON l.column_name = 'line' AND l.value = {_LINE}",
        BOUTS_SQL,
        f"seen AS (SELECT * FROM bouts WHERE bout_date < TIMESTAMP '{UPCOMING_FROM}')",
        "vocab AS (SELECT column_name, value, row_number() OVER (ORDER BY column_name, value) - 1 AS slot FROM"
        f" (SELECT 'grp' AS column_name, grp AS value FROM seen UNION SELECT 'line', {_LINE} FROM seen))",
    )
)
def one_hot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text column with a value of its own in every row, fitted on earlier bouts: later ones have no slot for theirs."""
    line = F.concat(F.lit("line-"), F.col("bout_id").cast("string"))
    df = materialised(bouts(spark, sf_dir).select("bout_id", "bout_date", "grp", line.alias("line"), F.lit(1).alias("target")))
    prep = T.fit_preprocessor(past(df), exclude=["bout_id"], max_categories=None)
    vector = F.unwrap_udt("features")
    return prep.transform(df).select("bout_id", F.concat_ws(",", F.transform(vector["indices"], lambda i: i.cast("string"))).alias("slots"), vector["size"].alias("width"))


_FEATURES = ("red_disc", "blue_tax", "red_qty")


def _feature_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gappy(bouts(spark, sf_dir)).withColumn("target", (F.col("winner") == "Red").cast("int"))
    big = (F.col("red_qty") > 25).alias("big")
    return materialised(df.select("bout_id", "bout_date", "target", "grp", "red_flag", *_FEATURES, big))


def _feature_sql(fitted_on: str, applied_to: str) -> str:
    """Medians, then moments of the imputed column, both of the fitted rows."""
    fit = f"fitrows AS (SELECT * FROM gappy{fitted_on})"
    med = "meds AS (SELECT " + ", ".join(f"median({n}) AS m_{n}" for n in _FEATURES) + " FROM fitrows)"
    mom = (
        "moms AS (SELECT "
        + ", ".join(f"avg(coalesce({n}, m_{n})) AS a_{n}, stddev_pop(coalesce({n}, m_{n})) AS s_{n}" for n in _FEATURES)
        + " FROM fitrows, meds)"
    )
    mode = (
        "modes AS (SELECT red_flag AS f FROM fitrows WHERE red_flag IS NOT NULL GROUP BY red_flag"
        " ORDER BY count(*) DESC, red_flag LIMIT 1)"
    )
    cols = ", ".join(f"{r6_sql(f'(coalesce({n}, m_{n}) - a_{n}) / s_{n}')} AS {n}" for n in _FEATURES)
    flags = ", ".join(
        f"CASE WHEN coalesce(red_flag, f) = '{v}' THEN 1e0 ELSE 0e0 END AS \"red_flag={v}\"" for v in ("A", "N")
    )
    return with_sql(
        f"SELECT bout_id, {cols}, {_HOT_GRP}, {flags} FROM gappy, meds, moms, modes{applied_to}",
        BOUTS_SQL, GAPPY_SQL, fit, med, mom, mode,
    )


@query(_feature_sql("", ""))
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boolean and the date are no features."""
    df = _feature_input(spark, sf_dir)
    prep = T.fit_preprocessor(df, exclude=["bout_id"])
    return rounded(unpacked(prep.transform(df), prep.names))


@query(_feature_sql(f" WHERE NOT {_UP}", f" WHERE {_UP}"))
def transform_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _feature_input(spark, sf_dir)
    prep = T.fit_preprocessor(past(df), exclude=["bout_id"])
    later = df.filter(F.col("bout_date") >= F.lit(UPCOMING_FROM).cast("timestamp_ntz"))
    return rounded(unpacked(prep.transform(later), prep.names))


# --------------------------------------------------------------------------- split

_LABELLED = "labelled AS (SELECT bout_id, CASE WHEN winner = 'Red' THEN 1 ELSE 0 END AS target FROM drawn)"
_CODE = "md5(concat(CAST(bout_id AS VARCHAR), '-42'))"
_RANK = f"row_number() OVER (PARTITION BY target ORDER BY {_CODE})"
_FOLD = "CAST((" + " + ".join(f"CASE WHEN {_RANK} > {f} * count(*) OVER (PARTITION BY target) // 5 THEN 1 ELSE 0 END" for f in range(1, 5)) + ") AS INTEGER)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = drawn(bouts(spark, sf_dir)).select("bout_id", (F.col("winner") == "Red").cast("int").alias("target"))
    return materialised(df)


@query(
    with_sql(
        f"SELECT bout_id, target, row_number() OVER (PARTITION BY target ORDER BY {_CODE})"
        " <= ceil(0.2e0 * count(*) OVER (PARTITION BY target)) AS is_holdout FROM labelled",
        BOUTS_SQL, DRAWN_SQL, _LABELLED,
    )
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_split(_labelled(spark, sf_dir))


@query(
    with_sql(
        f"SELECT bout_id, target, {_FOLD} AS fold FROM labelled",
        BOUTS_SQL, DRAWN_SQL, _LABELLED,
    )
)
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_folds(_labelled(spark, sf_dir))


@query(
    with_sql(
        f"SELECT target, count(*) AS class_rows, {r6_sql('sum(count(*)) OVER () / (count(*) OVER () * count(*)::DOUBLE)')}"
        " AS class_weight FROM labelled GROUP BY target",
        BOUTS_SQL, DRAWN_SQL, _LABELLED,
    )
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.class_weights(_labelled(spark, sf_dir)))


@query(
    "SELECT doc_id, toxic, CASE WHEN toxic IS NULL THEN NULL ELSE floor((SELECT count(*) FROM labels WHERE toxic IS NOT NULL)"
    " / (2e0 * count(*) OVER (PARTITION BY toxic)) * 1e6 + 0.5001) / 1e6 END AS class_weight,"
    " CAST((" + " + ".join(
        f"CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '-42')))"
        f" > {f} * count(*) OVER (PARTITION BY toxic) // 5 THEN 1 ELSE 0 END" for f in range(1, 5)
    ) + ") AS INTEGER) AS fold FROM documents LEFT JOIN labels USING (doc_id)"
)
def null_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label keep their rows: a fold of their own class, no weight."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "toxic")
    return rounded(S.stratified_folds(S.with_class_weights(docs, "toxic"), "toxic", "doc_id"))


_ASKED = (
    "asked AS (SELECT c_custkey AS bout_id, upper(s_name) AS red_name, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE lower(s_name) END AS blue_name"
    " FROM customer JOIN supplier ON s_suppkey = c_custkey % 10)"
)


@query(
    "WITH " + _ASKED + " SELECT bout_id, s_name AS red_name, CASE WHEN bout_id % 2 = 0 THEN blue_name ELSE s_name END AS blue_name,"
    " DATE '2002-01-01' AS bout_date, s_acctbal AS red_acctbal, CASE WHEN bout_id % 2 = 1 THEN s_acctbal END AS blue_acctbal,"
    " bout_id % 2 = 0 AS missing FROM asked JOIN supplier ON upper(s_name) = red_name"
)
def matchup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for customers, who have no profile, come back marked."""
    suppliers, key = table(spark, sf_dir, "supplier"), F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").join(suppliers, F.col("s_suppkey") == key % 10).select(
        key.alias("bout_id"), F.upper("s_name").alias("red_name"), F.when(key % 2 == 0, F.col("c_name")).otherwise(F.lower("s_name")).alias("blue_name")
    )
    known = suppliers.select(F.col("s_name").alias("entity"), F.col("s_acctbal").alias("acctbal"))
    return E.matchups(asked, known, NAMED, ON, unknown="keep")


# --------------------------------------------------------------------------- metrics on two fixed models


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(bouts(spark, sf_dir)).select(
        "bout_id",
        (F.col("winner") == "Red").cast("int").alias("target"),
        "prob_a",
        "prob_b",
        (F.col("prob_a") >= 0.5).cast("int").alias("prediction"),
    )
    return materialised(df)


_JUDGED = (
    "judged AS (SELECT bout_id, CASE WHEN winner = 'Red' THEN 1 ELSE 0 END AS target, prob_a, prob_b,"
    " CASE WHEN prob_a >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored)"
)
_J = (BOUTS_SQL, SCORED_SQL, _JUDGED)


def _auc_sql(score: str, source: str = "judged", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    keep = f"{by}, " if by else ""
    return (
        f"SELECT {keep}(sum(rk) FILTER (WHERE target = 1) - sum(target) * (sum(target) + 1) / 2.0e0)"
        " / (CAST(sum(target) AS DOUBLE) * sum(1 - target)) AS roc_auc FROM ("
        f"SELECT {keep}target, rank() OVER ({part}ORDER BY {score})"
        f" + (count(*) OVER (PARTITION BY {keep}{score}) - 1) / 2.0e0 AS rk FROM {source})" + (f" GROUP BY {by}" if by else "")
    )


@query(with_sql(f"SELECT {r6_sql('avg(CASE WHEN target = prediction THEN 1e0 ELSE 0e0 END)')} AS accuracy FROM judged", *_J))
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.accuracy(_judged(spark, sf_dir)))


@query(with_sql(f"SELECT {r6_sql('roc_auc')} AS roc_auc FROM ({_auc_sql('prob_a')})", *_J))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.roc_auc(_judged(spark, sf_dir), score="prob_a"))


@query(with_sql("SELECT target AS label, prediction AS predicted, count(*) AS n FROM judged GROUP BY 1, 2", *_J))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion_matrix(_judged(spark, sf_dir))


_REPORT = """per AS (SELECT k, sum(CASE WHEN target = k AND prediction = k THEN 1 ELSE 0 END)::DOUBLE AS tp,
  sum(CASE WHEN prediction = k THEN 1 ELSE 0 END)::DOUBLE AS pp, sum(CASE WHEN target = k THEN 1 ELSE 0 END)::DOUBLE AS s
 FROM judged, (VALUES (0), (1)) v(k) GROUP BY k),
prf AS (SELECT k, s, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(s, 0), 0) AS r,
  coalesce(2 * tp / nullif(pp + s, 0), 0) AS f, tp FROM per),
rep AS (SELECT CAST(k AS VARCHAR) AS class, p, r, f, s FROM prf
 UNION ALL SELECT 'accuracy', sum(tp) / sum(s), sum(tp) / sum(s), sum(tp) / sum(s), sum(s) FROM prf
 UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM prf
 UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM prf)"""


@query(
    with_sql(
        f"SELECT class, {r6_sql('p')} AS precision, {r6_sql('r')} AS recall, {r6_sql('f')} AS f1,"
        " CAST(s AS BIGINT) AS support FROM rep",
        *_J, _REPORT,
    )
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.classification_report(_judged(spark, sf_dir)))


_FOLDED = (
    f"folded AS (SELECT *, {_FOLD} AS fold FROM judged),\n"
    f"aucs AS ({_auc_sql('prob_a', 'folded', 'fold')})"
)


@query(
    with_sql(
        f"SELECT {r6_sql('avg(roc_auc)')} AS mean, {r6_sql('stddev_pop(roc_auc)')} AS std FROM aucs", *_J, _FOLDED
    )
)
def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = S.stratified_folds(_judged(spark, sf_dir))
    return rounded(M.score_spread(M.roc_auc(folds, score="prob_a", by=["fold"])))


@query(
    with_sql(
        f"SELECT {r6_sql('a.roc_auc')} AS champion_auc, {r6_sql('b.roc_auc')} AS challenger_auc,"
        f" b.roc_auc >= a.roc_auc AS promote FROM ({_auc_sql('prob_a')}) a, ({_auc_sql('prob_b')}) b",
        *_J,
    )
)
def champion_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.champion_decision(_judged(spark, sf_dir), champion="prob_a", challenger="prob_b"))


# --------------------------------------------------------------------------- ranking of fixed scores

_WINNER_SQL = "CASE WHEN prob_a >= 0.5 THEN 'Red' ELSE 'Blue' END"
_CONF_SQL = "greatest(prob_a, 1 - prob_a)"
_S = (BOUTS_SQL, SCORED_SQL)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.predictions(scored(bouts(spark, sf_dir)), LAYOUT, "prob_a", extra=["bout_id"])


@query(with_sql(f"SELECT bout_id, {_WINNER_SQL} AS predicted_winner FROM scored", *_S))
def predicted_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select("bout_id", "predicted_winner")


@query(with_sql(f"SELECT bout_id, {r6_sql(_CONF_SQL)} AS confidence FROM scored", *_S))
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_predictions(spark, sf_dir).select("bout_id", "confidence"))


@query(
    with_sql(
        f"SELECT bout_id, red_id, blue_id, prob_a AS prob_red_win, {_WINNER_SQL} AS predicted_winner,"
        f" {r6_sql(_CONF_SQL)} AS confidence FROM scored ORDER BY {_CONF_SQL} DESC, bout_id LIMIT 5",
        *_S,
    )
)
def top_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.by_confidence(_predictions(spark, sf_dir), "bout_id", R.TOP))


@query(
    with_sql(
        f"SELECT count(prob_a) AS n, {r6_sql('min(prob_a)')} AS min_prob, {r6_sql('max(prob_a)')} AS max_prob,"
        f" {r6_sql('avg(prob_a)')} AS mean_prob, {r6_sql('stddev_pop(prob_a)')} AS std_prob,"
        " count(*) FILTER (WHERE abs(prob_a - 0.5e0) < 0.1e0) AS near_half FROM scored",
        *_S,
    )
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.score_summary(scored(bouts(spark, sf_dir)), "prob_a"))


@query(
    with_sql(
        "SELECT bout_id, red_qty, blue_qty, prob_a, prob_a AS prob_f1_win,"
        " CASE WHEN prob_a >= 0.5 THEN 1 ELSE 0 END AS pred_f1_win FROM scored",
        *_S,
    )
)
def score_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.score_wide(scored(bouts(spark, sf_dir)).select("bout_id", "red_qty", "blue_qty", "prob_a"), "prob_a")
