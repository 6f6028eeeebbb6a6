"""Queries that compare models, profile drift and check data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelframe.catalog.fixtures import (
    BOUTS_SQL, DRAWN_SQL, GAPPY_SQL, LAYOUT, NAMED, NAMED_SQL, PAIRS_SQL, SCORED_SQL, STATS, UPCOMING_FROM, bouts, drawn, gappy,
    named_bouts, past, scored, table, upcoming,
)
from duelframe.catalog.histories import MOMENTUM, MOMENTUM_SQL, long_sql, paired_sql
from duelframe.catalog.registry import dated, query, r6_sql, rounded, with_sql
from duelframe.operators import clean as C, compare as A, drift as D, quality as V, scoring as R
from duelframe.plans import compare_files, engineer
from duelframe.session import shared_folder
from duelframe.sources import write_predictions

# --------------------------------------------------------------------------- two models side by side

_KEYS = ["bout_id", "red_id", "blue_id"]
_MODEL = "SELECT bout_id, red_id, blue_id, {p} AS prob_red_win, CASE WHEN {p} >= 0.5 THEN 'Red' ELSE 'Blue' END AS" \
    " predicted_winner, greatest({p}, 1 - {p}) AS confidence FROM scored"
_COMPARED = (
    BOUTS_SQL,
    SCORED_SQL,
    f"a AS ({_MODEL.format(p='prob_a')})",
    f"b AS ({_MODEL.format(p='prob_b')})",
    "cmp AS (SELECT a.bout_id, a.red_id, a.blue_id, a.prob_red_win AS prob_red_win_logreg, b.prob_red_win AS prob_red_win_gbdt,"
    " a.predicted_winner AS predicted_winner_logreg, b.predicted_winner AS predicted_winner_gbdt,"
    " a.confidence AS confidence_logreg, b.confidence AS confidence_gbdt,"
    " a.predicted_winner = b.predicted_winner AS agree, abs(a.prob_red_win - b.prob_red_win) AS prob_diff"
    " FROM a JOIN b USING (bout_id, red_id, blue_id))",
)
_CMP_COLUMNS = (
    "bout_id, red_id, blue_id, prob_red_win_logreg, prob_red_win_gbdt, predicted_winner_logreg, predicted_winner_gbdt, "
    f"{r6_sql('confidence_logreg')} AS confidence_logreg, {r6_sql('confidence_gbdt')} AS confidence_gbdt"
)


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = scored(bouts(spark, sf_dir))
    return tuple(R.predictions(df, LAYOUT, p, extra=["bout_id"]) for p in ("prob_a", "prob_b"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_agreement(A.compare_join(*_models(spark, sf_dir), on=_KEYS))


@query(with_sql(f"SELECT {_CMP_COLUMNS} FROM cmp", *_COMPARED))
def compare_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.compare_join(*_models(spark, sf_dir), on=_KEYS))


@query(
    with_sql(
        "SELECT count(*) AS total, count(*) FILTER (WHERE agree) AS agreements, count(*) FILTER (WHERE NOT agree)"
        f" AS disagreements, {r6_sql('avg(CASE WHEN agree THEN 1e0 ELSE 0e0 END)')} AS rate FROM cmp",
        *_COMPARED,
    )
)
def agreement_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from two prediction files."""
    paths = [shared_folder(spark) for _ in "ab"]
    for df, path in zip(_models(spark, sf_dir), paths):
        write_predictions(df, path, key="bout_id")
    return rounded(compare_files(spark, *paths, on=_KEYS).agreement)


@query(
    with_sql(
        "SELECT count(*) AS total, count(*) FILTER (WHERE agree) AS agreements, count(*) FILTER (WHERE NOT agree)"
        f" AS disagreements, {r6_sql('avg(CASE WHEN agree THEN 1e0 ELSE 0e0 END)')} AS rate FROM cmp",
        *_COMPARED,
    )
)
def agreement_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.agreement_rate(_compared(spark, sf_dir)))


@query(
    with_sql(
        f"SELECT bout_id, red_id, blue_id, {r6_sql('prob_diff')} AS prob_diff FROM cmp"
        " ORDER BY cmp.prob_diff DESC, bout_id LIMIT 10",
        *_COMPARED,
    )
)
def top_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = A.top_disagreements(_compared(spark, sf_dir), "bout_id", 10)
    return rounded(top.select(*_KEYS, "prob_diff"))


@query(
    with_sql(
        f"SELECT count(*) AS total, count(*) FILTER (WHERE agree) AS agreements, {r6_sql('avg(confidence_logreg)')} AS"
        f" mean_confidence_logreg, {r6_sql('avg(confidence_gbdt)')} AS mean_confidence_gbdt FROM cmp",
        *_COMPARED,
    )
)
def model_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.model_kpis(_compared(spark, sf_dir)))


_TALL = "(SELECT 'logreg' AS model, confidence_logreg AS c FROM cmp UNION ALL SELECT 'gbdt', confidence_gbdt FROM cmp)"


@query(
    with_sql(
        f"SELECT model, CAST(least(floor((c - 0.5e0) / 0.025e0), 19) AS INTEGER) AS bin, count(*) AS n FROM {_TALL} GROUP BY 1, 2",
        *_COMPARED,
    )
)
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confidence_histogram(_compared(spark, sf_dir))


@query(
    with_sql(
        "SELECT model, CASE WHEN c > 0.7e0 THEN 'high' WHEN c > 0.55e0 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n"
        f" FROM {_TALL} GROUP BY 1, 2",
        *_COMPARED,
    )
)
def confidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tier_counts(_compared(spark, sf_dir))


@query(
    with_sql(
        "SELECT cmp.bout_id, cmp.prob_red_win_logreg, g.grp, CAST(g.bout_date AS DATE) AS bout_date FROM cmp"
        " LEFT JOIN (SELECT * FROM bouts WHERE red_disc > 0) g ON g.bout_id = cmp.bout_id",
        *_COMPARED,
    )
)
def enrich_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details are known for some bouts only."""
    details = bouts(spark, sf_dir).filter(F.col("red_disc") > 0)
    rich = A.enrich(_compared(spark, sf_dir), details, ["bout_id"], ["grp", "bout_date"])
    return dated(rich.select("bout_id", "prob_red_win_logreg", "grp", "bout_date"))


_LABEL = "concat(red_name, ' vs ', blue_name)"


@query(
    with_sql(
        f"SELECT bout_id, CASE WHEN length({_LABEL}) > 34 THEN concat(substr({_LABEL}, 1, 31), '...') ELSE {_LABEL} END AS bout"
        " FROM named",
        BOUTS_SQL, NAMED_SQL,
    )
)
def bout_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_label(named_bouts(spark, sf_dir), NAMED).select("bout_id", "bout")


@query(
    with_sql(
        f"SELECT bout_id, agree, {r6_sql('confidence_gbdt')} AS confidence_gbdt FROM cmp WHERE NOT agree"
        " ORDER BY cmp.confidence_gbdt DESC, bout_id",
        *_COMPARED,
    )
)
def compare_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = A.sorted_by_confidence(_compared(spark, sf_dir), "_gbdt", "bout_id", agree=False)
    return rounded(ordered.select("bout_id", "agree", "confidence_gbdt"))


# --------------------------------------------------------------------------- train against upcoming

_UP = f"bout_date >= TIMESTAMP '{UPCOMING_FROM}'"
_TEXT = ("winner", "red_flag", "blue_flag", "grp")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = gappy(bouts(spark, sf_dir))
    return past(df), upcoming(df)


@query(
    with_sql(
        " UNION ALL ".join(
            f"SELECT '{d}' AS dataset, '{n}' AS column_name, count(DISTINCT {n if (d, n) != ('upcoming', 'winner') else 'CAST(NULL AS VARCHAR)'})"
            f" AS n_distinct FROM gappy WHERE {w}"
            for d, w in (("train", f"NOT {_UP}"), ("upcoming", _UP))
            for n in _TEXT
        ),
        BOUTS_SQL, GAPPY_SQL,
    )
)
def categorical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, later = _halves(spark, sf_dir)
    return D.categorical_profile({"train": train, "upcoming": later})


def _values_sql(where: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, {e} AS value, count(*) AS n FROM gappy WHERE {where} AND {e} IS NOT NULL GROUP BY 2"
        for n, e in columns
    )


@query(
    with_sql(
        "SELECT column_name, value, coalesce(t.n, 0) AS n_train, coalesce(u.n, 0) AS n_upcoming,"
        " CASE WHEN u.n IS NULL THEN 'only_train' WHEN t.n IS NULL THEN 'only_upcoming' ELSE 'both' END AS found FROM"
        f" ({_values_sql(f'NOT {_UP}', [(n, n) for n in _TEXT])}) t FULL JOIN"
        f" ({_values_sql(_UP, [(n, n) for n in _TEXT if n != 'winner'])}) u USING (column_name, value)",
        BOUTS_SQL, GAPPY_SQL,
    )
)
def category_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.category_drift(*_halves(spark, sf_dir), _TEXT)


def _sparse_sql(columns, flag: str = ">=") -> str:
    """Number of columns whose share of nulls reaches the threshold (or, with ``<``, stays below it)."""
    return " + ".join(f"CASE WHEN avg(CASE WHEN {n} IS NULL THEN 1e0 ELSE 0e0 END) {flag} 0.7e0 THEN 1 ELSE 0 END" for n in columns)


_WIDTH = "(SELECT count(*) FROM (DESCRIBE SELECT * FROM {t}))"
_GAPPY_COLUMNS = (
    "bout_id", "bout_date", "red_id", "blue_id", "winner", "red_rare", "grp", *[f"{p}_{n}" for n in (*STATS, "flag") for p in ("red", "blue")],
)
_SHAPED = (
    BOUTS_SQL, GAPPY_SQL,
    "cleaned AS (SELECT *, 1 AS target FROM gappy WHERE winner IN ('Red', 'Blue'))",
    long_sql("cleaned", []), MOMENTUM_SQL,
    "featured AS (SELECT cleaned.*, red_qty - blue_qty AS qty_diff, red_disc - blue_disc AS disc_diff, red_tax - blue_tax AS tax_diff, p.* EXCLUDE (bout_id)"
    f" FROM cleaned JOIN ({paired_sql('mom', MOMENTUM, True)}) p USING (bout_id))",
)


@query(
    with_sql(
        f"SELECT 'raw' AS stage, count(*) AS n_rows, {_WIDTH.format(t='gappy')} AS n_columns FROM gappy UNION ALL"
        f" SELECT 'clean', count(*), {_WIDTH.format(t='cleaned')} - ({_sparse_sql(_GAPPY_COLUMNS)}) FROM cleaned UNION ALL"
        f" SELECT 'engineered', count(*), {_WIDTH.format(t='featured')} - ({_sparse_sql(_GAPPY_COLUMNS)}) FROM featured",
        *_SHAPED,
    )
)
def stage_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = gappy(bouts(spark, sf_dir))
    clean = C.clean(raw, LAYOUT)
    table_, _ = engineer(clean, LAYOUT, "simple", stats=STATS)
    return D.stage_shapes({"raw": raw, "clean": clean, "engineered": table_})


# --------------------------------------------------------------------------- data quality


def _rule_sql(name: str, checked: str, bad: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {checked}) AS checked,"
        f" count(*) FILTER (WHERE {checked} AND {bad}) AS violations FROM {source}"
    )


def _union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


_DUPLICATES = (
    "SELECT 'duplicates' AS rule, CAST(sum(n) AS BIGINT) AS checked, CAST(sum(n - 1) AS BIGINT) AS violations FROM"
    " (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"
)


@query(_DUPLICATES)
def dq_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_DOMAIN = _rule_sql("domain:winner", "TRUE", "coalesce(winner NOT IN ('Red', 'Blue'), TRUE)", "drawn")


@query(with_sql(_DOMAIN, BOUTS_SQL, DRAWN_SQL))
def dq_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_rows(drawn(bouts(spark, sf_dir)), [V.domain("winner", ["Red", "Blue"])])


@query(
    _union(
        _rule_sql("non_blank:name", "TRUE", "(name IS NULL OR trim(name) = '')", "(SELECT CASE WHEN c_acctbal < 0 THEN '  '"
                  " WHEN c_acctbal < 1000 THEN NULL ELSE c_name END AS name FROM customer)"),
        _rule_sql("non_blank:c_name", "TRUE", "(c_name IS NULL OR trim(c_name) = '')", "customer"),
    )
)
def dq_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names blanked where the balance is low, next to the names as they are."""
    balance = F.col("c_acctbal")
    name = F.when(balance < 0, "  ").when(balance >= 1000, F.col("c_name"))
    df = table(spark, sf_dir, "customer").withColumn("name", name)
    return V.check_rows(df, [V.non_blank("name"), V.non_blank("c_name")])


@query(with_sql(_rule_sql("sides_differ", "TRUE", "red_id = blue_id", "pairs"), PAIRS_SQL))
def dq_same_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of lines, some of which have the same supplier on both sides."""
    return V.check_rows(bouts(spark, sf_dir, same=True), [V.sides_differ(LAYOUT)])


def _missing_sql(source: str, columns) -> str:
    return f"SELECT 'missing_values' AS rule, {len(columns)}::BIGINT AS checked, CAST({_sparse_sql(columns)} AS BIGINT) AS violations FROM {source}"


_DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic", "late")
_DOCS = (
    "(SELECT d.*, l.quality, l.toxic, CASE WHEN l.toxic = 1 THEN 1 END AS late FROM documents d LEFT JOIN labels l USING (doc_id))"
)


@query(
    _union(
        _missing_sql(_DOCS, _DOC_COLUMNS),
        f"SELECT 'missing_values', ({_sparse_sql(_DOC_COLUMNS, '<')})::BIGINT, {len(_DOC_COLUMNS)} - ({_sparse_sql(_DOC_COLUMNS, '<')}) - ({_sparse_sql(_DOC_COLUMNS)}) FROM {_DOCS}",
    )
)
def dq_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after dropping sparse columns."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    docs = docs.withColumn("late", F.when(F.col("toxic") == 1, 1))
    return V.missing_values(docs).unionByName(V.missing_values(C.drop_high_missing(docs)))


_RANGE_SOURCE = (
    "(SELECT nullif(red_qty, 20) AS red_age, blue_qty AS blue_age, red_qty * 8 AS red_weight, red_disc * 1000 + 140 AS red_height"
    " FROM bouts)"
)


@query(
    with_sql(
        _union(
            _rule_sql("range:red_age", "red_age IS NOT NULL", "red_age NOT BETWEEN 18 AND 60", _RANGE_SOURCE),
            _rule_sql("range:blue_age", "blue_age IS NOT NULL", "blue_age NOT BETWEEN 18 AND 60", _RANGE_SOURCE),
            _rule_sql("range:red_height", "red_height IS NOT NULL", "red_height NOT BETWEEN 150 AND 220", _RANGE_SOURCE),
            _rule_sql("range:red_weight", "red_weight IS NOT NULL", "red_weight NOT BETWEEN 100 AND 350", _RANGE_SOURCE),
        ),
        BOUTS_SQL,
    )
)
def dq_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bouts(spark, sf_dir).select(
        F.nullif(F.col("red_qty"), F.lit(20.0)).alias("red_age"),
        F.col("blue_qty").alias("blue_age"),
        (F.col("red_qty") * 8).alias("red_weight"),
        (F.col("red_disc") * 1000 + 140).alias("red_height"),
    )
    ranges = {base.lower(): limits for base, limits in V.PLAUSIBLE_RANGES.items()}
    return V.check_rows(df, V.plausible_ranges(df, LAYOUT, ranges))


@query(
    with_sql(
        "SELECT 'required_columns' AS rule, 4::BIGINT AS checked, 1::BIGINT AS violations UNION ALL"
        " SELECT 'numeric_columns', 3, 1 UNION ALL SELECT 'text_columns', 2, 0 UNION ALL"
        " SELECT 'some_date:bout_date', count(*), CASE WHEN count(bout_date) = 0 THEN 1 ELSE 0 END FROM bouts",
        BOUTS_SQL,
    )
)
def dq_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``weight_class`` is absent and ``grp`` is no number."""
    df = bouts(spark, sf_dir)
    kinds = V.column_types(
        df,
        required=["red_id", "blue_id", "winner", "weight_class"],
        numeric=["red_qty", "blue_qty", "grp"],
        text=["winner", "grp"],
    )
    return kinds.unionByName(V.some_date(df, "bout_date"))


_TARGET = "(SELECT CASE WHEN winner = 'Red' THEN 1 WHEN winner = 'Blue' THEN 0 WHEN red_qty > 25 THEN 2 END AS target FROM drawn)"
_BAD_TARGET = _rule_sql("binary:target", "TRUE", "coalesce(target NOT IN (0, 1), TRUE)", _TARGET)


@query(with_sql(_BAD_TARGET, BOUTS_SQL, DRAWN_SQL))
def dq_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw leaves 2 or nothing where a label should be."""
    winner = F.col("winner")
    label = F.when(winner == "Red", 1).when(winner == "Blue", 0).when(F.col("red_qty") > 25, 2)
    return V.check_rows(drawn(bouts(spark, sf_dir)).withColumn("target", label), [V.binary_target()])


_ENGINEERED = (BOUTS_SQL, DRAWN_SQL, long_sql("drawn"), MOMENTUM_SQL,
               f"eng AS (SELECT d.*, p.* EXCLUDE (bout_id), red_win_streak - CASE WHEN red_qty < 10 THEN 2 ELSE 0 END AS streak,"
               f" red_last3_win_rate + red_disc AS rate, red_qty - blue_qty + CASE WHEN red_qty < 5 THEN 1 ELSE 0 END AS qty_diff FROM drawn d JOIN ({paired_sql('mom', MOMENTUM, True)}) p USING (bout_id))")


@query(
    with_sql(
        _union(
            _rule_sql("at_least:red_win_streak", "streak IS NOT NULL", "streak < 0", "eng"),
            _rule_sql("at_least:blue_win_streak", "blue_win_streak IS NOT NULL", "blue_win_streak < 0", "eng"),
            _rule_sql("range:red_last3_win_rate", "rate IS NOT NULL", "rate NOT BETWEEN 0 AND 1", "eng"),
            _rule_sql("range:blue_last3_win_rate", "TRUE", "blue_last3_win_rate NOT BETWEEN 0 AND 1", "eng"),
            _rule_sql("difference:qty", "TRUE", "abs(qty_diff - (red_qty - blue_qty)) > 1e-9", "eng"),
            "SELECT 'rows_preserved', (SELECT count(*) FROM drawn), abs(count(*) - (SELECT count(*) FROM drawn)) FROM eng",
        ),
        *_ENGINEERED,
    )
)
def dq_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = drawn(bouts(spark, sf_dir))
    after, _ = engineer(before, LAYOUT, "simple", stats=STATS)
    # Damaged on purpose, so that three rules have something to find.
    after = after.withColumns(
        {
            "red_win_streak": F.col("red_win_streak") - F.when(F.col("red_qty") < 10, 2).otherwise(0),
            "red_last3_win_rate": F.col("red_last3_win_rate") + F.col("red_disc"),
            "qty_diff": F.col("qty_diff") + F.when(F.col("red_qty") < 5, 1).otherwise(0),
        }
    )
    rules = [
        V.at_least("red_win_streak", 0),
        V.at_least("blue_win_streak", 0),
        V.in_range("red_last3_win_rate", 0, 1),
        V.in_range("blue_last3_win_rate", 0, 1),
        V.difference_holds(LAYOUT, "qty"),
    ]
    return V.quality_report(after, rules, [V.rows_preserved(before, after)])


_RATIO = "(SELECT CASE WHEN blue_disc = 0 THEN CASE WHEN red_disc > 0 THEN 'Infinity'::DOUBLE END ELSE red_disc / blue_disc END AS ratio, red_qty FROM bouts)"


@query(
    with_sql(
        _union(
            _rule_sql("finite:ratio", "ratio IS NOT NULL", "isinf(ratio)", _RATIO),
            _rule_sql("finite:red_qty", "red_qty IS NOT NULL", "isinf(red_qty)", _RATIO),
        ),
        BOUTS_SQL,
    )
)
def dq_infinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ratio that did not guard its denominator."""
    red, blue = F.col("red_disc"), F.col("blue_disc")
    careless = F.when(blue == 0, F.when(red > 0, F.lit(float("inf")))).otherwise(red / F.nullif(blue, F.lit(0.0)))
    df = bouts(spark, sf_dir).select(careless.alias("ratio"), "red_qty")
    return V.check_rows(df, V.finite(df))


_PROBS = "(SELECT prob_a AS p, CASE WHEN red_qty > 45 THEN 1.25e0 - prob_a ELSE 1 - prob_a END AS q FROM scored)"


@query(
    with_sql(
        _union(
            _rule_sql("range:p", "p IS NOT NULL", "p NOT BETWEEN 0 AND 1", _PROBS),
            _rule_sql("range:q", "q IS NOT NULL", "q NOT BETWEEN 0 AND 1", _PROBS),
            _rule_sql("sums_to_one", "TRUE", "abs(p + q - 1) > 1e-9", _PROBS),
        ),
        BOUTS_SQL, SCORED_SQL,
    )
)
def dq_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second probability is off for large quantities."""
    p = F.col("prob_a")
    q = F.when(F.col("red_qty") > 45, 1.25 - p).otherwise(1 - p)
    df = scored(bouts(spark, sf_dir)).select(p.alias("p"), q.alias("q"))
    return V.check_rows(df, V.probabilities("p", "q"))


@query(
    with_sql(
        _union(
            _DOMAIN,
            _rule_sql("sides_differ", "TRUE", "red_id = blue_id", "drawn"),
            _rule_sql("range:red_qty", "TRUE", "red_qty NOT BETWEEN 5 AND 45", "drawn"),
            "SELECT 'duplicates', count(*), count(*) - count(DISTINCT bout_id) FROM drawn",
            "SELECT 'some_date:bout_date', count(*), 0 FROM drawn",
        ),
        BOUTS_SQL, DRAWN_SQL,
    )
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = drawn(bouts(spark, sf_dir))
    rules = [V.domain("winner", ["Red", "Blue"]), V.sides_differ(LAYOUT), V.in_range("red_qty", 5, 45)]
    return V.quality_report(df, rules, [V.duplicates(df, ["bout_id"]), V.some_date(df, "bout_date")])


@query(
        "SELECT (SELECT count(*) FROM (DESCRIBE labels)) + (SELECT count(*) FROM (DESCRIBE documents)) - 1 AS n_train,"
        " (SELECT count(*) FROM (DESCRIBE documents)) AS n_upcoming, (SELECT count(*) FROM (DESCRIBE labels)) - 1 AS n_missing,"
        f" {r6_sql('((SELECT count(*) FROM (DESCRIBE labels)) - 1) / ((SELECT count(*) FROM (DESCRIBE labels)) + (SELECT count(*) FROM (DESCRIBE documents)) - 1.0e0)')}"
        " AS share_missing, (SELECT count(*) FROM documents) AS n_rows"
)
def feature_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels are what a model is trained on, documents alone what is scored."""
    upcoming = table(spark, sf_dir, "documents")
    train = upcoming.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    gap = D.feature_gap(train.columns, upcoming.columns)
    values = {n: F.lit(v) if n == "share_missing" else F.lit(v).cast("long") for n, v in gap.items()}
    return rounded(upcoming.agg(F.count(F.lit(1)).alias("n_rows")).withColumns(values))
