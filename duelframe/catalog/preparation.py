"""Queries on sources, cleaning and pair algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from duelframe.catalog.fixtures import (
    BOUTS_SQL, DRAWN_SQL, GAPPY_SQL, LAYOUT, SCORED_SQL, UPCOMING_FROM, bouts, drawn, gappy, scored, table, upcoming,
)
from duelframe.catalog.registry import dated, query, r6_sql, rounded, with_sql
from duelframe.layout import Layout
from duelframe.operators import clean as C, entities as E, pairs as P, scoring as R
from duelframe.session import shared_folder
from duelframe.sources import load_or_build, read_csv, read_plain_csv, write_predictions

SIDED = ("qty", "disc", "tax", "flag")
COLUMNS = ["bout_id", "bout_date", "red_id", "blue_id", "winner", "red_qty", "blue_qty", "red_disc", "blue_disc",
           "red_tax", "blue_tax", "red_flag", "blue_flag", "grp"]
_ALL = ", ".join(COLUMNS).replace("bout_date", "CAST(bout_date AS DATE) AS bout_date")


# --------------------------------------------------------------------------- sources and sinks


@query(with_sql(f"SELECT {_ALL} FROM bouts", BOUTS_SQL))
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    dated(bouts(spark, sf_dir)).write.option("header", True).csv(path)
    df = read_plain_csv(spark, path, allow_empty=False)
    df = df.withColumns({n: F.col(n).cast("double") for n in COLUMNS if n.split("_")[-1] in ("qty", "disc", "tax")})
    return df.withColumn("bout_date", F.col("bout_date").cast("date"))


@query(
    "SELECT s_suppkey AS id, concat(s_name, ' Zoë Peña') AS name, s_acctbal AS balance FROM supplier"
    " UNION ALL SELECT c_custkey, concat(c_name, ' Zoë Peña'), c_acctbal FROM customer"
)
def csv_encoding_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder holds UTF-8 files, the other Latin-1 files; both are read in one call."""
    paths = []
    for name, p, charset in (("supplier", "s", "UTF-8"), ("customer", "c", "ISO-8859-1")):
        key = {"s": "s_suppkey", "c": "c_custkey"}[p]
        named = table(spark, sf_dir, name).select(
            F.col(key).alias("id"), F.concat(F.col(f"{p}_name"), F.lit(" Zoë Peña")).alias("name"),
            F.col(f"{p}_acctbal").alias("balance"),
        )
        paths.append(shared_folder(spark))
        named.write.option("header", True).option("encoding", charset).csv(paths[-1])
    return read_csv(spark, paths)


_PROFILE_SQL = "SELECT entity, {} FROM (SELECT red_id AS entity, red_qty AS qty, red_disc AS disc, red_tax AS tax FROM bouts" \
    " UNION ALL SELECT blue_id, blue_qty, blue_disc, blue_tax FROM bouts) {} GROUP BY entity"
_PROFILE_COLS = ", ".join(f"{r6_sql(f'avg({s})')} AS {s}" for s in ("disc", "qty", "tax"))


@query(with_sql(_PROFILE_SQL.format(_PROFILE_COLS, ""), BOUTS_SQL))
def profile_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    build = lambda: E.entity_profile(bouts(spark, sf_dir), LAYOUT)
    load_or_build(spark, path, build)
    return rounded(load_or_build(spark, path, build))


@query(
    with_sql(
        "SELECT bout_id, red_id, blue_id, prob_a AS prob_red_win, CASE WHEN prob_a >= 0.5 THEN 'Red' ELSE 'Blue' END"
        f" AS predicted_winner, {r6_sql('greatest(prob_a, 1 - prob_a)')} AS confidence FROM scored",
        BOUTS_SQL, SCORED_SQL,
    )
)
def prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    table_ = R.predictions(scored(bouts(spark, sf_dir)), LAYOUT, "prob_a", extra=["bout_id"])
    write_predictions(table_, path, key="bout_id")
    schema = "bout_id long, red_id long, blue_id long, prob_red_win double, predicted_winner string, confidence double"
    return rounded(read_plain_csv(spark, path, schema=StructType.fromDDL(schema)))


# --------------------------------------------------------------------------- cleaning


@query(
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS ts FROM events"
)
def coerce_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = table(spark, sf_dir, "events").select("event_id", text.alias("ts"))
    return C.coerce_dates(df, "ts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    with_sql(
        "SELECT bout_id, winner, CASE WHEN winner = 'Red' THEN 1 ELSE 0 END AS target FROM drawn"
        " WHERE winner IN ('Red', 'Blue')",
        BOUTS_SQL, DRAWN_SQL,
    )
)
def create_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.create_target(drawn(bouts(spark, sf_dir)), LAYOUT).select("bout_id", "winner", "target")


_GAPPY_COLUMNS = [*COLUMNS, "red_rare"]


@query(
    with_sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS column_name, {r6_sql(f'avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_ratio FROM gappy"
            for n in _GAPPY_COLUMNS
        ),
        BOUTS_SQL, GAPPY_SQL,
    )
)
def missing_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.missing_ratios(gappy(bouts(spark, sf_dir))))


_GAPPY_ALL = _ALL  # red_rare is dropped


@query(with_sql(f"SELECT {_GAPPY_ALL} FROM gappy", BOUTS_SQL, GAPPY_SQL))
def drop_high_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_high_missing(dated(gappy(bouts(spark, sf_dir))))


@query(
    with_sql(
        f"SELECT {_GAPPY_ALL}, CASE WHEN winner = 'Red' THEN 1 ELSE 0 END AS target FROM gappy"
        " WHERE winner IN ('Red', 'Blue')",
        BOUTS_SQL, GAPPY_SQL,
    )
)
def clean_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(C.clean(gappy(bouts(spark, sf_dir)), LAYOUT))


@query(
    with_sql(
        "SELECT bout_id, 900 AS TotalFightTimeSecs, grp AS Finish, '' AS FinishDetails, 3 AS FinishRound,"
        " '5:00' AS FinishRoundTime, FALSE AS EmptyArena FROM bouts",
        BOUTS_SQL,
    )
)
def default_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``Finish`` is present, so only the other defaults are added."""
    return C.with_defaults(bouts(spark, sf_dir).select("bout_id", F.col("grp").alias("Finish")))


@query(with_sql(f"SELECT {_GAPPY_ALL}, red_rare FROM gappy", BOUTS_SQL, GAPPY_SQL))
def drop_missing_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_high_missing(dated(gappy(bouts(spark, sf_dir))), keep=["red_rare"])


@query(
    with_sql(
        "SELECT CAST(NULL AS DOUBLE) AS reach, bout_id, CAST(red_qty AS DOUBLE) AS red_qty, grp,"
        " CAST(NULL AS VARCHAR) AS stance FROM bouts",
        BOUTS_SQL,
    )
)
def align_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = StructType(
        [
            StructField("reach", DoubleType()),
            StructField("bout_id", LongType()),
            StructField("red_qty", DoubleType()),
            StructField("grp", StringType()),
            StructField("stance", StringType()),
        ]
    )
    return C.align_schema(bouts(spark, sf_dir), trained)


@query(
    with_sql(
        f"SELECT {_GAPPY_ALL.replace('winner', 'CAST(NULL AS VARCHAR) AS winner')} FROM gappy"
        f" WHERE bout_date >= TIMESTAMP '{UPCOMING_FROM}'",
        BOUTS_SQL, GAPPY_SQL,
    )
)
def upcoming_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(C.clean(upcoming(gappy(bouts(spark, sf_dir))), LAYOUT, require_outcome=False))


# --------------------------------------------------------------------------- pair algebra

_DIFFS = ", ".join(f"{r6_sql(f'red_{b} - blue_{b}')} AS {b}_diff" for b in ("disc", "qty", "tax"))
_RAW = "red_disc, blue_disc, red_qty, blue_qty, red_tax, blue_tax"


@query(with_sql(f"SELECT bout_id, {_RAW}, {_DIFFS} FROM bouts", BOUTS_SQL))
def pair_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bouts(spark, sf_dir).select("bout_id", *_RAW.split(", "))
    return rounded(P.pair_diffs(df, LAYOUT), "disc_diff", "qty_diff", "tax_diff")


@query(
    with_sql(
        f"SELECT bout_id, {r6_sql('red_qty - blue_qty')} AS phys_reach_diff, {r6_sql('red_tax - blue_tax')} AS phys_age_diff"
        " FROM bouts",
        BOUTS_SQL,
    )
)
def physical_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact base names only: ``HeightCms`` has no physical difference."""
    df = bouts(spark, sf_dir).select(
        "bout_id",
        *[F.col(f"{p}_{old}").alias(f"{P_}{new}") for old, new in (("qty", "Reach"), ("tax", "Age"), ("disc", "HeightCms"))
          for p, P_ in (("red", "Red"), ("blue", "Blue"))],
    )
    return rounded(P.physical_diffs(df, Layout())).select("bout_id", "phys_reach_diff", "phys_age_diff")


@query(
    with_sql(
        f"SELECT bout_id, {r6_sql('red_disc / nullif(blue_disc, 0)')} AS strikes_lpm_ratio,"
        f" {r6_sql('red_tax / nullif(blue_tax, 0)')} AS td_success_ratio,"
        f" {r6_sql('(50 - red_qty) / nullif(50 - blue_qty, 0)')} AS striking_def_ratio FROM bouts",
        BOUTS_SQL,
    )
)
def safe_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = P.safe_ratios(bouts(spark, sf_dir), LAYOUT, strikes="disc", takedowns="tax", accuracy="qty", pct_scale=50)
    return rounded(df.select("bout_id", "strikes_lpm_ratio", "td_success_ratio", "striking_def_ratio"))


@query(
    with_sql(
        "SELECT bout_id, CASE WHEN red_qty < 14 OR blue_qty < 14 THEN 1 ELSE 0 END AS short_notice_flag FROM bouts",
        BOUTS_SQL,
    )
)
def short_notice_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.short_notice_flag(bouts(spark, sf_dir), LAYOUT, base="qty").select("bout_id", "short_notice_flag")


@query(
    with_sql(
        "SELECT bout_id, CASE WHEN red_disc > 0 THEN red_qty * 50 END AS altitude_diff,"
        " CASE WHEN red_disc > 0 AND red_qty * 50 >= 1500 THEN 1 ELSE 0 END AS high_altitude_flag FROM bouts",
        BOUTS_SQL,
    )
)
def altitude_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    altitude = F.when(F.col("red_disc") > 0, F.col("red_qty") * 50)
    df = bouts(spark, sf_dir).select("bout_id", altitude.alias("EventAltitude"))
    return P.altitude_features(df).select("bout_id", "altitude_diff", "high_altitude_flag")


@query(with_sql(f"SELECT bout_id, red_flag, blue_flag, {_DIFFS} FROM bouts", BOUTS_SQL))
def pair_diffs_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bouts(spark, sf_dir).select("bout_id", "red_flag", "blue_flag", *_RAW.split(", "))
    return rounded(P.pair_diffs(df, LAYOUT, drop_original=True))


@query(
    with_sql(
        "SELECT bout_id, red_big, blue_big, red_age, blue_age, red_age - blue_age AS age_diff FROM"
        " (SELECT bout_id, red_qty > 25 AS red_big, blue_qty > 25 AS blue_big, CAST(red_qty AS BIGINT) AS red_age,"
        " CAST(blue_qty AS BIGINT) AS blue_age FROM bouts)",
        BOUTS_SQL,
    )
)
def pair_diffs_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric pairs only: the boolean pair gets no difference."""
    df = bouts(spark, sf_dir).select(
        "bout_id",
        *[(F.col(f"{p}_qty") > 25).alias(f"{p}_big") for p in ("red", "blue")],
        *[F.col(f"{p}_qty").cast("long").alias(f"{p}_age") for p in ("red", "blue")],
    )
    return P.pair_diffs(df, LAYOUT, numeric_only=True)


@query(
    with_sql(
        f"SELECT bout_id, {r6_sql('blue_qty - red_qty')} AS ReachDif, {r6_sql('blue_tax - red_tax')} AS AvgTDDif FROM bouts",
        BOUTS_SQL,
    )
)
def named_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = P.named_diffs(bouts(spark, sf_dir), LAYOUT, {"ReachDif": "qty", "AvgTDDif": "tax", "AgeDif": "age"})
    return rounded(df.select("bout_id", "ReachDif", "AvgTDDif"))


# --------------------------------------------------------------------------- nothing is lost on the way in

_ODD_DATE = """CASE bout_id % 4 WHEN 0 THEN strftime(bout_date, '%Y-%m-%d') WHEN 1 THEN strftime(bout_date, '%-m/%-d/%Y')
 WHEN 2 THEN strftime(bout_date, '%B %-d, %Y') ELSE 'unknown' END"""


def _odd_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, kind = F.col("bout_date"), F.col("bout_id") % 4
    text = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(day, "M/d/yyyy"))
        .when(kind == 2, F.date_format(day, "MMMM d, yyyy"))
        .otherwise("unknown")
    )
    return bouts(spark, sf_dir).withColumn("bout_date", text)


@query(
    with_sql(
        "SELECT bout_id, CASE WHEN bout_id % 4 < 3 THEN CAST(bout_date AS DATE) END AS bout_date,"
        " CASE WHEN winner = 'Red' THEN 1 ELSE 0 END AS target FROM bouts WHERE winner IN ('Red', 'Blue')",
        BOUTS_SQL,
    )
)
def clean_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(C.clean(_odd_dates(spark, sf_dir), LAYOUT).select("bout_id", "bout_date", "target"))


@query(with_sql("SELECT count(*) AS n_dates, count(*) FILTER (WHERE bout_id % 4 = 3) AS n_unparsed FROM bouts", BOUTS_SQL))
def unparsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unparsed_dates(_odd_dates(spark, sf_dir), "bout_date")


def _repeating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose part and supplier are missing now and then."""
    return table(spark, sf_dir, "lineitem").withColumns(
        {n: F.when(F.col(n) % k > 0, F.col(n)) for n, k in (("l_partkey", 10), ("l_suppkey", 3))}
    )


@query(
    "SELECT count(*) AS n_rows, count(*) AS n_keys, (SELECT sum(n) FROM (SELECT count(*) AS n FROM lineitem"
    " GROUP BY CASE WHEN l_partkey % 10 > 0 THEN l_partkey END, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END, l_shipdate"
    " HAVING count(*) > 1))::BIGINT AS n_numbered FROM lineitem"
)
def bout_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of lines whose identifying columns are partly null and repeat."""
    keyed = C.with_bout_key(_repeating(spark, sf_dir), LAYOUT, ["l_partkey", "l_suppkey", "l_shipdate"])
    key = F.col(LAYOUT.key)
    return keyed.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.count_if(key.contains("-")).alias("n_numbered")
    )


@query(
    "WITH l AS (SELECT *, CASE WHEN l_partkey % 10 > 0 THEN l_partkey END AS p, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END AS s FROM lineitem),"
    " t AS (SELECT count(*) OVER (PARTITION BY p, s, l_shipdate) AS n FROM l)"
    " SELECT count(*) AS n_rows, count(*) AS n_same, count(*) FILTER (WHERE n > 1) AS n_numbered FROM t"
)
def bout_keys_repartitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with repeated bouts, keyed under two partitionings: ``n_same`` of them get the same key both times."""
    keyed = [C.with_bout_key(df, LAYOUT, ["l_partkey", "l_suppkey", "l_shipdate"]) for df in (_repeating(spark, sf_dir), _repeating(spark, sf_dir).repartition("l_orderkey"))]
    rows = [k.select(F.col(LAYOUT.key).alias("key"), F.md5(F.to_json(F.struct("*"))).alias("line")) for k in keyed]
    both = rows[0].join(rows[1].withColumnRenamed("line", "again"), "key", "full")
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("line") == F.col("again")).alias("n_same"), F.count_if(F.col("key").contains("-")).alias("n_numbered")
    )


@query(
    "SELECT s_suppkey AS id, CASE s_suppkey % 2 WHEN 0 THEN concat(s_suppkey, 'D') ELSE concat(s_suppkey, 'f') END AS code,"
    " s_acctbal AS balance FROM supplier"
)
def csv_number_like_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes such as 5D and 7f stay text."""
    key = F.col("s_suppkey")
    code = F.concat(key.cast("string"), F.when(key % 2 == 0, "D").otherwise("f"))
    path = shared_folder(spark)
    table(spark, sf_dir, "supplier").select(key.alias("id"), code.alias("code"), F.col("s_acctbal").alias("balance")).write.option("header", True).csv(path)
    return read_csv(spark, path)
