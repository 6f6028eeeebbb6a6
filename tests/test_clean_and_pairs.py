import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from duelframe.operators import clean as C, pairs as P
from duelframe.plans import engineer


def test_bad_date_is_null(spark):
    df = spark.createDataFrame([("2020-01-01",), ("invalid-date",), ("2020-02-01",), ("03/04/2021",)], "Date string")
    got = [r["Date"] for r in C.coerce_dates(df, formats=["MM/dd/yyyy"]).collect()]
    assert got == [dt.datetime(2020, 1, 1), None, dt.datetime(2020, 2, 1), dt.datetime(2021, 3, 4)]
    assert C.coerce_dates(df.withColumnRenamed("Date", "Other")).columns == ["Other"]


def test_only_decided_bouts_get_a_target(spark):
    df = spark.createDataFrame([(w,) for w in ["Red", "Blue", "Draw", "No Contest", "Red", None]], "Winner string")
    assert [r["target"] for r in C.create_target(df).collect()] == [1, 0, 1]
    with pytest.raises(ValueError):
        C.create_target(df.withColumnRenamed("Winner", "Other"))


@pytest.mark.parametrize("threshold,kept", [(0.5, "ab"), (0.7, "abc"), (0.9, "abc"), (1.0, "abc")])
def test_missing_thresholds(spark, threshold, kept):
    rows = [(1, 1, 1, None), (2, None, None, None), (3, 3, None, None)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    assert C.drop_high_missing(df, threshold).columns == list(kept)


def test_share_at_the_threshold_is_dropped_and_empty_tables_lose_all(spark):
    df = spark.createDataFrame([(1, None), (2, 1)], "a int, b int")
    assert C.drop_high_missing(df, 0.5).columns == ["a"]
    assert C.drop_high_missing(df, 0.5, keep=["b"]).columns == ["a", "b"]
    assert C.drop_high_missing(df.limit(0)).columns == []


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int")
    assert C.nan_to_null(df).agg(F.avg("x")).first()[0] == 2.0


def test_defaults_only_for_absent_columns(spark):
    df = C.with_defaults(spark.createDataFrame([(None,)], "Finish string"))
    row = df.first()
    assert row["Finish"] is None and row["TotalFightTimeSecs"] == 900 and row["EmptyArena"] is False


def test_align_schema(spark):
    schema = StructType([StructField("b", DoubleType()), StructField("z", StringType()), StructField("a", LongType())])
    df = C.align_schema(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), schema)
    assert df.columns == ["b", "z", "a"] and tuple(df.first()) == (2.0, None, 1)
    with pytest.raises(ValueError):
        C.check_width(3, 4)


def test_upcoming_bouts_keep_all_rows(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "A", "B", None, 3.0)] * 2,
                               "bout_id long, Date string, RedFighter string, BlueFighter string, Winner string, RedX double")
    out = C.clean(df, require_outcome=False)
    assert out.count() == 2 and "target" not in out.columns and "Winner" in out.columns


def test_bout_key_is_stable(spark):
    df = spark.createDataFrame([("2020-01-01", "A", "B"), ("2020-01-01", "C", "B")], "Date string, RedFighter string, BlueFighter string")
    first, again = ({r["RedFighter"]: r["bout_id"] for r in C.with_bout_key(df).collect()} for _ in range(2))
    assert first == again and len(set(first.values())) == 2


@pytest.mark.parametrize("broadcast_rows", [0, 100])
def test_keys_of_repeats_do_not_follow_the_partitioning(spark, broadcast_rows):
    rows = [("2020-01-01", "A", "B", i % 3, None if i % 2 else "x") for i in range(40)] + [(f"2020-02-{i:02d}", "A", "B", 0, None) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "Date string, RedFighter string, BlueFighter string, n int, note string")
    found = []
    for parts in (1, 3, 7):
        keyed = C.with_bout_key(df.repartition(parts), broadcast_rows=broadcast_rows)
        assert keyed.columns == [*df.columns, "bout_id"]
        found.append(sorted(map(str, keyed.collect())))
    assert found[0] == found[1] == found[2]
    keys = {(r["n"], r["note"]): r["bout_id"] for r in keyed.where("Date = '2020-01-01'").collect()}
    assert len({r["bout_id"] for r in keyed.collect()}) == 48 and len({k.rsplit("-", 1)[0] for k in keys.values()}) == 6
    once = {r["Date"]: r["bout_id"] for r in keyed.where("Date > '2020-01-01'").collect()}
    alone = {r["Date"]: r["bout_id"] for r in C.with_bout_key(df.where("Date > '2020-01-01'").withColumn("n", F.lit(5))).collect()}
    assert once == alone, "the key of a bout that occurs once does not depend on its other columns"


def test_bout_keys_of_an_empty_table(spark):
    df = spark.createDataFrame([], "Date string, RedFighter string, BlueFighter string, bout_id string")
    assert C.with_bout_key(df).collect() == []


def test_bout_keys_keep_nulls_and_repeats_apart(spark):
    rows = [("2020-01-01", "A", None), ("2020-01-01", None, "A"), ("2020-01-01", "A", "B"), ("2020-01-01", "A", "B"), ("2020-01-01", "A,1:B", None)]
    df = spark.createDataFrame(rows, "Date string, RedFighter string, BlueFighter string")
    keys = [r["bout_id"] for r in C.with_bout_key(df).collect()]
    assert len(set(keys)) == 5 and sum("-" in k for k in keys) == 2


def test_clean_reads_other_date_formats(spark):
    df = spark.createDataFrame([("03/05/2021", "Red"), ("March 6, 2021", "Blue"), ("2021-03-07", "Red"), ("soon", "Red")], "Date string, Winner string")
    assert [str(r["Date"])[:10] for r in C.clean(df, threshold=1.0).collect()] == ["2021-03-05", "2021-03-06", "2021-03-07", "None"]
    assert tuple(C.unparsed_dates(df).first()) == (4, 1)


def test_pair_differences_by_type(spark):
    df = spark.createDataFrame(
        [(5, 3, True, False, dt.date(2020, 1, 5), dt.date(2020, 1, 1), "a", "b", 9)],
        "RedAge int, BlueAge int, RedBig boolean, BlueBig boolean, RedDay date, BlueDay date, RedName string, BlueName string, RedOnly int",
    )
    row = P.pair_diffs(df).first()
    assert (row["Age_diff"], row["Big_diff"], row["Day_diff"]) == (2, 1, 4)
    assert P.shared_bases(df) == ["Age", "Big", "Day"] and P.shared_bases(df, numeric_only=True) == ["Age"]
    assert P.pair_diffs(df, numeric_only=True, drop_original=True).columns[-1] == "Age_diff"
    assert P.shared_bases(df.select("RedOnly", "BlueName")) == []


def test_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(3.0, 0.0, 50.0, 100.0), (3.0, 2.0, 40.0, 70.0)],
                               "RedAvgSigStrLanded double, BlueAvgSigStrLanded double, RedAvgSigStrPct double, BlueAvgSigStrPct double")
    got = [(r["strikes_lpm_ratio"], r["striking_def_ratio"]) for r in P.safe_ratios(df).collect()]
    assert got == [(None, None), (1.5, 2.0)]
    assert "td_success_ratio" not in P.safe_ratios(df).columns


@pytest.mark.parametrize("t", [7, 14, 21, 30])
def test_short_notice(spark, t):
    df = spark.createDataFrame([(t - 1, t), (t, t), (t + 1, t), (None, t - 1), (None, None)], "RedNoticeDays int, BlueNoticeDays int")
    assert [r["short_notice_flag"] for r in P.short_notice_flag(df, threshold=t).collect()] == [1, 0, 0, 1, 0]
    one = spark.createDataFrame([(5,), (20,), (30,)], "NoticeDays int")
    assert [r["short_notice_flag"] for r in P.short_notice_flag(one).collect()] == [1, 0, 0]
    assert "short_notice_flag" not in P.short_notice_flag(df.select("RedNoticeDays")).columns


def test_altitude(spark):
    df = spark.createDataFrame([(0,), (1500,), (2000,), (500,), (None,)], "EventAltitude int")
    rows = P.altitude_features(df).collect()
    assert [r["high_altitude_flag"] for r in rows] == [0, 1, 1, 0, 0]
    assert [r["altitude_diff"] for r in rows] == [0, 1500, 2000, 500, None]


def test_named_diffs_direction(spark):
    df = spark.createDataFrame([(30, 25)], "RedAge int, BlueAge int")
    assert P.named_diffs(df).first()["AgeDif"] == -5
    assert P.named_diffs(df, direction="red-blue").first()["AgeDif"] == 5
    with pytest.raises(ValueError):
        P.named_diffs(df, direction="up")


def engineer_input(spark):
    rows = [(i, dt.date(2020, 1 + i, 1), f"F{i % 3}", f"G{i % 2}", "Red" if i % 2 else "Blue", 25 + i, 26, 180.0, 175.0, 3.0, 2.0, 5, 20) for i in range(8)]
    return spark.createDataFrame(
        rows,
        "bout_id long, Date date, RedFighter string, BlueFighter string, Winner string, RedAge int, BlueAge int, RedHeight double,"
        " BlueHeight double, RedAvgSigStrLanded double, BlueAvgSigStrLanded double, RedNoticeDays int, BlueNoticeDays int",
    )


def test_engineer_full_and_simple(spark):
    df = engineer_input(spark)
    full, names = engineer(df)
    assert full.count() == 8
    assert {"Age_diff", "phys_age_diff", "strikes_lpm_ratio", "win_streak_diff", "Age_roll5_diff", "Height_ewm10_diff",
            "Red_win_streak", "short_notice_flag", "_win_streak_roll5_diff"} <= set(names)
    assert names == sorted(names) and "RedAge_roll5" in full.columns and "RedAge_roll5" not in names
    simple, few = engineer(df, mode="simple")
    assert not [n for n in simple.columns if "roll5" in n or "ewm10" in n] and "win_streak_diff" in few
    with pytest.raises(ValueError):
        engineer(df, mode="other")


def test_dropping_originals_disables_nothing(spark):
    df = engineer_input(spark)
    kept, a = engineer(df, mode="simple")
    dropped, b = engineer(df, mode="simple", drop_original=True)
    assert a == b and "RedAge" in kept.columns and "RedAge" not in dropped.columns


def test_history_reaches_upcoming_bouts(spark):
    df = engineer_input(spark)
    past, later = df.filter("bout_id < 6"), df.filter("bout_id >= 6").withColumn("Winner", F.lit(None).cast("string"))
    with_past, _ = engineer(later, history=past)
    whole, _ = engineer(df)
    a = {r["bout_id"]: r["Age_roll5_diff"] for r in with_past.collect()}
    b = {r["bout_id"]: r["Age_roll5_diff"] for r in whole.filter("bout_id >= 6").collect()}
    assert a == b and len(a) == 2


def test_features_without_dates_or_outcomes(spark):
    df = engineer_input(spark)
    _, undated = engineer(df.drop("Date"))
    assert "win_streak_diff" not in undated and "Age_diff" in undated
    _, open_ = engineer(df.drop("Winner"))
    assert "win_streak_diff" not in open_ and "Age_roll5_diff" in open_


def test_lines_are_keyed_under_partitions_that_grow_with_them(spark, monkeypatch):
    from duelframe.catalog import preparation

    keyed, real = [], preparation.C.with_bout_key
    monkeypatch.setattr(preparation.C, "with_bout_key", lambda df, *rest: keyed.append(df) or real(df, *rest))
    preparation.bout_keys_repartitioned(spark, "/root/testdata/sf0.001")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in keyed]
    assert "RepartitionByExpression" in plans[1] and not any("Repartition 5" in p for p in plans)
