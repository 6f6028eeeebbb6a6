import datetime as dt

import pytest

from duelframe.operators import entities as E


@pytest.fixture
def bouts(spark):
    rows = [
        (1, "Ann", "Bob", 20, 30, 1.0, None),
        (2, "Bob", "Ann", 40, None, None, 5.0),
        (3, None, "Cy", 99, 10, 2.0, 8.0),
    ]
    return spark.createDataFrame(rows, "bout_id int, RedFighter string, BlueFighter string, RedAge int, BlueAge int, RedX double, BlueX double")


def test_profile_averages_both_sides(bouts):
    got = {r["entity"]: (r["Age"], r["X"]) for r in E.entity_profile(bouts).collect()}
    assert got == {"Ann": (20.0, 3.0), "Bob": (35.0, None), "Cy": (10.0, 8.0)}


def test_profile_of_a_side_that_has_no_such_column(bouts):
    got = {r["entity"]: r["Age"] for r in E.entity_profile(bouts.drop("BlueAge")).collect()}
    assert got == {"Ann": 20.0, "Bob": 40.0, "Cy": None}


def test_profile_subset(bouts):
    assert [r["entity"] for r in E.entity_profile(bouts, entities=["Bob", "Zed"]).collect()] == ["Bob"]
    assert E.entity_profile(bouts, entities=["Zed"]).isEmpty()


def test_subset_filter_reaches_the_scan(spark, bouts, tmp_path):
    bouts.write.parquet(str(tmp_path / "b"))
    df = E.entity_profile(spark.read.parquet(str(tmp_path / "b")), stats=["Age"], entities=["Ann"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PushedFilters: [Or(" in scan and "RedX" not in scan


def test_only_the_leading_prefix_is_stripped(spark):
    df = spark.createDataFrame([(1, 2)], "RedRedCards int, BlueRedCards int")
    assert E.profile_bases(df) == ["RedCards"]


def test_directory(bouts):
    assert [r["entity"] for r in E.entity_directory(bouts).collect()] == ["Ann", "Bob", "Cy"]


def test_matchup_ignores_case(spark, bouts):
    profiles = E.entity_profile(bouts)
    asked = spark.createDataFrame([(7, "ann", "BOB"), (8, "Ann", "nobody")], "id int, RedFighter string, BlueFighter string")
    rows = E.matchups(asked, profiles, on=dt.date(2024, 1, 1), unknown="drop").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["id"], r["RedFighter"], r["BlueFighter"], r["Date"]) == (7, "Ann", "Bob", dt.date(2024, 1, 1))
    assert (r["RedAge"], r["BlueAge"]) == (20.0, 35.0)


def test_unknown_names(spark, bouts):
    profiles = E.entity_profile(bouts)
    asked = spark.createDataFrame([("Ann", "nobody"), ("nobody", "BOB")], "RedFighter string, BlueFighter string")
    assert [r["entity"] for r in E.unknown_entities(asked, profiles).collect()] == ["nobody"]
    with pytest.raises(KeyError, match="1 requested"):
        E.matchups(asked, profiles)
    with pytest.raises(ValueError, match="unknown"):
        E.matchups(asked, profiles, unknown="guess")
    kept = E.matchups(asked, profiles, unknown="keep").collect()
    assert sorted((r["RedFighter"], r["BlueFighter"], r["missing"]) for r in kept) == [("Ann", "nobody", True), ("nobody", "Bob", True)]
    assert {r["RedAge"] for r in kept if r["RedFighter"] == "nobody"} == {None}


def test_fallback_stats(spark):
    df = spark.createDataFrame([(None, 33.0)], "RedAge double, BlueAge double")
    row = E.fill_matchup(df).first()
    assert (row["RedAge"], row["BlueAge"], row["RedOdds"], row["BSubOdds"]) == (30.0, 33.0, -150.0, 600.0)
    assert (row["WeightClass"], row["NumberOfRounds"], row["EmptyArena"]) == ("Welterweight", 3, False)
    assert len(E.matchup_stat_defaults()) == 56
