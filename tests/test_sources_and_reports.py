from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from duelframe.operators import compare as A, drift as D, quality as V
from duelframe.functions import bout_label, confidence_tier
from duelframe.session import shared_folder
from duelframe.sources import infer_types, load_or_build, read_csv, read_plain_csv, write_predictions


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_types(spark, tmp_path):
    p = write(tmp_path / "a.csv", "i,f,b,s,d,none,mixed\n1,1.5,True,x,2020-01-01,,1\n2,NaN,False,\"a,\"\"b\"\"\",NA,NA,z\n")
    df = read_plain_csv(spark, p)
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "d": "string", "none": "double", "mixed": "string"}
    rows = df.collect()
    assert rows[1]["f"] is None and rows[1]["s"] == 'a,"b"' and rows[1]["d"] is None and rows[0]["b"] is True


def test_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_plain_csv(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ValueError):
        read_plain_csv(spark, write(tmp_path / "e.csv", "a,b\n"), allow_empty=False)


def test_latin1_files_are_recognised(spark, tmp_path):
    write(tmp_path / "u.csv", "name,n\nZoë,1\n")
    write(tmp_path / "l.csv", "name,n\nPeña,2\n", "latin-1")
    with pytest.warns(UserWarning, match="Latin-1"):
        rows = read_csv(spark, str(tmp_path)).collect()
    assert sorted((r["name"], r["n"]) for r in rows) == [("Peña", 2), ("Zoë", 1)]


@pytest.mark.parametrize("listed", [1_000, 0])
@pytest.mark.parametrize("multi_line", [False, True])
def test_mixed_encodings(spark, tmp_path, listed, multi_line):
    """Files of either encoding with names and headers beyond ASCII, and columns in another order."""
    folder = tmp_path / "a folder"
    folder.mkdir()
    for i in range(6):
        write(folder / f"u {i}.csv", f"Größe,name\n{i},Łódź {i}\n")
    write(folder / "a first.csv", "Größe,name\n70,Peña\n", "latin-1")
    write(folder / "z läst.csv", 'Größe,name\n71,"Zoë, Ana"\n', "latin-1")
    want = sorted([(i, f"Łódź {i}") for i in range(6)] + [(70, "Peña"), (71, "Zoë, Ana")])
    with pytest.warns(UserWarning, match="Latin-1"):
        df = read_csv(spark, str(folder), multi_line=multi_line, listed=listed)
    assert df.dtypes == [("Größe", "bigint"), ("name", "string")] and sorted(map(tuple, df.collect())) == want
    schema = StructType([StructField("Größe", LongType()), StructField("name", StringType())])
    with pytest.warns(UserWarning, match="Latin-1"):
        typed = read_csv(spark, str(folder), schema, multi_line, listed)
    assert sorted(map(tuple, typed.collect())) == want
    if listed:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("file_path") >= 2


def test_other_header_in_the_other_encoding(spark, tmp_path):
    write(tmp_path / "a.csv", "b,a\nñ,1\n", "latin-1")
    write(tmp_path / "b.csv", "a,c\n2,x\n3,é\n")
    with pytest.warns(UserWarning):
        rows = read_csv(spark, str(tmp_path)).select("a", "b", "c").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [(1, "ñ", None), (2, None, "x"), (3, None, "é")]))


def test_only_latin1_files(spark, tmp_path):
    write(tmp_path / "a.csv", "n,ä\n1,ö\n", "latin-1")
    with pytest.warns(UserWarning):
        assert [tuple(r) for r in read_csv(spark, str(tmp_path)).collect()] == [(1, "ö")]


def test_cache_is_built_once_and_rebuilt_when_broken(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert load_or_build(spark, path, build).count() == 3
    load_or_build(spark, path, build)
    assert len(calls) == 1
    load_or_build(spark, path, build, force_rebuild=True)
    assert len(calls) == 2
    for f in (tmp_path / "cache").glob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.warns(UserWarning, match="unreadable"):
        assert load_or_build(spark, path, build).count() == 3


def test_prediction_files_are_sorted(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.6), ("b", 0.9), ("c", 0.7)], "RedFighter string, confidence double")
    write_predictions(df.repartition(3), str(tmp_path / "p"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*.csv")))
    assert [line.split(",")[0] for line in text.splitlines() if not line.startswith("RedFighter")] == ["b", "c", "a"]
    with pytest.raises(ValueError):
        write_predictions(df, str(tmp_path / "q"), fmt="xls")


def test_shared_folder_follows_the_session():
    def session(setting, master):
        conf = SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": setting}.get(key) or default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    a, b = (shared_folder(session("hdfs://shared/dir/", "yarn")) for _ in range(2))
    assert a.startswith("hdfs://shared/dir/duelframe-") and a != b
    assert shared_folder(session(None, "local[2]"))
    with pytest.raises(ValueError):
        shared_folder(session(None, "yarn"))


def compared(spark):
    names = "RedFighter string, BlueFighter string, prob_red_win double, predicted_winner string, confidence double"
    a = spark.createDataFrame([("A", "B", 0.9, "Red", 0.9), ("C", "D", 0.4, "Blue", 0.6), ("E", "F", 0.5, "Red", 0.5)], names)
    b = spark.createDataFrame([("A", "B", 0.6, "Red", 0.6), ("C", "D", 0.7, "Red", 0.7), ("X", "Y", 0.5, "Red", 0.5)], names)
    return A.with_agreement(A.compare_join(a, b, ["RedFighter", "BlueFighter"]))


def test_comparison(spark):
    df = compared(spark)
    row = A.agreement_rate(df).first()
    assert (row["total"], row["agreements"], row["disagreements"], row["rate"]) == (2, 1, 1, 0.5)
    assert A.top_disagreements(df, "RedFighter", 1).first()["RedFighter"] == "A"
    k = A.model_kpis(df).first()
    assert (k["mean_confidence_logreg"], k["mean_confidence_gbdt"]) == (0.75, pytest.approx(0.65))
    assert [r["RedFighter"] for r in A.sorted_by_confidence(df, "_gbdt", "RedFighter").collect()] == ["C", "A"]
    assert A.sorted_by_confidence(df, "_gbdt", "RedFighter", agree=True).count() == 1
    details = spark.createDataFrame([("A", "B", "Heavy")], "RedFighter string, BlueFighter string, WeightClass string")
    rich = {r["RedFighter"]: r["WeightClass"] for r in A.enrich(df, details, ["RedFighter", "BlueFighter"], ["WeightClass"]).collect()}
    assert rich == {"A": "Heavy", "C": None}


def test_labels_and_tiers(spark):
    df = spark.createDataFrame([("A" * 20, "B" * 20, 0.7), ("A", "B", 0.71), ("A" * 15, "B" * 15, 0.55)], "r string, b string, c double")
    rows = df.select(bout_label(F.col("r"), F.col("b")).alias("l"), confidence_tier(F.col("c")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["medium", "high", "low"]
    assert len(rows[0]["l"]) == 34 and rows[0]["l"].endswith("...") and rows[1]["l"] == "A vs B" and len(rows[2]["l"]) == 34


def test_histogram_ends(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.5249, 0.99)], "confidence_logreg double, confidence_gbdt double")
    got = {(r["model"], r["bin"]): r["n"] for r in A.confidence_histogram(df).collect()}
    assert got == {("logreg", 0): 2, ("gbdt", 19): 2}


def test_drift(spark):
    a = spark.createDataFrame([("x", "p"), ("y", "p"), (None, "q")], "s string, t string")
    b = spark.createDataFrame([("x", "z")], "s string, t string")
    got = {(r["column_name"], r["value"]): r["found"] for r in D.category_drift(a, b, ["s", "t"]).collect()}
    assert got == {("s", "x"): "both", ("s", "y"): "only_train", ("t", "p"): "only_train", ("t", "q"): "only_train", ("t", "z"): "only_upcoming"}
    sizes = {(r["dataset"], r["column_name"]): r["n_distinct"] for r in D.categorical_profile({"a": a, "b": b}).collect()}
    assert sizes == {("a", "s"): 2, ("a", "t"): 2, ("b", "s"): 1, ("b", "t"): 1}
    assert [tuple(r) for r in D.stage_shapes({"a": a, "b": b}).orderBy("stage").collect()] == [("a", 3, 2), ("b", 1, 2)]
    assert D.feature_gap(["a", "b", "c", "d"], ["a", "z"])["share_missing"] == 0.75


def rule(df, rules):
    return {r["rule"]: (r["checked"], r["violations"]) for r in V.check_rows(df, rules).collect()}


def test_quality_rules(spark):
    df = spark.createDataFrame(
        [("A", "B", "Red", 20, float("inf"), 1, 0.4), ("A", " ", "Draw", 70, 1.0, 2, 1.4), (None, "A", None, None, None, None, 0.5), ("Z", "Z", "Blue", 17, 2.0, 0, 0.1)],
        "RedFighter string, BlueFighter string, Winner string, RedAge int, x double, target int, p double",
    )
    got = rule(df, [V.domain("Winner", ["Red", "Blue"]), V.non_blank("RedFighter"), V.non_blank("BlueFighter"), V.sides_differ(),
                    *V.plausible_ranges(df), *V.finite(df, ["x"]), V.binary_target(), *V.probabilities("p"), V.at_least("RedAge", 18)])
    assert got == {
        "domain:Winner": (4, 2), "non_blank:RedFighter": (4, 1), "non_blank:BlueFighter": (4, 1), "sides_differ": (4, 1),
        "range:RedAge": (3, 2), "finite:x": (3, 1), "binary:target": (4, 2), "range:p": (4, 1), "at_least:RedAge": (3, 1),
    }
    assert tuple(V.duplicates(df.union(df.limit(1))).first()) == ("duplicates", 5, 1)
    assert tuple(V.missing_values(df.withColumn("gone", F.lit(None).cast("int"))).first()) == ("missing_values", 8, 1)
    kinds = {r["rule"]: r["violations"] for r in V.column_types(df, ["Winner", "Nope"], ["RedAge", "Winner"], ["Winner", "x"]).collect()}
    assert kinds == {"required_columns": 1, "numeric_columns": 1, "text_columns": 1}
    dates = spark.createDataFrame([(None,)], "Date date")
    assert V.some_date(dates, "Date").first()["violations"] == 1
    assert V.rows_preserved(df, df.limit(3)).first()["violations"] == 1
    diff = spark.createDataFrame([(3.0, 1.0, 2.0), (3.0, 1.0, 1.0)], "RedX double, BlueX double, X_diff double")
    from duelframe.layout import DEFAULT
    assert rule(diff, [V.difference_holds(DEFAULT, "X")]) == {"difference:X": (2, 1)}
    both = spark.createDataFrame([(0.4, 0.6), (0.4, 0.7)], "p double, q double")
    assert rule(both, V.probabilities("p", "q"))["sums_to_one"] == (2, 1)
    assert V.quality_report(df, [V.sides_differ()], [V.duplicates(df)]).count() == 2


def test_codes_with_a_letter_are_no_numbers(spark):
    df = spark.createDataFrame([("5D", "1f", "1e3", " 7 ", ".5"), ("7D", "2f", "-2.5", "8", "1.")], "a string, b string, c string, d string, e string")
    assert [t for _, t in infer_types(df).dtypes] == ["string", "string", "double", "bigint", "double"]


def test_cells_that_are_not_cast_are_no_whole_numbers(spark):
    from duelframe.sources.files import _DIGITS

    texts = ["1", " 1", "1\n", "\t+7 ", "-0", "\x011\x7f", "1 1", "5D", "1e3", "0x1", "x", "+", "", "2020-01-01", "9" * 25, "1.0", ".5", "1."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    x = F.col("t")
    missed = df.filter(x.try_cast("long").isNotNull() & ~x.contains(".") & ~x.rlike(_DIGITS))
    assert missed.collect() == [] and df.filter(x.rlike(_DIGITS)).count() == 7
    typed = infer_types(df.withColumns({"i": F.lit(" 12"), "e": F.lit("n/a"), "m": F.when(x == "x", "1.5").otherwise("2")}))
    assert dict(typed.dtypes) == {"t": "string", "i": "bigint", "e": "double", "m": "double"}
    assert dict(infer_types(df.limit(0)).dtypes) == {"t": "double"}
