import random
import statistics

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from duelframe.layout import c
from duelframe.operators import dictionary as D, prep as T, split as S


@pytest.mark.parametrize("limit", [5, 60, 10**6])
@pytest.mark.parametrize("seed", range(3))
def test_median_equals_brute_force(spark, limit, seed, monkeypatch):
    """Tiny limits force bracketing; a coarse sketch makes the brackets wide."""
    monkeypatch.setattr(T, "_ACCURACY", 50)
    rng = random.Random(seed)
    columns = {
        "smooth": [rng.gauss(0, 1) for _ in range(900)],
        "ties": [float(rng.choice([1, 1, 1, 2, 2, 9])) for _ in range(900)],
        "edge": [1.0] * 450 + [2.0] * 449 + [7.0],
        "half": [1.0] * 450 + [float(i) for i in range(2, 452)],
        "gaps": [None if rng.random() < 0.5 else rng.expovariate(1) for _ in range(900)],
        "none": [None] * 900,
        "odd": [rng.random() for _ in range(899)] + [None],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{n} double" for n in columns))
    got = T.exact_medians(df, list(columns), sorted_rows=limit)
    for name, values in columns.items():
        known = [v for v in values if v is not None]
        assert got[name] == (statistics.median(known) if known else None), name


def test_mode_prefers_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y"), ("b", None), ("a", None)], "s string, t string")
    assert T.most_frequent(df, ["s", "t"]) == {"s": "a", "t": "x"}
    assert {r["s"] for r in T.impute_modes(df, ["s"]).collect()} == {"a", "b"}


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    assert [tuple(r) for r in T.standardise(df, ["x", "k"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert [tuple(r) for r in T.standardise(df, ["x", "k"], center=False).collect()] == [(1.0, 5.0), (3.0, 5.0)]


def training(spark):
    rows = [(1, 1.0, None, "a", "u0", 0, True), (2, None, None, "b", "u1", 1, True), (3, 3.0, None, None, "u2", 0, False), (4, 8.0, None, "a", "u3", 1, False)]
    return spark.createDataFrame(rows, "bout_id int, x double, dead double, g string, it's string, target int, flag boolean".replace("it's", "`it's`"))


def test_preprocessor(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "MAX_CATEGORIES", 3)
    df = training(spark)
    prep = T.fit_preprocessor(df, exclude=["bout_id"], max_categories=3)
    assert prep.names == ["x", "g=a", "g=b"] and sorted(prep.dropped) == ["dead", "it's"]
    rows = [r[0] for r in prep.transform(df).orderBy("bout_id").select(vector_to_array("features")).collect()]
    filled = [1.0, 3.0, 3.0, 8.0]
    mean, std = statistics.mean(filled), statistics.pstdev(filled)
    assert [round(r[0], 9) for r in rows] == [round((v - mean) / std, 9) for v in filled]
    assert [r[1:] for r in rows] == [[1, 0], [0, 1], [1, 0], [1, 0]]
    unknown = spark.createDataFrame([("zzz",)], "g string")
    assert prep.transform(unknown).select(vector_to_array("features")).first()[0] == [pytest.approx((3 - mean) / std), 0, 0]
    prep.save(str(tmp_path / "p"), spark)
    again = T.Preprocessor.load(str(tmp_path / "p"), spark)
    assert again.names == prep.names
    assert [r[0] for r in again.transform(df).orderBy("bout_id").select(vector_to_array("features")).collect()] == rows
    with pytest.raises(ValueError):
        prep.check(7)
    with pytest.raises(KeyError):
        T.fit_preprocessor(df.drop("target"))


def test_wide_vocabulary_needs_no_filter(spark):
    prep = T.fit_preprocessor(training(spark), exclude=["bout_id"], max_categories=None)
    assert prep.names == ["x", "g=a", "g=b", "it's=u0", "it's=u1", "it's=u2", "it's=u3"]


@pytest.mark.parametrize("share", [1_000, 3])
def test_dictionary_encodes_like_the_bounded_vocabulary(spark, tmp_path, monkeypatch, share):
    """With a low share, frequent values are looked up in one table and the rest in another."""
    monkeypatch.setattr(D, "HOT_SHARE", share)
    rng = random.Random(4)
    words = ["hot"] * 60 + [f"w{i:02d}" for i in range(40)] + [None] * 10 + ["", "É", "a=b"]
    rows = [(i, rng.choice([None, 1.5, 2.0, 7.25]), rng.choice(words), rng.choice("xyz"), None, i % 2, float(i) / 7) for i in range(300)]
    df = spark.createDataFrame(rows, "bout_id int, x double, word string, `z.k` string, dead string, target int, y double").repartition(3)
    fitted = [T.fit_preprocessor(df, exclude=["bout_id"], max_categories=m) for m in (10_000, None)]
    assert fitted[0].names == fitted[1].names and fitted[0].dropped == fitted[1].dropped == ["dead"]
    fitted[1].save(str(tmp_path / "p"), spark)
    fitted.append(T.Preprocessor.load(str(tmp_path / "p"), spark))
    later = df.unionByName(spark.createDataFrame([(900, None, "unknown", None, 1), (901, 3.0, None, "new", 0)], "bout_id int, x double, word string, `z.k` string, target int"), True)
    for table in (df, later, later.drop("word").withColumn("passes", F.lit("through"))):
        out = [p.transform(table).select(*[c(n) for n in table.columns], vector_to_array("features").alias("f")).orderBy("bout_id").collect() for p in fitted]
        assert len(out[0]) == table.count() and out[0] == out[1] == out[2]
    fitted[2].check(len(fitted[0].names))
    with pytest.raises(ValueError):
        fitted[2].check(3)
    fitted[1].discard()


def test_dictionary_numbers_values_in_order(spark):
    df = spark.createDataFrame([(v, w) for v, w in zip("cabba", ["É", "z", "", None, "z"])], "s string, t string").repartition(4)
    rows = D.slots(df, ["t", "s"]).orderBy("slot").collect()
    assert [tuple(r) for r in rows] == [("s", "a", 2, 0), ("s", "b", 2, 1), ("s", "c", 1, 2), ("t", "", 1, 3), ("t", "z", 2, 4), ("t", "É", 1, 5)]


def test_table_without_text_or_rows(spark):
    numbers = spark.createDataFrame([(1.0, 1), (3.0, 0)], "x double, target int")
    prep = T.fit_preprocessor(numbers, max_categories=None)
    assert prep.names == ["x"] and [list(r[0]) for r in prep.transform(numbers).select(vector_to_array("features")).collect()] == [[-1.0], [1.0]]
    text = spark.createDataFrame([("a", 1), ("b", 0)], "s string, target int")
    prep = T.fit_preprocessor(text, max_categories=None)
    assert [list(r[0]) for r in prep.transform(text).orderBy("s").select(vector_to_array("features")).collect()] == [[1.0, 0.0], [0.0, 1.0]]
    assert prep.transform(text.limit(0)).collect() == []
    empty = T.fit_preprocessor(text.limit(0), max_categories=None)
    assert empty.width == 0 and empty.dropped == ["s"]


def test_vocabulary_size_is_checked(spark):
    with pytest.raises(ValueError, match="more than 3"):
        T.vocabularies(training(spark), ["g", "it's"], limit=3)


def labelled(spark, n=1000):
    return spark.range(n).selectExpr("id AS bout_id", "CAST(id % 10 < 3 AS INT) AS target")


def test_holdout_is_exact_per_class_and_reproducible(spark):
    df = labelled(spark)
    out = S.stratified_split(df, fraction=0.15)
    counts = {(r["target"], r["is_holdout"]): r["count"] for r in out.groupBy("target", "is_holdout").count().collect()}
    assert counts == {(1, True): 45, (1, False): 255, (0, True): 105, (0, False): 595}
    ids = {r[0] for r in out.filter("is_holdout").select("bout_id").collect()}
    again = {r[0] for r in S.stratified_split(df.repartition(7), fraction=0.15).filter("is_holdout").select("bout_id").collect()}
    other = {r[0] for r in S.stratified_split(df, fraction=0.15, seed=1).filter("is_holdout").select("bout_id").collect()}
    assert ids == again and ids != other


def test_split_does_not_shuffle_the_table(spark):
    S.stratified_split(labelled(spark)).createOrReplaceTempView("v")
    plan = S.stratified_split(labelled(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    plan = S.stratified_folds(labelled(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_folds_are_balanced_per_class(spark):
    counts = S.stratified_folds(labelled(spark)).groupBy("target", "fold").count().collect()
    assert len(counts) == 10 and {r["count"] for r in counts} == {60, 140}


def test_class_weights(spark):
    got = {r["target"]: r["class_weight"] for r in S.class_weights(labelled(spark)).collect()}
    assert got == {1: pytest.approx(1000 / 600), 0: pytest.approx(1000 / 1400)}


def test_cuts_are_refined_until_a_prefix_is_small(spark):
    df = labelled(spark)
    codes = {y: sorted(r[0] for r in df.filter(f"target = {y}").select(S._code("bout_id", 42)).collect()) for y in (0, 1)}
    ranks = {0: [1, 350, 700], 1: [30, 299]}
    found = S._codes_at(df, "target", "bout_id", 42, ranks, ranked=1)
    assert found == {(y, r): codes[y][r - 1] for y, wanted in ranks.items() for r in wanted}


def test_small_classes_leave_folds_empty(spark):
    df = spark.createDataFrame([(i, 0 if i else 1) for i in range(8)], "bout_id long, target int")
    rows = S.stratified_folds(df).collect()
    assert len(rows) == 8 and all(0 <= r["fold"] < 5 for r in rows)


def test_rows_without_a_label_stay(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "bout_id long, target int")
    assert S.stratified_folds(df).filter("fold IS NOT NULL").count() == 100
    weighted = S.with_class_weights(df)
    assert weighted.count() == 100 and weighted.filter("class_weight IS NULL").count() == 20
    assert S.stratified_split(df).filter("is_holdout").count() == 4 + 2 * 8


def test_wide_vocabularies_fit(spark):
    df = spark.range(60_000).selectExpr("id AS bout_id", "CAST(id % 2 AS INT) AS target", "concat('v', id) AS word", "CAST(id AS DOUBLE) AS x")
    prep = T.fit_preprocessor(df, exclude=["bout_id"], max_categories=None)
    assert len(prep.names) == 60_001


def test_areas_of_scores_that_differ_take_one_shuffle(spark, capsys, monkeypatch):
    """Rows are sent by bucket and not by score before; the area is that of all pairs, ties counted half."""
    from duelframe.operators import metrics as M

    monkeypatch.setattr(M, "_BUCKET_SCORES", 50)
    rows = [(g, i * 7 % 5 % 2, (i * 37 % 301) / 301, 1.0 + i % 3) for g in range(2) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, target int, prob_red_win double, n double")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = M.roc_auc(df, by=["g"], weight="n")
        out.explain()
        sent = [line for line in capsys.readouterr().out.splitlines() if "Exchange" in line]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sent and not [line for line in sent if "_score" in line.split("hashpartitioning(")[-1].split(")")[0]]
    for r in out.collect():
        part = [x for x in rows if x[0] == r["g"]]
        won = sum(a[3] * b[3] * (1.0 if a[2] > b[2] else 0.5 if a[2] == b[2] else 0.0) for a in part for b in part if a[1] == 1 and b[1] == 0)
        assert abs(r["roc_auc"] - won / sum(a[3] for a in part if a[1]) / sum(b[3] for b in part if not b[1])) < 1e-12


def test_features_of_few_values_are_made_dense(spark):
    """No row goes through JSON text; a value that was not seen has no slot."""
    from pyspark.ml.linalg import DenseVector

    df = spark.createDataFrame([(i, i % 2, "ab"[i % 2], "xyz"[i % 3], float(i)) for i in range(12)], "bout_id long, target int, t string, u string, v double")
    prep = T.fit_preprocessor(df, exclude=["bout_id"], max_categories=None)
    rows = spark.createDataFrame([(0, "b", "q", 3.0), (1, None, "y", None)], "bout_id long, t string, u string, v double")
    found = {r["bout_id"]: r["features"] for r in prep.transform(rows).collect()}
    assert all(isinstance(v, DenseVector) for v in found.values()) and prep.names == ["v", "t=a", "t=b", "u=x", "u=y", "u=z"]
    assert [list(found[i])[1:] for i in (0, 1)] == [[0, 1, 0, 0, 0], [1, 0, 0, 1, 0]]
