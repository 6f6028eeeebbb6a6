import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from duelframe.operators import metrics as M, prep as T, scoring as R
from duelframe.plans import score_matchups, score_upcoming, train
from duelframe.plans.training import cross_validated_logreg, fit_gbt, fit_logreg, prepared
from duelframe.layout import DEFAULT
from duelframe.sources import ModelBundle, first_loadable, tree_nodes


def table(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, f"2020-01-{1 + i % 28:02d}", f"F{i % 9}", f"G{i % 7}", rng.choice(["x", "y"]), a, b,
                     "Red" if a - b + rng.gauss(0, 1) > 0.3 else "Blue"))
    df = spark.createDataFrame(rows, "bout_id long, Date string, RedFighter string, BlueFighter string, grp string, RedX double, BlueX double, Winner string")
    return df.withColumn("Date", F.to_date("Date")).withColumn("target", (F.col("Winner") == "Red").cast("int"))


SKIP = ["bout_id", "Winner", "RedFighter", "BlueFighter"]


@pytest.fixture(scope="module")
def features(spark):
    df = table(spark)
    prep = T.fit_preprocessor(df, exclude=SKIP)
    return prepared(df, prep, DEFAULT).cache(), prep


def test_logistic_regression_is_optimal(features):
    """The gradient of  |w|^2 / 2 + C * sum(weight * loss)  vanishes at the fitted coefficients."""
    data, _ = features
    model = fit_logreg(data, penalty=0.7, tol=1e-10).stages[-1]
    rows = data.select("target", vector_to_array("features").alias("x")).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["target"] for r in rows])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w = np.array(model.coefficients.toArray())
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    gradient = w + 0.7 * x.T @ (weight * (p - y))
    assert np.abs(gradient).max() < 1e-4 and abs((weight * (p - y)).sum()) < 1e-4


def test_models_beat_chance_and_probabilities_are_valid(features):
    data, _ = features
    for model in (fit_logreg(data), fit_gbt(data, trees=5)):
        scored = R.positive_probability(model.transform(data))
        assert M.roc_auc(scored).first()[0] > 0.6 and M.accuracy(scored).first()[0] > 0.55
        row = scored.agg(F.min("prob_red_win"), F.max("prob_red_win")).first()
        assert 0 <= row[0] <= row[1] <= 1


def test_boosting_is_reproducible(features):
    data, _ = features
    a, b = (fit_gbt(data, trees=3).transform(data).select("bout_id", "prediction").orderBy("bout_id").collect() for _ in range(2))
    assert a == b


def test_cross_validation_tries_every_penalty(features):
    data, _ = features
    model, best, scores = cross_validated_logreg(data, penalties=(1e-4, 1.0), folds=3)
    assert best in (1e-4, 1.0) and len(scores) == 6 and min(s for _, _, s in scores) > 0.5
    assert M.roc_auc(R.positive_probability(model.transform(data))).first()[0] > 0.6


@pytest.mark.parametrize("seed", range(3))
def test_auc_equals_the_evaluator(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 1), round(rng.random(), seed + 1)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "target int, prob_red_win double")
    raw = df.select(F.col("target").cast("double").alias("label"), F.col("prob_red_win").alias("rawPrediction"))
    want = BinaryClassificationEvaluator(numBins=0).evaluate(raw)
    assert M.roc_auc(df).first()[0] == pytest.approx(want, abs=1e-12)


def test_auc_of_one_class_or_one_score(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.4)], "target int, prob_red_win double")
    assert M.roc_auc(one).first()[0] is None
    flat = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "target int, prob_red_win double")
    assert M.roc_auc(flat).first()[0] == 0.5


def test_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "target int, prediction int")
    got = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in M.classification_report(df).collect()}
    assert got["0"] == (1.0, 0.5, pytest.approx(2 / 3), 2) and got["1"] == (pytest.approx(2 / 3), 1.0, 0.8, 2)
    assert got["accuracy"][0] == 0.75 and got["macro avg"][1] == 0.75 and got["weighted avg"][3] == 4
    only = spark.createDataFrame([(1, 1)], "target int, prediction int")
    assert {r["class"]: r["f1"] for r in M.classification_report(only).collect()}["0"] == 0.0


def test_champion(spark):
    df = spark.createDataFrame([(0, 0.1, 0.9), (1, 0.8, 0.3)], "target int, good double, bad double")
    row = M.champion_decision(df, champion="good", challenger="bad").first()
    assert (row["champion_auc"], row["challenger_auc"], row["promote"]) == (1.0, 0.0, False)
    assert M.champion_decision(df, None, "bad").first()["promote"] is True


def test_training_run_saves_and_promotes(spark, tmp_path):
    df = table(spark)
    first = train(df, model_type="logreg", exclude=SKIP, save_to=str(tmp_path / "m"), promote_to=str(tmp_path / "best"))
    assert first.promoted and first.roc_auc > 0.6 and first.report.count() == 5
    best = first_loadable([str(tmp_path / "absent"), str(tmp_path / "best")], spark)
    again = train(df, model_type="logreg", exclude=SKIP, champion=best)
    assert again.promoted  # equal is good enough
    broken = ModelBundle(best.preprocessor, first.bundle.preprocessor.model)
    with pytest.warns(UserWarning, match="champion"):
        assert train(df, model_type="logreg", exclude=SKIP, champion=broken).promoted
    with pytest.raises(ValueError):
        train(df, model_type="forest")
    with pytest.raises(FileNotFoundError):
        first_loadable([str(tmp_path / "absent")], spark)


def test_a_fault_while_judging_the_champion_is_no_defeat(spark, monkeypatch, tmp_path):
    """Only a champion that does not fit the data counts as absent; a lost executor must not promote its challenger."""
    df = table(spark)
    first = train(df, model_type="logreg", exclude=SKIP)

    def lost(self, df, out="prob_red_win"):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(ModelBundle, "score", lost)
    with pytest.raises(RuntimeError, match="executor lost"):
        train(df, model_type="logreg", exclude=SKIP, champion=first.bundle)


def test_scores_from_the_table_of_nodes(spark, features, tmp_path):
    data, prep = features
    bundle = ModelBundle(prep, fit_gbt(data, trees=5))
    bundle.save(str(tmp_path / "m"), spark)
    nodes = tree_nodes(str(tmp_path / "m"), spark)
    assert nodes.select("tree").distinct().count() == 5
    walked = {r["bout_id"]: r["prob_red_win"] for r in R.score_by_nodes(data, nodes, 5, 3).collect()}
    for r in R.positive_probability(bundle.classifier.transform(data)).collect():
        assert walked[r["bout_id"]] == pytest.approx(r["prob_red_win"], abs=1e-12)


def test_upcoming_and_matchup_scores(spark, features):
    data, prep = features
    bundle = ModelBundle(prep, fit_logreg(data))
    df = table(spark)
    later = df.filter("bout_id >= 390").drop("target").withColumn("Winner", F.lit(None).cast("string"))
    out = score_upcoming(later, bundle, history=df.filter("bout_id < 390").drop("target"))
    assert out.columns == ["bout_id", "RedFighter", "BlueFighter", "prob_red_win", "predicted_winner", "confidence"]
    assert out.count() == 10 and out.filter("confidence < 0.5 OR confidence > 1").isEmpty()
    profiles = spark.createDataFrame([("Ann", 2.0), ("Bob", -2.0)], "entity string, X double")
    asked = spark.createDataFrame([("ann", "bob"), ("bob", "ann")], "RedFighter string, BlueFighter string")
    rows = score_matchups(asked, profiles, bundle).collect()
    assert {r["winner"] for r in rows} == {"Ann"}
    assert all(r["prob_f1_win"] + r["prob_f2_win"] == pytest.approx(1) for r in rows)


def test_requests_without_a_profile_come_back_unscored(spark, features):
    data, prep = features
    bundle = ModelBundle(prep, fit_logreg(data))
    profiles = spark.createDataFrame([("Ann", 2.0), ("Bob", -2.0)], "entity string, X double")
    asked = spark.createDataFrame([(1, "ann", "bob"), (2, "ann", "nobody")], "id int, RedFighter string, BlueFighter string")
    with pytest.raises(KeyError):
        score_matchups(asked, profiles, bundle)
    rows = {r["id"]: r for r in score_matchups(asked, profiles, bundle, unknown="keep").collect()}
    assert rows[2]["missing"] and rows[2]["prob_f1_win"] is None and rows[2]["winner"] is None
    assert not rows[1]["missing"] and rows[1]["winner"] == "Ann"


def test_matchups_get_named_differences(spark):
    rng = random.Random(6)
    rows = [(i, d := rng.gauss(0, 1), int(d + rng.gauss(0, 0.3) > 0)) for i in range(200)]
    train_rows = spark.createDataFrame(rows, "bout_id long, WinDif double, target int")
    prep = T.fit_preprocessor(train_rows, exclude=["bout_id"])
    bundle = ModelBundle(prep, fit_logreg(prepared(train_rows, prep, DEFAULT)))
    profiles = spark.createDataFrame([("Ann", 9.0), ("Bob", 1.0)], "entity string, Wins double")
    asked = spark.createDataFrame([("Ann", "Bob"), ("Bob", "Ann")], "RedFighter string, BlueFighter string")
    probs = {r["RedFighter"]: r["prob_f1_win"] for r in score_matchups(asked, profiles, bundle).collect()}
    assert probs["Bob"] > 0.99 and probs["Ann"] < 0.01  # named differences count blue minus red


def test_missing_labels_are_refused(spark, features):
    data, _ = features
    holed = data.withColumn("target", F.when(F.col("bout_id") % 9 > 0, F.col("target")))
    for fit in (fit_logreg, fit_gbt, cross_validated_logreg):
        with pytest.raises(ValueError, match="no label"):
            fit(holed)


def test_a_null_auc_is_not_judged(spark):
    df = table(spark, 120).withColumn("target", F.when(F.col("bout_id") < 118, 0).otherwise(1))
    df = df.withColumn("FinishRound", F.lit(2)).withColumn("Finish", F.lit("KO"))
    result = train(df.filter("bout_id < 119"), fraction=0.0)
    assert result.roc_auc is None and result.promoted
    assert not any(n.startswith(("Finish", "RedFighter", "BlueFighter")) for n in result.bundle.preprocessor.names)


def test_short_list_and_summary(spark):
    df = spark.createDataFrame([(i, "a", "b", p) for i, p in enumerate([0.5, 0.9, 0.05, 0.45])], "bout_id int, RedFighter string, BlueFighter string, p double")
    preds = R.predictions(df, prob="p", extra=["bout_id"])
    assert [r["bout_id"] for r in R.by_confidence(preds, "bout_id", 2).collect()] == [2, 1]
    assert [r["predicted_winner"] for r in preds.collect()] == ["Red", "Red", "Blue", "Blue"]
    s = R.score_summary(preds).first()
    assert (s["n"], s["near_half"], s["max_prob"]) == (4, 2, 0.9)
    assert [r["pred_f1_win"] for r in R.score_wide(preds).collect()] == [1, 1, 0, 0]


def test_fits_of_the_grid_share_their_passes(features, monkeypatch):
    """One estimator is fitted, that of the best penalty; the fits of all folds rank like those one by one."""
    from duelframe.plans import training

    data, _ = features
    made, real = [], training.logistic_regression
    monkeypatch.setattr(training, "logistic_regression", lambda *given: made.append(given) or real(*given))
    _, _, together = cross_validated_logreg(data, penalties=(1e-4, 1.0), folds=3, tol=1e-10)
    assert len(made) == 1
    monkeypatch.setattr(training, "narrow", lambda _: None)
    _, _, apart = cross_validated_logreg(data, penalties=(1e-4, 1.0), folds=3, tol=1e-10)
    assert len(made) == 8 and [s[:2] for s in together] == [s[:2] for s in apart]
    assert max(abs(a[2] - b[2]) for a, b in zip(together, apart)) < 1e-3


def test_all_fits_are_optimal_and_equal_rows_count_as_one(spark):
    """The gradient vanishes for every penalty and fold, with and without collapsing; a class that is left alone gives an infinite intercept."""
    from duelframe.operators.logistic import collapsed, fold_fits

    rng = random.Random(1)
    rows = [(i % 3, int(rng.random() < (0.3 if a else 0.7)), [float(a), float(b)]) for i in range(600) for a, b in [(rng.randrange(2), rng.randrange(3))]]
    df = spark.createDataFrame(rows, "fold int, target int, x array<double>")
    weights = {f: {0: 1.0, 1: 2.0} for f in range(3)}
    few = collapsed(df, ["fold", "target", "x"], 600, 36)
    assert few.count() <= 36 and few.agg(F.sum("n")).first()[0] == 600
    assert collapsed(df, ["fold", "target", "x"], 600, 500).count() == 600
    for table in (few, df.withColumn("n", F.lit(1.0))):
        for (penalty, fold), b in fold_fits(table, 2, (1e-4, 1e4), weights, 1e-10, 100).items():
            part = [r for r in rows if r[0] != fold]
            x, y = np.array([r[2] + [1.0] for r in part]), np.array([r[1] for r in part])
            pull = penalty * x.T @ (np.where(y == 1, 2.0, 1.0) * (1 / (1 + np.exp(-x @ np.array(b))) - y))
            assert np.abs(pull + np.array([b[0], b[1], 0.0])).max() < 1e-5 * max(1.0, penalty)
    assert fold_fits(df.withColumn("n", F.lit(1.0)), 2, (1.0,), {0: {1: 1.0}}, 1e-6, 100) == {(1.0, 0): [0.0, 0.0, float("inf")]}


def test_few_different_rows_are_fitted_as_few(spark, monkeypatch):
    from pyspark.ml import Pipeline

    df = spark.createDataFrame([(i, i % 7 % 2, float(i % 5), float(i % 2)) for i in range(2000)], "bout_id long, target int, a double, b double")
    data = prepared(df, T.fit_preprocessor(df, exclude=["bout_id"]), DEFAULT)
    seen, real = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, given: seen.append(given.count()) or real(self, given))
    model = fit_logreg(data, tol=1e-10).stages[-1]
    assert seen == [20]
    monkeypatch.setattr("duelframe.plans.training.EQUAL_ROWS", 10**9)
    whole = fit_logreg(data, tol=1e-10).stages[-1]
    assert seen == [20, 2000] and np.allclose(model.coefficients, whole.coefficients, atol=1e-6) and abs(model.intercept - whole.intercept) < 1e-6


def test_the_roundtrip_makes_its_table_once(spark, monkeypatch):
    from duelframe.catalog import fits

    made, real = [], fits._training_table
    monkeypatch.setattr(fits, "_training_table", lambda *given: made.append(given) or real(*given))
    row = fits.model_roundtrip(spark, "/root/testdata/sf0.001").first()
    assert len(made) == 1 and row["rows"] > 0 and row["differing"] == 0


def test_tasks_of_a_fit_hold_a_bounded_number_of_rows(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from duelframe.plans import training

    df = spark.range(900).selectExpr("id AS bout_id", "CAST(id % 2 AS int) AS target", "CAST(id * 37 % 101 AS double) AS a", "CAST(id AS double) AS b").coalesce(1)
    data = prepared(df, T.fit_preprocessor(df, exclude=["bout_id"]), DEFAULT)
    seen, real = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, given: seen.append([len(p) for p in given.rdd.glom().collect()]) or real(self, given))
    monkeypatch.setattr(training, "TASK_ROWS", 300)
    fit_gbt(data, trees=1, depth=1)
    fit_logreg(data)
    assert [sum(s) for s in seen] == [900, 900] and all(len(s) == 3 and max(s) <= 330 for s in seen)


def test_rows_of_a_fold_travel_as_blocks(spark):
    """A pass over the rows reads few blocks, of the same labels, weights and features; every row is scored by the fits that did not see it."""
    from duelframe.operators.logistic import packed, scored_by_fits

    rows = [(i % 3, i % 2, [float(i), float(-i)], 1.0 + i) for i in range(300)]
    blocks = packed(spark.createDataFrame(rows, "fold int, target int, x array<double>, n double").coalesce(1))
    found = []
    for r in blocks.collect():
        y, n, x = (np.frombuffer(r[c]) for c in ("y", "n", "x"))
        found += [(r["fold"], int(a), list(b), w) for a, b, w in zip(y, x.reshape(2, -1).T, n)]
    assert blocks.count() == 3 and sorted(found) == sorted(rows)
    fits = {(p, f): [0.01 * p, 0.02, float(f)] for p in (1.0, 2.0) for f in range(3)} | {(2.0, 1): [0.0, 0.0, float("-inf")]}
    scored = {(r["penalty"], r["n"]): (r["fold"], r["target"], r["prob_red_win"]) for r in scored_by_fits(blocks, 2, fits).collect()}
    assert len(scored) == 600
    for f, y, x, n in rows:
        for p in (1.0, 2.0):
            a, b, c = fits[p, f]
            fold, target, score = scored[p, n]
            assert (fold, target) == (f, y) and abs(score - (0.0 if c == float("-inf") else 1 / (1 + np.exp(-(a * x[0] + b * x[1] + c))))) < 1e-12


def test_rows_walk_the_trees_without_copies(spark):
    """No row is exploded to a row for each tree; thresholds, categories, leaves at any depth and missing numbers lead where they should."""
    from pyspark.ml.functions import array_to_vector

    nodes = [
        (0, 0, 0, 1.5, None, 1, 2, 0.0, 1.0), (0, 1, -1, None, None, -1, -1, -1.0, 1.0), (0, 2, 1, None, [0.0, 2.0], 3, 4, 0.0, 1.0),
        (0, 3, -1, None, None, -1, -1, 0.5, 1.0), (0, 4, -1, None, None, -1, -1, 2.0, 1.0), (1, 0, -1, None, None, -1, -1, 3.0, 0.1),
    ]
    table = spark.createDataFrame(nodes, "tree int, node int, feature int, threshold double, categories array<double>, left int, right int, prediction double, weight double")
    rows = {"a": ([1.5, 0.0], -1.0), "b": ([1.6, 2.0], 0.5), "c": ([2.0, 1.0], 2.0), "d": ([float("nan"), 0.0], 0.5)}
    df = spark.createDataFrame([(k, x) for k, (x, _) in rows.items()], "k string, x array<double>").select("k", array_to_vector("x").alias("features"))
    found = R.score_by_nodes(df, table, 2, 3, "k", "p")
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        assert abs(r["p"] - 1 / (1 + np.exp(-2 * (rows[r["k"]][1] + 0.3)))) < 1e-15
