"""Fitting, evaluating and promoting classifiers."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from duelframe.layout import DEFAULT, Layout, c, literal_rows
from duelframe.operators import metrics as M
from duelframe.operators.logistic import EQUAL_ROWS, collapsed, fold_fits, narrow, packed, scored_by_fits
from duelframe.operators.prep import MAX_CATEGORIES, Preprocessor, fit_preprocessor
from duelframe.operators.scoring import positive_probability
from duelframe.operators.split import FOLDS, HOLDOUT, SEED, stratified_folds, stratified_split, with_class_weights
from duelframe.session import discard, materialised
from duelframe.sources.models import ModelBundle

# Settings of the two classifiers, columns known only after a bout, and the cross-validated penalties.
LOGREG_C = 1.0
LOGREG_TOL = 1e-4
LOGREG_MAX_ITER = 10_000
POST_OUTCOME = ("Finish", "FinishDetails", "FinishRound", "FinishRoundTime", "TotalFightTimeSecs")
CV_PENALTIES = (1e-4, 1e-2, 1.0, 1e2, 1e4)
GBT_TREES = 100
GBT_STEP = 0.1
GBT_DEPTH = 3

# Rows of features that a task of a fit holds: scans are split by compressed bytes, of which a row may have very few.
TASK_ROWS = 1_000_000


@dataclass(frozen=True)
class TrainingResult:
    bundle: ModelBundle
    accuracy: float
    roc_auc: float | None
    promoted: bool
    report: DataFrame


def logistic_regression(weight_sum: float, penalty: float = LOGREG_C) -> LogisticRegression:
    """L2 logistic regression minimising ``|w|^2 / 2 + C * sum of weighted losses`` with a free intercept."""
    return LogisticRegression(
        labelCol="target",
        weightCol="class_weight",
        regParam=1.0 / (penalty * weight_sum),
        elasticNetParam=0.0,
        standardization=False,
        tol=LOGREG_TOL,
        maxIter=LOGREG_MAX_ITER,
    )


def gradient_boosting(trees: int = GBT_TREES, seed: int = SEED, depth: int = GBT_DEPTH) -> GBTClassifier:
    return GBTClassifier(labelCol="target", maxIter=trees, stepSize=GBT_STEP, maxDepth=depth, seed=seed)


def _checked(features: DataFrame) -> int:
    """Rows of the frame; a missing label is refused, not dropped."""
    rows, labelled = features.agg(F.count(F.lit(1)), F.count("target")).first()
    if rows != labelled:
        raise ValueError(f"{rows - labelled} rows have no label")
    return rows


def _dealt(features: DataFrame, rows: int) -> DataFrame:
    """The rows in as many partitions as it takes for ``TASK_ROWS`` each; left as they are where there are enough."""
    parts = math.ceil(rows / TASK_ROWS)
    return features if parts <= 1 or features.rdd.getNumPartitions() >= parts else features.repartition(parts)


def fit_logreg(features: DataFrame, penalty: float = LOGREG_C, tol: float = LOGREG_TOL) -> PipelineModel:
    """Balanced logistic regression on a frame with ``features`` and ``target``; equal rows are fitted as one with their weight."""
    rows, distinct = _checked(features), None
    if narrow(features):
        x = features.select("target", vector_to_array("features").alias("x"))
        distinct = x.agg(F.approx_count_distinct(F.xxhash64("target", "x"))).first()[0]
    few = distinct is not None and distinct * EQUAL_ROWS <= rows
    weighted = with_class_weights(features if few else _dealt(features, rows))
    if few:
        weights = weighted.groupBy("target", "class_weight", vector_to_array("features").alias("x")).agg(F.count(F.lit(1)).alias("n"))
        weighted = weights.select("target", (F.col("class_weight") * F.col("n")).alias("class_weight"), array_to_vector("x").alias("features"))
    # Balanced weights sum to the number of rows.
    estimator = logistic_regression(float(rows), penalty).setTol(tol)
    return Pipeline(stages=[estimator]).fit(weighted)


def fit_gbt(features: DataFrame, trees: int = GBT_TREES, seed: int = SEED, depth: int = GBT_DEPTH) -> PipelineModel:
    rows = _checked(features)
    return Pipeline(stages=[gradient_boosting(trees, seed, depth)]).fit(_dealt(features, rows))


def cross_validated_logreg(
    features: DataFrame,
    key: str = DEFAULT.key,
    penalties: Sequence[float] = CV_PENALTIES,
    folds: int = FOLDS,
    seed: int = SEED,
    parallelism: int = 4,
    tol: float = LOGREG_TOL,
) -> tuple[PipelineModel, float, list[tuple[float, int, float | None]]]:
    """Grid over ``C`` scored by ROC-AUC on stratified folds, refitted on all rows with the best.

    Returns the model, its ``C`` and ``(C, fold, roc_auc)`` of every fit; a fold that holds one class
    has no ROC-AUC and does not count. The folds are written out once, so all fits see the same rows
    even when tasks are retried. Features of at most ``DENSE_WIDTH`` are fitted together, one pass over the
    rows for a step of all fits, and rows that are equal count as one; wider ones are fitted one by one.
    """
    rows, width = _checked(features), narrow(features)
    folded = stratified_folds(features, key=key, folds=folds, seed=seed)
    grid = [(p, f) for p in penalties for f in range(folds)]
    if width:
        folded = materialised(folded.select("fold", "target", vector_to_array("features").alias("x"), F.lit(1.0).alias("n")))
        distinct = folded.agg(F.approx_count_distinct(F.xxhash64("fold", "target", "x"))).first()[0]
        if distinct * EQUAL_ROWS <= rows:
            every, folded = folded, materialised(collapsed(folded, ["fold", "target", "x"], rows, distinct))
            discard(every)
    else:
        folded = materialised(folded.withColumn("n", F.lit(1.0)))
    # One count of rows by fold and class gives the weights of all fits.
    sizes = {(r["fold"], r["target"]): int(r["n"]) for r in folded.groupBy("fold", "target").agg(F.sum("n").alias("n")).collect()}
    weights: dict[int, dict] = {}
    for fold in range(folds):
        left: dict = {}
        for (f, y), n in sizes.items():
            if f != fold:
                left[y] = left.get(y, 0) + n
        weights[fold] = {y: sum(left.values()) / (len(left) * n) for y, n in left.items()}
    if width and {y for _, y in sizes} <= {0, 1} and all(weights.values()):
        every, folded = folded, materialised(packed(folded))
        discard(every)
        judged = scored_by_fits(folded, width, fold_fits(folded, width, penalties, weights, tol, LOGREG_MAX_ITER))
    else:
        judged = _judged_apart(folded, width, weights, sizes, penalties, tol, parallelism)
    judged = materialised(judged)
    areas = {(r["penalty"], r["fold"]): r["roc_auc"] for r in M.roc_auc(judged, by=["penalty", "fold"], weight="n").collect()}  # a row for each fit
    discard(folded, judged)
    scores = [(p, f, areas.get((p, f))) for p, f in grid]
    known = {p: [a for q, _, a in scores if q == p and a is not None] for p in penalties}
    means = {p: sum(found) / len(found) if found else 0.0 for p, found in known.items()}
    best = max(penalties, key=means.get)
    return fit_logreg(features, best, tol), best, scores


def _judged_apart(folded, width, weights, sizes, penalties, tol, parallelism) -> DataFrame:
    """The same by one fit after the other, for features of any width and classes of any number."""
    if width:
        folded = folded.withColumn("features", array_to_vector("x")).drop("x")

    def fit_one(candidate: tuple[float, int]) -> LogisticRegressionModel:
        penalty, fold = candidate
        weight = F.lit(None).cast("double")
        for y, w in weights[fold].items():
            weight = F.when(F.col("target") == y, F.lit(w)).otherwise(weight)
        part = folded.filter(F.col("fold") != fold).withColumn("class_weight", weight * F.col("n"))
        total = sum(n for (f, _), n in sizes.items() if f != fold)
        return logistic_regression(float(total), penalty).setTol(tol).fit(part)

    grid = [(p, f) for p in penalties for f in weights]
    with ThreadPool(parallelism) as pool:
        models = dict(zip(grid, pool.map(fit_one, grid)))
    judged = None
    for fold in weights:
        # All models that did not see a fold score it in one scan.
        scored = folded.filter(F.col("fold") == fold)
        for i, penalty in enumerate(penalties):
            model = models[penalty, fold]
            quiet = {model.probabilityCol: "_p", model.rawPredictionCol: "", model.predictionCol: ""}
            scored = positive_probability(model.copy(quiet).transform(scored), "_p", f"_p{i}").drop("_p")
        each = F.inline(F.array(*[F.struct(F.lit(p).alias("penalty"), F.col(f"_p{i}").alias("prob_red_win")) for i, p in enumerate(penalties)]))
        part = scored.select("fold", "target", "n", each)
        judged = part if judged is None else judged.unionByName(part)
    return judged


def prepared(df: DataFrame, preprocessor: Preprocessor, layout: Layout) -> DataFrame:
    return preprocessor.transform(df).select(layout.key, "target", "features")


def evaluate(model: PipelineModel, features: DataFrame) -> tuple[float, float | None, DataFrame]:
    """Accuracy, ROC-AUC and the classification report on a hold-out."""
    scored = positive_probability(model.transform(features)).select("target", "prob_red_win", "prediction")
    scored = materialised(scored)
    acc = M.accuracy(scored).first()["accuracy"]
    auc = M.roc_auc(scored).first()["roc_auc"]
    report = M.classification_report(scored)
    rows = [tuple(r) for r in report.collect()]  # five rows
    discard(scored)
    kept = literal_rows(features.sparkSession, report.columns, rows)
    return acc, auc, kept.select([c(n).cast(kind) for n, kind in report.dtypes])


def train(
    df: DataFrame,
    layout: Layout = DEFAULT,
    model_type: str = "logreg",
    fraction: float = HOLDOUT,
    seed: int = SEED,
    exclude: Sequence[str] | None = None,
    max_categories: int | None = MAX_CATEGORIES,
    champion: ModelBundle | None = None,
    save_to: str | None = None,
    promote_to: str | None = None,
    trees: int = GBT_TREES,
    cross_validate: bool = False,
    center: bool = True,
    tol: float = LOGREG_TOL,
) -> TrainingResult:
    """Split, fit on the training part, evaluate, compare with the champion, refit on all rows, save.

    ``cross_validate`` chooses the penalty of the logistic regression on folds, for the
    evaluation and again for the refit; ``center=False`` only divides by the deviation.
    Unless ``exclude`` is given, outcome, key, competitors and what is known only after
    a bout are no features. A ROC-AUC that is null, as with one class in the hold-out,
    counts as not judged: it neither promotes over a judged champion nor keeps its place.
    ``df`` is engineered and carries ``target``. Scaling and encoding are fitted on
    the training part only for the evaluation. ``promote_to`` receives the evaluated
    model when it is at least as good as the champion.
    """
    def logreg(features: DataFrame) -> PipelineModel:
        return cross_validated_logreg(features, layout.key, seed=seed, tol=tol)[0] if cross_validate else fit_logreg(features, tol=tol)

    fits = {"logreg": logreg, "gbdt": lambda f: fit_gbt(f, trees, seed)}
    if model_type not in fits:
        raise ValueError(f"unknown model type {model_type!r}; use one of {sorted(fits)}")
    identity = [layout.outcome, layout.key, layout.red_entity, layout.blue_entity]
    skip = [*identity, *POST_OUTCOME] if exclude is None else list(exclude)
    spark = df.sparkSession
    table = materialised(stratified_split(df, key=layout.key, fraction=fraction, seed=seed))
    training, holdout = table.filter(~F.col("is_holdout")), table.filter("is_holdout")

    prep = fit_preprocessor(training, exclude=skip, max_categories=max_categories, center=center)
    seen = materialised(prepared(training, prep, layout))
    fitted = fits[model_type](seen)
    discard(seen)
    accuracy, auc, report = evaluate(fitted, prepared(holdout, prep, layout))

    best = -1.0
    if champion is not None:
        try:
            best = M.roc_auc(champion.score(holdout).select("target", "prob_red_win")).first()["roc_auc"]
        except (ValueError, KeyError, FileNotFoundError, AnalysisException) as err:  # another width, absent columns or files
            warnings.warn(f"the champion could not be evaluated: {err}")
    promoted = best is None or best == -1.0 if auc is None else best is None or auc >= best
    if promoted and promote_to:
        ModelBundle(prep, fitted).save(promote_to, spark)
    prep.discard()

    full_prep = fit_preprocessor(table, exclude=skip, max_categories=max_categories, center=center)
    everything = materialised(prepared(table, full_prep, layout))
    final = ModelBundle(full_prep, fits[model_type](everything))
    discard(everything, table)
    if save_to:
        final.save(save_to, spark)
    return TrainingResult(final, accuracy, auc, promoted, report)
