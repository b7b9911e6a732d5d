"""Validation inside training, leak-free stacking and the trial loop."""

import random
import time

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from tabflow.operators import models as MD
from tabflow.operators import runs as R
from tabflow.operators import selection as SEL
from tabflow.operators.pipeline import PreprocessorConfig, PreprocessorModel


def test_plan_caps_folds_and_falls_back(spark):
    rows = [(i, "a" if i < 20 else "b") for i in range(23)]
    df = spark.createDataFrame(rows, "k int, y string")
    assert SEL.validation_plan(df, "y", "binary_classification", "cv", 5).n_folds == 3
    lone = spark.createDataFrame([*rows, (99, "c")], "k int, y string")
    plan = SEL.validation_plan(lone, "y", "multiclass_classification", "cv", 5)
    assert (plan.name, plan.n_folds, plan.least_class) == ("holdout", 1, 1)
    assert SEL.validation_plan(df, "k", "regression", "cv", 5).n_folds == 5
    assert SEL.validation_plan(df, "y", "binary_classification", "holdout").name == "holdout"


def _noise(spark, n=400):
    """A target that no feature knows; ``place`` has about two rows a value, so an
    encoding that has seen a row's target gives it away."""
    r = random.Random(4)
    rows = [(i, f"p{r.randint(0, n // 2)}", r.random(), r.gauss(0, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "k int, place string, x double, y double").repartition(3)


def test_target_encoding_does_not_leak_through_folds(spark):
    df = _noise(spark)
    cfg = PreprocessorConfig(target="y", rare_threshold=0, te_smoothing=0.1, outlier_strategy="none")
    fam = {"Tree": DecisionTreeRegressor(maxDepth=5, seed=1), "Linear": LinearRegression()}
    board, fitted, preds = SEL.train_validated(df, "y", "regression", ["k"], fam, cfg, "r2", n_folds=3)
    assert {r["model"]: r["score_val"] < 0.05 for r in board.collect()} == {"Tree": True, "Linear": True}
    assert preds.groupBy("model").agg(F.countDistinct("k").alias("n"), F.count("k").alias("m")).where("n <> 400 or m <> 400").count() == 0
    # the same encoding fitted on all rows does give the targets away
    seen = fitted["Linear"].transform(fitted["preprocessor"].transform(df))
    assert seen.agg(F.corr("prediction", "y")).first()[0] > 0.5
    hold = spark.createDataFrame([(1000 + i, f"p{i}", 0.5, 0.1 * (i % 5)) for i in range(60)], "k int, place string, x double, y double")
    board, every = SEL.stack(df, hold, "y", "regression", ["k"], fam, cfg, "r2")
    assert {r["model"] for r in board.collect()} == {"Tree", "Linear", "Stacked"}
    assert every.where("model = 'Stacked'").count() == 60 and board.where("score_val > 0.05").count() == 0


def test_holdout_and_stacked_classes(spark):
    r = random.Random(2)
    rows = [(i, r.gauss(i % 3, 0.4), r.random(), "abc"[i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "k int, x double, z double, y string")
    fam = {"Logistic": LogisticRegression(maxIter=20), "Tree": DecisionTreeClassifier(maxDepth=4, seed=1)}
    task = "multiclass_classification"
    board, _, preds = SEL.train_validated(df, "y", task, ["k"], fam, metric="f1", validation="holdout", refit=False)
    assert {r_["validation"] for r_ in board.collect()} == {"holdout"} and preds.where("model = 'Tree'").count() == 48
    train, hold = df.where("k % 4 <> 0"), df.where("k % 4 = 0")
    for metric in ("roc_auc", "log_loss", "precision", "recall"):
        board, _ = SEL.stack(train, hold, "y", task, ["k"], fam, metric=metric)
        got = {x["model"]: x["score_val"] for x in board.collect()}
        assert set(got) == {"Logistic", "Tree", "Stacked"} and got["Stacked"] > (-1.0 if metric == "log_loss" else 0.7)


def test_margins_become_probabilities(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, r.gauss(i % 2, 0.5), str(i % 2)) for i in range(200)], "k int, x double, y string")
    board, _, preds = SEL.train_validated(df, "y", "binary_classification", ["k"], {"SVM": LinearSVC(maxIter=10)}, metric="log_loss", n_folds=2, refit=False)
    assert -0.7 < board.first()["score_val"] < 0 and preds.where("p_pos > 0 and p_pos < 1").count() == 200
    assert MD.evaluate_models(preds, "roc_auc", "binary_classification").first()["score_val"] > 0.85


def test_search_stops_and_keeps_order(spark):
    scores = {0: 1.0, 1: 3.0, 2: None, 3: 2.0, 4: 3.0, 5: 2.5, 6: 2.0, 7: 9.0}

    def evaluate(c):
        time.sleep(0.05 * (c["i"] % 2 == 0))
        if scores[c["i"]] is None:
            raise ValueError("no score")
        return scores[c["i"]]
    propose = lambda history: [{"i": i} for i in range(len(history), min(len(history) + 2, 8))]
    got = SEL.search(spark, propose, evaluate, trials_per_iteration=2, max_iterations=9).orderBy("trial").collect()
    assert [(r["trial"], r["iteration"], r["score"], r["improved"], r["best_so_far"], r["since_improvement"]) for r in got] == [
        (0, 0, 1.0, True, 1.0, 0), (1, 0, 3.0, True, 3.0, 0), (2, 1, None, False, 3.0, 0), (3, 1, 2.0, False, 3.0, 1),
        (4, 2, 3.0, False, 3.0, 2), (5, 2, 2.5, False, 3.0, 3), (6, 3, 2.0, False, 3.0, 4), (7, 3, 9.0, True, 9.0, 0)]
    assert got[2]["status"] == "failed" and "no score" in got[2]["error"]
    scores[7] = 1.0
    longer = lambda history: [{"i": min(len(history) + j, 7)} for j in range(2)]
    got = SEL.search(spark, longer, evaluate, trials_per_iteration=2, max_iterations=9)
    assert got.count() == 8 and SEL.best_trial(got).first()["trial"] == 1
    low = SEL.search(spark, propose, evaluate, higher_better=False, trials_per_iteration=2, max_iterations=2)
    assert SEL.best_trial(low).first()["score"] == 1.0
    assert SEL.search(spark, lambda h: [], evaluate).count() == 0


def test_runs_that_cannot_be_compared(spark):
    runs = spark.createDataFrame([("a", "completed", 3), ("b", "running", 5), ("c", None, None)], "run_id string, status string, created_at int")
    metrics = spark.createDataFrame([("a", "acc", 0.5)], "run_id string, metric_name string, metric_value double")
    assert {r["run_id"]: r["state"] for r in R.run_states(runs, ["a", "b", "c", "d", "a"]).collect()} == {
        "a": "completed", "b": "not completed", "c": "not completed", "d": "missing"}
    assert R.comparable_runs(runs, metrics, ["a"]).first()["acc"] == 0.5
    with pytest.raises(ValueError, match="b: not completed; d: missing"):
        R.comparable_runs(runs, metrics, ["a", "b", "d"])
    assert [r["run_id"] for r in R.newest_first(runs).collect()] == ["b", "a", "c"]


def test_lost_table_is_an_error_on_load(spark, tmp_path):
    from tabflow.operators.pipeline import Preprocessor
    df = spark.createDataFrame([(i, f"v{i % 60}", float(i % 7)) for i in range(300)], "k int, c string, y double")
    model = Preprocessor(PreprocessorConfig(target="y", keep_columns=["k"], rare_threshold=2)).fit(df)
    path = str(tmp_path / "pre")
    model.save(path)
    assert PreprocessorModel.load(spark, path).transform(df).count() == 300
    import shutil
    shutil.move(f"{path}/tables/te", f"{path}/te-elsewhere")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        PreprocessorModel.load(spark, path)
