"""Training, ensemble rule, explanation and scoring."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabflow.operators import explain as EX
from tabflow.operators import models as MD
from tabflow.operators.score import batch_predict


def test_ensemble_fallback_rule(spark):
    lb = spark.createDataFrame([("WeightedEnsemble_L2", 0.85), ("GBM", 0.84), ("RF", 0.83)], "model string, score_val double")
    r = MD.ensemble_decision(lb).first()
    assert r.ensemble_used and r.fallback_applied and r.chosen_model == "GBM"
    lb2 = spark.createDataFrame([("WeightedEnsemble_L2", 0.95), ("GBM", 0.84)], "model string, score_val double")
    assert not MD.ensemble_decision(lb2).first().fallback_applied


def test_permutation_importance_orders_features(spark):
    rows = [(i, 1 if i % 2 else -1, (i * 5) % 3, 1 if i % 2 else 0) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, f1 int, f2 int, target int").withColumn("target", F.col("target").cast("string"))
    pm = MD.build_pipeline(LogisticRegression(maxIter=50), ["f1", "f2"], "target", "binary_classification").fit(df)

    def score(frame, group_cols):
        p = pm.transform(frame)
        acc = F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score")
        return p.groupBy(*group_cols).agg(acc) if group_cols else p.agg(acc)
    imp = {r.feature: r.importance_mean for r in EX.permutation_importance(df, ["f1", "f2"], score, ["k"], repeats=3).collect()}
    assert imp["f1"] > imp["f2"]


def test_shapley_additivity_linear(spark):
    rows = [(i, float(i % 7), float((i * 3) % 5), 2.0 * (i % 7) - 3.0 * ((i * 3) % 5) + 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double")
    pm = MD.build_pipeline(LinearRegression(regParam=0.0), ["a", "b"], "y", "regression").fit(df)
    bg = df.limit(10).select("a", "b")
    x = df.where("k in (3, 4)").select("k", "a", "b")

    def fn(frame):
        return pm.transform(frame.withColumn("y", F.lit(0.0))).withColumnRenamed("prediction", "score")
    phi = EX.shapley_values(x, bg, ["a", "b"], fn, "k", permutations=6).collect()
    got = {(r.k, r.feature): r.phi for r in phi}
    # for a linear model each φ is w · (x − z), z one of the background rows: φ differs between
    # the two rows by w · (difference of x) plus w · (difference of the mean z), which is bounded
    w = {"a": 2.0, "b": -3.0}
    at = {r.k: r for r in x.collect()}
    zs = bg.collect()
    for k in (3, 4):
        for c in ("a", "b"):
            reach = sorted(w[c] * (at[k][c] - z[c]) for z in zs)
            assert reach[0] - 1e-3 <= got[(k, c)] <= reach[-1] + 1e-3
    # with one background row every permutation gives the same: φ is exact and adds up
    one = bg.limit(1)
    z = one.first()
    exact = {(r.k, r.feature): r.phi for r in EX.shapley_values(x, one, ["a", "b"], fn, "k", permutations=3).collect()}
    preds = {r.k: r.prediction for r in pm.transform(x.withColumn("y", F.lit(0.0))).collect()}
    base = pm.transform(one.withColumn("y", F.lit(0.0))).first().prediction
    for k in (3, 4):
        for c in ("a", "b"):
            assert exact[(k, c)] == pytest.approx(w[c] * (at[k][c] - z[c]), abs=1e-3)
        assert exact[(k, "a")] + exact[(k, "b")] == pytest.approx(preds[k] - base, abs=1e-6)


def test_label_encode_decode(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "c")], "num double, cat string")
    idx, enc = EX.label_encode(df, ["cat"])
    noisy = enc.withColumn("cat_code", F.col("cat_code") + F.lit(0.2))
    dec = EX.label_decode(noisy, idx, ["cat"]).collect()
    assert all(r.cat == r.cat_decoded for r in dec)
    far = enc.withColumn("cat_code", F.lit(7.3))
    assert {r.cat_decoded for r in EX.label_decode(far, idx, ["cat"]).collect()} == {idx.labelsArray[0][-1]}


def test_batch_predict_probabilities(spark):
    df = spark.createDataFrame([(float(i), "1" if i > 5 else "0") for i in range(12)], "x double, target string")
    pm = MD.build_pipeline(LogisticRegression(), ["x"], "target", "binary_classification").fit(df)
    out = batch_predict(df.drop("target"), None, pm, keep=["x"])
    assert {"prediction", "prob_0", "prob_1"} <= set(out.columns)
    assert out.count() == 12


def test_cross_validate_reports_scores(spark):
    from tabflow.operators.cv import cross_validate
    rows = [(i, float(i % 10), float((i * 7) % 13), "1" if i % 10 > 4 else "0") for i in range(100)]
    df = spark.createDataFrame(rows, "k int, a double, b double, target string")
    out = {r.fold: r for r in cross_validate(df, "target", "binary_classification", ["k"], metric="accuracy",
                                             n_folds=3).collect()}
    assert sorted(out) == [-1, 0, 1, 2]
    assert all(out[f].error is None and 0 <= out[f].score <= 1 for f in range(3))
    assert out[-1].std is not None
    reg = spark.createDataFrame([(i, float(i), 2.0 * i + 1) for i in range(60)], "k int, a double, y double")
    r = {x.fold: x for x in cross_validate(reg, "y", "regression", ["k"], metric="rmse", n_folds=3).collect()}
    assert r[-1].score <= 0     # negated loss


def test_cv_scorers_by_name(spark):
    from tabflow.operators.cv import _evaluate, scorer
    from pyspark.ml.linalg import Vectors
    rows = [(0.0, 0.0, [.8, .1, .1]), (0.0, 1.0, [.3, .4, .3]), (1.0, 1.0, [.1, .8, .1]), (1.0, 1.0, [.2, .7, .1]),
            (2.0, 2.0, [.1, .1, .8]), (2.0, 0.0, [.5, .2, .3])]
    df = spark.createDataFrame([(a, b, Vectors.dense(p)) for a, b, p in rows], ["label", "prediction", "probability"])

    def run(metric):
        kind, name, sign = scorer(metric, "multiclass_classification")
        return sign * _evaluate(df, "multiclass_classification", kind, name, "y")
    assert run("f1_micro") == pytest.approx(4 / 6)
    assert run("f1_macro") == pytest.approx((0.5 + 0.8 + 2 / 3) / 3)
    # share of ordered pairs, ties half
    pairs = lambda c: sum((x > y) + 0.5 * (x == y) for a, _, p in rows if a == c for x in [p[int(c)]]
                          for b, _, q in rows if b != c for y in [q[int(c)]]) / 8
    assert run("roc_auc") == pytest.approx(sum(pairs(c) for c in (0.0, 1.0, 2.0)) / 3)


def test_scoring_input_of_the_wrong_kind_is_refused(spark):
    from tabflow.operators.clean import scoring_schema_problems
    fitted = spark.createDataFrame([(1.0, "a", 1)], "x double, c string, k int").schema
    assert scoring_schema_problems(spark.createDataFrame([(1, "a", 2.0)], "x int, c string, k double").schema, fitted) == []
    got = scoring_schema_problems(spark.createDataFrame([("1", 2)], "x string, c int").schema, fitted)
    assert got == ["x should be numeric, is other", "c should be other, is numeric", "missing column k"]


def test_leaderboard_metrics_are_what_they_say(spark):
    import pytest
    rows = [("m", 1.0, 1.0, 0.9)] * 6 + [("m", 1.0, 0.0, 0.4)] * 2 + [("m", 0.0, 1.0, 0.3)] * 1 + [("m", 0.0, 0.0, 0.8)] * 11
    df = spark.createDataFrame(rows, "model string, label double, prediction double, p_true double")
    got = {m: MD.evaluate_models(df, m, "binary_classification").first().score_val for m in ("accuracy", "precision", "recall", "f1")}
    assert {k: round(v, 6) for k, v in got.items()} == {"accuracy": 0.85, "precision": round(6 / 7, 6), "recall": 0.75, "f1": 0.8}
    with pytest.raises(ValueError):
        MD.evaluate_models(df, "no_such_metric", "binary_classification")
    reg = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 1.5)], "model string, _y double, prediction double")
    best = MD.evaluate_models(reg, "root_mean_squared_error", "regression").orderBy("score_val").collect()
    assert [(r.model, r.score_val) for r in best] == [("a", -1.0), ("b", -0.5)]


def test_best_run_takes_the_lower_long_named_loss(spark):
    from tabflow.operators.runs import best_run
    m = spark.createDataFrame([("x", "root_mean_squared_error", 9.0), ("y", "root_mean_squared_error", 1.0)],
                              "run_id string, metric_name string, metric_value double")
    assert best_run(m).first().run_id == "y"


def test_greedy_ensemble_prefers_better_model(spark):
    rows = [(i % 2, 0.9 if i % 2 else 0.1, 0.6 if (i % 3 == 0) else 0.4) for i in range(60)]
    df = spark.createDataFrame(rows, "label int, good double, noisy double")
    w, loss = MD.greedy_ensemble(df, "label", {"good": "good", "noisy": "noisy"}, rounds=5)
    assert w.get("good", 0) >= 0.5 and loss > 0


def test_extra_families_and_configs(spark):
    from tabflow.operators.split import split_for_task
    df = spark.createDataFrame([(float(i % 7), float(i % 5), "1" if i % 7 > 3 else "0") for i in range(80)],
                               "a double, b double, target string").withColumn("k", F.monotonically_increasing_id())
    fam = MD.extra_families(2, 2)
    for name, est in fam.items():
        pm = MD.build_pipeline(est, ["a", "b"], "target", "binary_classification").fit(df)
        assert pm.transform(df).count() == 80, name
    s = split_for_task(df, "target", "binary_classification", 0.2, ["k"])
    assert {r.split for r in s.collect()} == {"train", "test"}
    r = split_for_task(df, "a", "regression", 0.25, ["k"])
    assert r.where("split = 'test'").count() == 20


def test_leaderboard_view(spark):
    lb = spark.createDataFrame([("RandomForest", 0.8), ("LogisticRegression", 0.85), ("WeightedEnsemble_L2", 0.86)],
                               "model string, score_val double")
    v = MD.leaderboard_view(lb).collect()
    assert [r.family for r in v] == ["ensemble", "linear", "tree"]
    assert [r.model for r in MD.leaderboard_view(lb, family="tree").collect()] == ["RandomForest"]
