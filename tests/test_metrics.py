"""Metric operators against direct formulas."""

import pytest
from pyspark.sql import functions as F

from tabflow.operators import metrics as M
from tabflow.operators.score import threshold_predict


def test_average_precision_is_step_sum_not_trapezoid(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.4), (0, 0.3)], "y int, s double")
    ap = M.average_precision(df, F.col("y") == 1, F.col("s")).first()[0]
    assert ap == pytest.approx((1 / 3) * 1 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 4))
    auc = M.roc_auc(df, F.col("y") == 1, F.col("s")).first()[0]
    assert auc == pytest.approx(4 / 6)


def test_confusion_and_averages(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    cm = M.confusion_matrix(df, "y", "p")
    assert cm.count() == 9
    a = M.agreement(cm).first()
    assert a.accuracy == pytest.approx(0.5)
    assert a.balanced_accuracy == pytest.approx((0.5 + 1 + 0) / 3)


def test_threshold_prediction(spark):
    df = spark.createDataFrame([(0.6, 0.4), (0.3, 0.7), (0.4, 0.6)], "proba_0 double, proba_1 double")
    assert [r.prediction for r in threshold_predict(df, "proba_1", 0.5, 1, 0).collect()] == [0, 1, 1]
    assert [r.prediction for r in threshold_predict(df, "proba_1", 0.65, 1, 0).collect()] == [0, 1, 0]


def test_best_threshold_default(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.3)], "y int, s double")
    r = M.best_threshold(df, F.col("y") == 1, F.col("s")).first()
    assert r.optimal_threshold == 0.5 and r.best_f1 == 0.0


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert r.mae == pytest.approx(2 / 3) and r.r2 == pytest.approx(0.0)


def test_train_eval_sample_rule(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert M.train_eval_rows(df, ["k"]).count() == 1000
    assert M.train_eval_rows(df, ["k"], sample=200).count() == 200


@pytest.fixture(scope="module")
def many_pairs(spark, tmp_path_factory):
    """Events with 50,000 x 100,000 pairs of a purchase and another event, more than an int holds."""
    d = tmp_path_factory.mktemp("pairs")
    i = F.col("id")
    spark.range(150_000).select(
        i.alias("event_id"), F.when(i % 3 == 0, "purchase").otherwise("view").alias("event_type"), (i % 7).cast("double").alias("value"),
        (i % 5).alias("user_id")).write.parquet(f"{d}/events.parquet")
    return str(d)


def auc(rows):
    n, pos = {}, {}
    for s, y in rows:
        n[s], pos[s] = n.get(s, 0) + 1, pos.get(s, 0) + y
    below = won = 0
    for s in sorted(n):
        won += pos[s] * (below + (n[s] - pos[s]) / 2)
        below += n[s] - pos[s]
    return won / (sum(pos.values()) * below)


def test_roc_auc_of_more_pairs_than_an_int_holds(spark, many_pairs):
    from __spark_entry__ import queries
    assert queries()["roc_auc"](spark, many_pairs).first()["auc"] == pytest.approx(auc([(i % 7, i % 3 == 0) for i in range(150_000)]), abs=1e-6)


RULES = {"ValueScore": lambda v, u: v / 500, "UserScore": lambda v, u: u / 150, "WeightedEnsemble_L2": lambda v, u: (v / 500 + u / 150) / 2}


def rule_scores():
    return {m: auc([(f(float(i % 7), i % 5), i % 3 == 0) for i in range(150_000)]) for m, f in RULES.items()}


def test_leaderboard_of_more_pairs_than_an_int_holds(spark, many_pairs):
    from __spark_entry__ import queries
    got = {r["model"]: r["score_val"] for r in queries()["leaderboard"](spark, many_pairs).collect()}
    assert got == pytest.approx(rule_scores(), abs=1e-6)


def test_ensemble_fallback_of_more_pairs_than_an_int_holds(spark, many_pairs):
    from __spark_entry__ import queries
    r = queries()["ensemble_fallback"](spark, many_pairs).first()
    scores = rule_scores()
    single = max((m for m in scores if m != "WeightedEnsemble_L2"), key=scores.get)
    assert r["top_model"] == max(scores, key=scores.get) and r["best_single_model"] == single
    assert r["improvement_ratio"] == pytest.approx((max(scores.values()) - scores[single]) / scores[single], abs=1e-5)


@pytest.fixture(scope="module")
def one_kind(spark, tmp_path_factory):
    """Folders of events without a purchase, of purchases alone, and of purchases without a user."""
    i, out = F.col("id"), {}
    for name, kind, user in (("views", "view", i % 5), ("purchases", "purchase", i % 5),
                             ("anonymous", F.when(i % 3 == 0, "purchase").otherwise("view"), F.when(i % 3 > 0, i % 5))):
        out[name] = str(tmp_path_factory.mktemp(name))
        spark.range(60).select(i.alias("event_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"),
                               (i % 7).cast("double").alias("value"), user.alias("user_id")).write.parquet(f"{out[name]}/events.parquet")
    return out


def test_ensemble_fallback_without_a_pair(spark, one_kind):
    from __spark_entry__ import queries
    for name in ("views", "purchases"):
        assert set(queries()["ensemble_fallback"](spark, one_kind[name]).first().asDict().values()) == {None}
    r = queries()["ensemble_fallback"](spark, one_kind["anonymous"]).first()
    assert (r["top_model"], r["best_single_model"], r["ensemble_used"], r["chosen_model"]) == ("ValueScore", "ValueScore", False, "ValueScore")


def test_ranking_of_a_class_without_a_pair(spark):
    df = spark.createDataFrame([("a", 1, 0.3), ("a", 0, 0.2), ("b", 1, 0.3), ("b", 1, 0.4), ("c", 0, 0.1)], "k string, y int, s double")
    got = {r["cls"]: (r["auc"], r["average_precision"]) for r in M.ranking_by(df, F.col("k"), F.col("y") == 1, F.col("s")).collect()}
    assert got == {"a": (1.0, 1.0), "b": (None, 1.0), "c": (None, 0.0)}


def test_leaderboard_without_a_pair(spark, one_kind):
    from __spark_entry__ import queries
    for name in ("views", "purchases"):
        assert {r["model"]: r["score_val"] for r in queries()["leaderboard"](spark, one_kind[name]).collect()} == dict.fromkeys(RULES)
    rows = queries()["leaderboard"](spark, one_kind["anonymous"]).collect()
    assert rows[0]["model"] == "ValueScore" and [r["score_val"] for r in rows] == [
        pytest.approx(auc([(i % 7, i % 3 == 0) for i in range(60)]), abs=1e-6), None, None]
