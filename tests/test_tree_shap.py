"""Tree Shapley values against the enumeration of all coalitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tabflow.operators import explain as EX
from tabflow.operators import tree_shap as TS

FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    h = lambda i, m: F.pmod(F.hash("id", F.lit(i)), F.lit(m)).cast("double")
    df = spark.range(600).select("id", *[h(i, 5 + 3 * i).alias(c) for i, c in enumerate(FEATS)])
    y = ((F.col("a") > 2) & (F.col("b") < 5)).cast("int") + ((F.col("c") + F.col("d")) > 14).cast("int")
    df = df.select("*", y.cast("double").alias("three"), (y > 0).cast("double").alias("two"), (F.col("a") * F.col("b") - F.col("d")).alias("y"))
    return VectorAssembler(inputCols=FEATS, outputCol="features").transform(df).cache()


def _expected(nodes, i, x, known, classes):
    """The tree's expectation where only the features in ``known`` are known."""
    n = nodes[i]
    if n["leftChild"] < 0:
        s = np.array(n["impurityStats"])
        return s / s.sum() if classes else np.array([n["prediction"]])
    f, cut = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
    kids = (n["leftChild"], n["rightChild"])
    if f in known:
        return _expected(nodes, kids[0] if x[f] <= cut else kids[1], x, known, classes)
    cover = [sum(nodes[c]["impurityStats"]) if classes else nodes[c]["impurityStats"][0] for c in kids]
    return sum(w / sum(cover) * _expected(nodes, c, x, known, classes) for w, c in zip(cover, kids))


def _by_hand(trees, weights, x, classes):
    value = {s: sum(w * _expected({n["id"]: n for n in t}, 0, x, set(s), classes) for t, w in zip(trees, weights))
             for k in range(5) for s in itertools.combinations(range(4), k)}
    phi = []
    for i in range(4):
        rest = [j for j in range(4) if j != i]
        phi.append(sum(math.factorial(k) * math.factorial(3 - k) / 24 * (value[tuple(sorted((*s, i)))] - value[s])
                       for k in range(4) for s in itertools.combinations(rest, k)))
    return value[()], np.array(phi)


@pytest.mark.parametrize("make,label", [
    (lambda: DecisionTreeClassifier(maxDepth=5, labelCol="three"), "three"), (lambda: RandomForestClassifier(numTrees=4, maxDepth=4, seed=3, labelCol="three"), "three"),
    (lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=3, labelCol="two"), "two"), (lambda: DecisionTreeRegressor(maxDepth=5, labelCol="y"), "y"),
    (lambda: RandomForestRegressor(numTrees=4, maxDepth=4, seed=3, labelCol="y"), "y"), (lambda: GBTRegressor(maxIter=4, maxDepth=3, seed=3, labelCol="y"), "y")])
def test_values_equal_coalition_enumeration(rows, make, label):
    model = make().fit(rows)
    kind = type(model).__name__
    classes = "Classification" in kind and "GBT" not in kind
    trees = TS._nodes(model)
    weights = [1 / len(trees)] * len(trees) if "Forest" in kind else list(getattr(model, "treeWeights", [1.0]))
    few = rows.where("id < 12")
    got = {}
    for r in TS.tree_shapley(few, model, FEATS, ["id"]).collect():
        got.setdefault(r["id"], {})[r["feature"]] = r
    scored = model.transform(few)
    if classes:
        out = {r["id"]: r["p"] for r in scored.select("id", vector_to_array("probability").alias("p")).collect()}
    elif "GBTClass" in kind:
        out = {r["id"]: [r["m"][1]] for r in scored.select("id", vector_to_array("rawPrediction").alias("m")).collect()}
    else:
        out = {r["id"]: [r["prediction"]] for r in scored.collect()}
    for r in few.collect():
        x = [r[c] for c in FEATS]
        mine = got[r["id"]]
        o = mine["a"]["output"]
        base, phi = _by_hand(trees, weights, x, classes)
        assert np.allclose([mine[c]["phi"] for c in FEATS], phi[:, o], atol=1e-12)
        assert mine["a"]["base_value"] == pytest.approx(base[o], abs=1e-12)
        assert mine["a"]["prediction"] == pytest.approx(out[r["id"]][o], abs=1e-9)
        assert mine["a"]["base_value"] + sum(mine[c]["phi"] for c in FEATS) == pytest.approx(mine["a"]["prediction"], abs=1e-12)
        assert [mine[c]["feature_value"] for c in FEATS] == x and (not classes or o == int(np.argmax(out[r["id"]])))


def test_categorical_splits(rows):
    from pyspark.ml.feature import VectorIndexer
    indexed = VectorIndexer(inputCol="features", outputCol="v", maxCategories=6).fit(rows).transform(rows)
    model = DecisionTreeRegressor(maxDepth=4, labelCol="y", featuresCol="v").fit(indexed)
    assert any(n["split"]["numCategories"] > 0 for n in TS._nodes(model)[0])
    flat = indexed.select("id", *[vector_to_array("v")[i].alias(c) for i, c in enumerate(FEATS)])
    want = {r["id"]: r["prediction"] for r in model.transform(indexed).collect()}
    got = TS.tree_shapley(flat, model, FEATS, ["id"]).groupBy("id").agg(F.sum("phi").alias("s"), F.first("base_value").alias("b"))
    assert all(abs(r["s"] + r["b"] - want[r["id"]]) < 1e-9 for r in got.collect())


def test_one_leaf_and_empty_input(rows):
    model = DecisionTreeRegressor(maxDepth=0, labelCol="y").fit(rows)
    got = TS.tree_shapley(rows.where("id < 2"), model, FEATS, ["id"]).collect()
    assert len(got) == 8 and {r["phi"] for r in got} == {0.0}
    assert TS.tree_shapley(rows.where("id < 0"), model, FEATS, ["id"]).collect() == []


def test_single_explanation_lists_base_prediction_and_values(rows):
    model = RandomForestRegressor(numTrees=3, maxDepth=3, seed=1, labelCol="y").fit(rows)
    got = EX.single_explanation(TS.tree_shapley(rows.where("id = 5"), model, FEATS, ["id"]), top=3).collect()
    assert len(got) == 3 and [abs(r["phi"]) for r in got] == sorted((abs(r["phi"]) for r in got), reverse=True)
    assert {"base_value", "prediction", "feature", "feature_value", "phi"} <= set(got[0].asDict())


def test_sampled_values_carry_base_and_prediction(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(6)], "k int, a double, b double")
    bg = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    score = lambda f: f.withColumn("score", 2 * F.col("a") - 3 * F.col("b") + 1)
    for r in EX.shapley_values(df, bg, ["a", "b"], score, "k", permutations=4, with_base=True).collect():
        i = r["k"]
        a, b = float(i), float(i * i % 7)
        assert r["base_value"] == -3.0 and r["prediction"] == 2 * a - 3 * b + 1
        assert (r["phi"], r["feature_value"]) == ((2 * (a - 1), a) if r["feature"] == "a" else (-3 * (b - 2), b))


def test_permutation_by_shifted_rank(spark):
    rows = [(i, float((i * 37) % 100), float((i * 11) % 13)) for i in range(200)]
    df = spark.createDataFrame([(i, a, b, 3 * a) for i, a, b in rows], "k int, a double, b double, y double").repartition(4)
    seen = []

    def score(frame, by):
        seen.append(frame)
        err = F.avg(-F.abs(F.col("y") - 3 * F.col("a"))).alias("score")
        return frame.groupBy(*by).agg(err) if by else frame.agg(err)
    got = {r["feature"]: r for r in EX.permutation_importance(df, ["a", "b"], score, ["k"], repeats=3).collect()}
    assert got["a"]["importance_mean"] > 10 and got["b"]["importance_mean"] == 0.0 and got["b"]["importance_std"] == 0.0
    shuffled = [f for f in seen if "_feature" in f.columns][0]
    for f, c in (("a", "a"), ("b", "b")):
        for rep in range(3):
            part = shuffled.where((F.col("_feature") == f) & (F.col("_repeat") == rep)).collect()
            assert sorted(r[c] for r in part) == sorted(x[1 if c == "a" else 2] for x in rows)
    plan = shuffled._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_tf_h" not in plan or "GlobalLimit" not in plan
