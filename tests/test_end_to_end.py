"""End-to-end flow (the reference's orchestrated pipeline): load → infer → quality
→ split → weights → preprocess → train → evaluate → score → save/load."""

from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from tabflow.operators import imbalance, infer, models, quality, score, split
from tabflow.operators.pipeline import Preprocessor, PreprocessorConfig, PreprocessorModel
from tabflow.sources import read_table

from conftest import SF01


def test_binary_pipeline_end_to_end(spark, tmp_path):
    lab = read_table(spark, f"{SF01}/labels.parquet").withColumn("toxic", F.col("toxic").cast("string"))
    doc = read_table(spark, f"{SF01}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    df = lab.join(doc, "doc_id")
    assert infer.infer_task_type(df, "toxic").first()["task_type"] == "binary_classification"
    assert {r.dimension for r in quality.quality_scores(df, "toxic").collect()} >= {"overall"}
    parts = split.three_way_split(df, "toxic", 0.15, 0.15, key_cols=["doc_id"])
    train, val, test = (parts.where(F.col("split") == s).drop("split") for s in ("train", "val", "test"))
    train = imbalance.class_weights(train, "toxic")
    pre = Preprocessor(PreprocessorConfig(target="toxic", keep_columns=["doc_id"])).fit(train)
    fams = {"LogisticRegression": LogisticRegression(maxIter=20), "LinearSVC": LinearSVC(maxIter=10),
            "RandomForest": RandomForestClassifier(numTrees=10, seed=42)}
    lb, fitted, _ = models.train_family(pre.transform(train), pre.transform(val), "toxic", "binary_classification",
                                        pre.feature_columns, families=fams, weight_col="_sample_weight")
    rows = lb.collect()
    assert len(rows) == 3 and all(0 <= r.score_val <= 1 for r in rows)
    best = fitted[rows[0].model]
    out = score.batch_predict(test.drop("toxic"), pre, best, keep=["doc_id"])
    assert out.count() == test.count() and "prediction" in out.columns
    path = str(tmp_path / "pre")
    pre.save(path)
    again = PreprocessorModel.load(spark, path)
    out2 = score.batch_predict(test.drop("toxic"), again, best, keep=["doc_id"])
    assert out.select("doc_id", "prediction").exceptAll(out2.select("doc_id", "prediction")).count() == 0


def _orders(spark):
    o = read_table(spark, f"{SF01}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                          "o_orderdate", "o_orderpriority")
    c = read_table(spark, f"{SF01}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal",
                                                             "c_mktsegment")
    return o.join(c, "o_custkey").drop("o_custkey")


def test_multiclass_and_regression_end_to_end(spark):
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
    df = _orders(spark)
    parts = split.stratified_split(df, "o_orderstatus", 0.2, ["o_orderkey"])
    tr, te = parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split")
    pre = Preprocessor(PreprocessorConfig(target="o_orderstatus", keep_columns=["o_orderkey"])).fit(tr)
    fams = {"LogisticRegression": LogisticRegression(maxIter=20),
            "GBT": OneVsRest(classifier=GBTClassifier(maxIter=3, maxDepth=2, seed=42))}
    lb, fitted, _ = models.train_family(pre.transform(tr), pre.transform(te), "o_orderstatus",
                                        "multiclass_classification", pre.feature_columns, families=fams, metric="accuracy")
    assert lb.count() == 2
    out = score.batch_predict(te.drop("o_orderstatus"), pre, fitted["LogisticRegression"], keep=["o_orderkey"])
    assert {"prob_F", "prob_O", "prob_P"} <= set(out.columns)
    # regression on the price
    rparts = split.random_split(df.drop("o_orderstatus"), 0.2, ["o_orderkey"])
    rtr, rte = rparts.where("split = 'train'").drop("split"), rparts.where("split = 'test'").drop("split")
    rpre = Preprocessor(PreprocessorConfig(target="o_totalprice", keep_columns=["o_orderkey"])).fit(rtr)
    rfam = {"LinearRegression": LinearRegression(maxIter=10), "RandomForest": RandomForestRegressor(numTrees=5, seed=42),
            "GLM": GeneralizedLinearRegression(maxIter=5)}
    rlb, rfit, _ = models.train_family(rpre.transform(rtr), rpre.transform(rte), "o_totalprice", "regression",
                                       rpre.feature_columns, families=rfam, metric="rmse")
    rows = rlb.collect()
    assert len(rows) == 3 and all(r.score_val <= 0 for r in rows)      # negated RMSE
    pred = score.batch_predict(rte.drop("o_totalprice"), rpre, rfit["LinearRegression"], keep=["o_orderkey"])
    assert pred.count() == rte.count()
