"""Cross-validation of the full pipeline (F24 with F19, F25, F26 folded in).

Folds are a column (reproducible, partition-independent); for every fold the
preprocessor and the model are fitted on the other folds only and scored on
the held-out fold with MLlib evaluators. Scores are higher-is-better (losses
negated, like scikit-learn scorers); failures are reported, not raised."""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import (BinaryClassificationEvaluator, MulticlassClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.operators import folds as FO
from tabflow.operators.metrics import averages, label_pairs, ovr_auc
from tabflow.operators.models import build_pipeline
from tabflow.operators.pipeline import Preprocessor, PreprocessorConfig

CLASSIFICATION = ("binary_classification", "multiclass_classification")

# metric name → (evaluator kind, evaluator metric, sign); sign −1 = negated loss
SCORERS = {
    "accuracy": ("multi", "accuracy", 1.0),
    "f1": ("multi", "weightedFMeasure", 1.0),
    "f1_macro": ("table", "f1_macro", 1.0),
    "f1_micro": ("multi", "accuracy", 1.0),   # one label per row: micro F1 is the accuracy
    "f1_weighted": ("multi", "weightedFMeasure", 1.0),
    "precision": ("multi", "weightedPrecision", 1.0),
    "recall": ("multi", "weightedRecall", 1.0),
    "roc_auc": ("binary", "areaUnderROC", 1.0),
    "log_loss": ("multi", "logLoss", -1.0),
    "root_mean_squared_error": ("reg", "rmse", -1.0),
    "rmse": ("reg", "rmse", -1.0),
    "mean_squared_error": ("reg", "mse", -1.0),
    "mean_absolute_error": ("reg", "mae", -1.0),
    "r2": ("reg", "r2", 1.0),
}


def scorer(metric: str | None, task: str) -> tuple[str, str, float]:
    """evaluator for a metric name; unknown → weighted F1 (classification)
    or negated RMSE (regression)."""
    key = (metric or "").replace("-", "_").lower()
    if key in SCORERS:
        return SCORERS[key]
    return SCORERS["f1"] if task in CLASSIFICATION else SCORERS["rmse"]


def baseline_estimator(task: str, seed: int = 42):
    """100-tree random forest."""
    if task in CLASSIFICATION:
        return RandomForestClassifier(numTrees=100, seed=seed)
    return RandomForestRegressor(numTrees=100, seed=seed)


def assign_folds(df: DataFrame, target: str, task: str, key_cols: list[str], n_folds: int = 5,
                 cv_type: str | None = None, group_col: str | None = None, order_cols: list[str] | None = None,
                 seed: int = 42) -> tuple[DataFrame, int, str]:
    """choose the splitter and fold count from the data, return the frame
    with a ``fold`` column (time series: ``block``; fold i trains on earlier blocks)."""
    n = df.count()
    min_class = None
    if task in CLASSIFICATION:
        min_class = df.groupBy(target).count().agg(F.min("count")).first()[0]
    k, kind = FO.choose_folds(n, task, min_class, n_folds)
    if cv_type in ("timeseries", "time_series"):
        return FO.time_series_blocks(df, k, order_cols or key_cols, n_rows=n).withColumnRenamed("block", "fold"), k, "timeseries"
    if cv_type == "group":
        if not group_col:
            raise ValueError("group cross-validation needs group_col")
        return FO.group_kfold(df, group_col, k, seed=seed), k, "group"
    if kind == "stratified":
        return FO.stratified_kfold(df, target, k, key_cols, seed=seed), k, "stratified"
    return FO.kfold(df, k, key_cols, seed=seed, n_rows=n), k, "kfold"


def _evaluate(pred: DataFrame, task: str, kind: str, metric: str, target: str) -> float:
    if kind == "reg":
        return RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName=metric).evaluate(pred)
    if kind == "table":
        return averages(label_pairs(pred, "label", "prediction")).first()[metric]
    if kind == "binary" and task == "multiclass_classification":
        # one class against the rest, weighted by the class's rows
        p = pred.withColumn("_p", vector_to_array("probability"))
        k = p.select(F.size("_p")).first()[0]
        p = p.select(F.col("label").cast("int").cast("string").alias("label"), *[F.col("_p")[i].alias(f"p{i}") for i in range(k)])
        auc = ovr_auc(p, "label", {str(i): f"p{i}" for i in range(k)}).where(F.col("auc").isNotNull())
        rows = p.groupBy(F.col("label").alias("cls")).agg(F.count(F.lit(1)).alias("w"))
        return auc.join(rows, "cls").agg(F.sum(F.col("auc") * F.col("w")) / F.sum("w")).first()[0]
    if kind == "binary":
        return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction",
                                             metricName=metric).evaluate(pred)
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction",
                                             metricName=metric).evaluate(pred)


def cross_validate(df: DataFrame, target: str, task: str, key_cols: list[str], metric: str | None = None,
                   n_folds: int = 5, cv_type: str | None = None, group_col: str | None = None,
                   order_cols: list[str] | None = None, estimator=None, config: PreprocessorConfig | None = None,
                   seed: int = 42, parallelism: int = 3) -> DataFrame:
    """``(fold, score, error)`` per fold plus a summary row (fold = −1)
    with the mean and population std of the scores (6 decimals)."""
    spark: SparkSession = df.sparkSession
    rows: list[tuple] = []
    try:
        d, k, kind_cv = assign_folds(df, target, task, key_cols, n_folds, cv_type, group_col, order_cols, seed)
        kind, mname, sign = scorer(metric, task)
        est = estimator or baseline_estimator(task, seed)
        cfg = config or PreprocessorConfig(target=target, keep_columns=list(key_cols))
        def run_fold(f: int) -> tuple:
            try:
                if kind_cv == "timeseries":
                    tr, te = d.where(F.col("fold") < f), d.where(F.col("fold") == f)
                else:
                    tr, te = d.where(F.col("fold") != f), d.where(F.col("fold") == f)
                cfg_f = PreprocessorConfig(**{**cfg.__dict__, "drop_columns": list(cfg.drop_columns) + ["fold"]})
                pre = Preprocessor(cfg_f).fit(tr)
                pm = build_pipeline(est, pre.feature_columns, target, task).fit(pre.transform(tr))
                pred = pm.transform(pre.transform(te))
                return (f, round(sign * _evaluate(pred, task, kind, mname, target), 6), None)
            except Exception as e:  # noqa: BLE001 - a failing fold is reported, like the reference
                return (f, None, f"{type(e).__name__}: {str(e)[:200]}")

        # folds are independent: fit them concurrently (their jobs share the cluster)
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as pool:
            rows.extend(pool.map(run_fold, range(k)))
    except Exception as e:  # noqa: BLE001
        rows.append((-1, None, f"{type(e).__name__}: {str(e)[:200]}"))
        return spark.createDataFrame(rows, "fold int, score double, error string")
    ok = [s for _, s, err in rows if err is None and s is not None]
    mean = round(sum(ok) / len(ok), 6) if ok else None
    std = round(math.sqrt(sum((s - mean) ** 2 for s in ok) / len(ok)), 6) if ok else None
    out = spark.createDataFrame(rows, "fold int, score double, error string")
    summary = spark.createDataFrame([(-1, mean, None if ok else "no fold succeeded")], "fold int, score double, error string")
    return out.unionByName(summary).withColumn("std", F.when(F.col("fold") == -1, F.lit(std)))
